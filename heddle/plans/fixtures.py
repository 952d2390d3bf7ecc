"""Decision data derived from the supplied tables: as DataFrames, and as the SQL that a second engine derives them by."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PAYLOAD, REFUSALS, REQUESTS, STRIP, worded
from ..operators import metrics
from ..operators.records import conversations, last_turns
from ..schemas import LABELS

#: The one tool that derived responses may call.
TOOLS = '[{"name":"lookup","description":"d","parameters":{"type":"dict","properties":{"id":{"type":"int"}}},"required":["id"]}]'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_at(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (n + 1).cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, response): each conversation's last turn, made into one of eight kinds of response."""
    x = last_turns(table(spark, sf_dir, "conversations"))
    n, b = F.col("conv_id").cast("string"), F.col("text")
    kinds = [
        F.concat(b, F.lit(" Could you please specify the date?")),
        F.concat(F.lit("I am sorry, "), b),
        F.concat(F.lit('<TOOLCALL>{"name":"lookup","arguments":{"id":'), n, F.lit("}}</TOOLCALL>")),
        F.lit('[{"name":"lookup","arguments":{}}]'),
        F.lit('{"name":"nope","arguments":{}}'),
        b,
        F.lit("   "),
        F.concat(F.lit("lookup(id="), n, F.lit(")")),
    ]
    out = kinds[-1]
    for k, c in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(F.col("conv_id") % 8 == k, c).otherwise(out)
    return x.select("conv_id", out.alias("response"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, chosen, rejected): a response and the next conversation's; the last one's next is the first."""
    r = responses(spark, sf_dir)
    after = r.select((F.col("conv_id") - 1).alias("conv_id"), F.col("response").alias("rejected"))
    first = F.broadcast(r.where("conv_id = 0").select(F.lit(1).alias("__one"), F.col("response").alias("__first")))
    out = r.withColumnRenamed("response", "chosen").join(after, "conv_id", "left").withColumn("__one", F.lit(1)).join(first, "__one")
    return out.select("conv_id", "chosen", F.coalesce("rejected", "__first").alias("rejected"))


def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, critique_text, preference_text): what a judge may write, well formed and not."""
    x = last_turns(table(spark, sf_dir, "conversations"))
    b = F.col("text")
    critiques = [
        F.lit("Verdict: NO_ISSUES\nPrimary Issue: none\nCritique: No issues"),
        F.concat(F.lit("Verdict: ISSUES\nPrimary Issue: wrong_tool\nCritique: "), b),
        F.lit("Verdict: ISSUES\nPrimary Issue: something_else\nCritique: x"),
        F.lit("Primary Issue: none\nCritique: x"),
        F.lit(""),
        F.lit("verdict: issues\nprimary issue: bad_tool_call_format\ncritique: y"),
    ]
    preferences = [F.concat(F.lit("Winner: A\nReason: "), b), F.lit("winner: b\nreason: z"), F.lit("Winner: C\nReason: q"), F.lit("Reason: only"), F.lit(""), F.lit("Winner: A")]

    def pick(kinds: list[Column]) -> Column:
        out = kinds[-1]
        for k, c in reversed(list(enumerate(kinds[:-1]))):
            out = F.when(F.col("conv_id") % 6 == k, c).otherwise(out)
        return out

    return x.select("conv_id", pick(critiques).alias("critique_text"), pick(preferences).alias("preference_text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, run_key, gold, pred_raw, pred_norm) from events."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(e.alias("uuid"), F.col("event_type").alias("run_key"), label_at(1 + u % 3).alias("gold"), label_at(e % 4).alias("pred_raw"), label_at((e + u) % 4).alias("pred_norm"))


def probe_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, run_key, gold, probe) from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("uuid"), F.col("event_type").alias("run_key"), label_at(1 + F.col("user_id") % 3).alias("gold"), label_at(1 + e % 3).alias("probe"))


def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, label, score, text) of each event's four choices."""
    rows = F.array(*[F.struct(F.lit(x).alias("label"), ((F.col("event_id") * 31 + 17 * (k + 1)) % 97).cast("double").alias("score"), F.lit("x" * (5 + k)).alias("text")) for k, x in enumerate(LABELS)])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), F.inline(rows))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_key, layer_tag, position, accuracy, macro_f1, is_placeholder): three layers a run, two of them level in accuracy."""
    e = eval_samples(spark, sf_dir)
    raw = metrics.summary(metrics.cells(e, "run_key", "gold", "pred_raw"), "run_key", LABELS)
    norm = metrics.summary(metrics.cells(e, "run_key", "gold", "pred_norm"), "run_key", LABELS)
    layer = lambda x, tag, k, more: x.select("run_key", F.lit(tag).alias("layer_tag"), F.lit(k).alias("position"), "accuracy", (F.col("macro_f1") + more).alias("macro_f1"), F.lit(False).alias("is_placeholder"))
    return layer(raw, "middle", 0, 0.0).unionByName(layer(norm, "layer_75pct", 1, 0.0)).unionByName(layer(norm, "last", 2, 0.125))


#: Tools of varied calls: for each argument its name, type, its value in JSON, in Python's syntax and as Python shows it, and
#: a value of a wrong type in JSON and as Python shows it. K, C, S, P and R stand for an order's columns.
SHAPES = (
    ("lookup", (("id", "integer", "{K}", "{K}", "{K}", "[{K}]", "[{K}]"),)),
    ("book", (("status", "string", '"{S}"', "'{S}'", "'{S}'", "1", "1"), ("price", "float", "{P}", "{P}", "{P}"), ("paid", "boolean", "true", "True", "True"))),
    ("get_weather", (("where", "dict", '{"city":"{R}","units":["C",null]}', "{'city': '{R}', 'units': ['C', null]}".replace("null", "None"), "{'city': '{R}', 'units': ['C', None]}", '"x"', "'x'"),)),
    ("rank", (("ids", "array", "[{K},{C}]", "({K}, {C})", "[{K}, {C}]", "{K}", "{K}"), ("label", "str", '"it\'s \\"{S}\\""', '"it\'s \\"{S}\\""', "'it\\'s \"{S}\"'"))),
    ("convert", (("unit", "string", '"metric"', "metric", "'metric'", "7", "7"), ("when", "string", '"a + b"', "a + b", "'a + b'"))),
)
#: Their specifications; the first argument of each has to be there.
VARIED_TOOLS = json.dumps([{"name": n, "parameters": {"type": "dict", "properties": {a[0]: {"type": a[1]} for a in given}}, "required": [given[0][0]]} for n, given in SHAPES])
#: Tools of a conversation: one of three descriptions, in one of two spellings that mean the same.
ROW_TOOLS = """CASE WHEN conv_id % 2 = 0 THEN '[{"name":"lookup","description":"d' || conv_id % 3 || '","parameters":{"type":"dict","properties":{"id":{"type":"int"}}},"required":["id"]},{"name":"book","price":2.5}]'
    ELSE '[ {"price": 2.5, "name": "book"} , {"required": ["id"], "parameters": {"properties": {"id": {"type": "int"}}, "type": "dict"}, "description": "d' || conv_id % 3 || '", "name": "lookup"} ]' END"""
_COLUMNS = {"K": "o_orderkey", "C": "o_custkey", "S": "o_orderstatus", "P": "o_totalprice", "R": "o_orderpriority"}


def _spelled(template: str) -> str:
    """A template as SQL that both engines read alike: pieces of text, quotes and backslashes by number, and columns."""
    pieces = [p for p in re.split(r"(['\"\\]|\{[KCSPR]\})", template) if p]
    return " || ".join(_COLUMNS[p[1]] if re.fullmatch(r"\{[KCSPR]\}", p) else f"chr({ord(p)})" if p in "'\"\\" else f"'{p}'" for p in pieces) or "''"


def _given(pattern: str, value: int, wrong: int, glue: str) -> str:
    """SQL for a call's arguments: all of them, or without the first, with one that the tool lacks, or with a wrong first one."""
    tools = []
    for _, given in SHAPES:
        whole = [pattern % (a[0], a[value]) for a in given]
        odd = {1: whole[1:], 2: [*whole, pattern % ("zz", "1")], 3: [pattern % (given[0][0], given[0][wrong]), *whole[1:]]}
        tools.append("CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN {_spelled(glue.join(v))}" for k, v in odd.items()) + f" ELSE {_spelled(glue.join(whole))} END")
    return "(CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(tools)) + " END)"


CALL_NAME = "(CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(SHAPES)) + " END)"
CALL_FIRST = "(CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{given[0][0]}'" for k, (_, given) in enumerate(SHAPES)) + " END)"
CALL_JSON, CALL_PYTHON, CALL_SHOWN = _given('"%s":%s', 2, 5, ","), _given("%s=%s", 3, 5, ", "), _given("%s=%s", 4, 6, ", ")
_OBJECT = f"{_spelled(chr(123) + chr(34) + 'name' + chr(34) + ':' + chr(34))} || {CALL_NAME} || {_spelled(chr(34) + ',' + chr(34) + 'arguments' + chr(34) + ':' + chr(123))} || {CALL_JSON} || '}}}}'"
_SPACED = f"{_spelled('  { ' + chr(34) + 'name' + chr(34) + ' : ' + chr(34))} || {CALL_NAME} || {_spelled(chr(34) + ', ' + chr(34) + 'parameters' + chr(34) + ' : { ')} || {CALL_JSON} || ' }}}} '"
CALL_CANONICAL = f"'<TOOLCALL>' || {_OBJECT} || '</TOOLCALL>'"
#: A call as a text, in one of six syntaxes by o_orderkey % 6.
CALL_TEXT = (
    f"CASE o_orderkey % 6 WHEN 0 THEN {CALL_CANONICAL} WHEN 1 THEN {_SPACED} WHEN 2 THEN '[' || {_OBJECT} || ']'"
    f" WHEN 3 THEN ' ' || {CALL_NAME} || '(' || {CALL_PYTHON} || ') ' WHEN 4 THEN 'So: <TOOLCALL> [' || {_OBJECT} || '] </TOOLCALL> done' ELSE {_OBJECT} || ' and so on' END"
)


def shots(spark: SparkSession, sf_dir: str, n: int = 2) -> list[dict]:
    """The first n conversations as worked examples, whose answers are a tagged call and a text in turn."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).orderBy("conv_id").limit(n).collect()
    calls = ['<TOOLCALL>{"name": "lookup", "arguments": {"id": %d}}</TOOLCALL>', " Which one is %d? "]
    return [{"question": r["question"], "tools": TOOLS, "answer": calls[k % 2] % r["conv_id"]} for k, r in enumerate(first)]


def varied_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text): a call made of each order, of five tools with arguments of all types, in six syntaxes, some of them
    invalid in one of three ways."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(CALL_TEXT).alias("text"))


# --- the same in SQL ---------------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, {quoted(STRIP)}, '', 'g')"


def sql_payload(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {quoted(PAYLOAD)}) THEN {sql_strip(f'regexp_extract({c}, {quoted(PAYLOAD)}, 1)')} ELSE {sql_strip(c)} END"


def sql_marker(c: str) -> str:
    p = f"({sql_payload(c)})"
    return f"(contains({c}, '<TOOLCALL>') OR starts_with({p}, '{{') OR starts_with({p}, '['))"


def sql_refuses(c: str) -> str:
    return f"regexp_matches(lower({c}), {quoted(worded(REFUSALS))})"


def sql_asks(c: str) -> str:
    low = sql_strip(f"lower({c})")
    return f"(NOT {sql_marker(low)} AND NOT {sql_refuses(low)} AND (ends_with({low}, '?') OR regexp_matches({low}, {quoted(worded(REQUESTS))})))"


def sql_class(c: str) -> str:
    return f"CASE WHEN {sql_marker(c)} THEN 'tool_call' WHEN {sql_refuses(c)} THEN 'cannot_answer' WHEN {sql_asks(c)} THEN 'request_for_info' ELSE 'other_plain_text' END"


LABEL_LIST = "['direct', 'tool_call', 'request_for_info', 'cannot_answer']"
CTE = {
    "last_turns": "SELECT conv_id, arg_max(text, turn) AS text, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id",
    "responses": """SELECT conv_id, CASE conv_id % 8 WHEN 0 THEN text || ' Could you please specify the date?' WHEN 1 THEN 'I am sorry, ' || text
        WHEN 2 THEN '<TOOLCALL>{"name":"lookup","arguments":{"id":' || conv_id || '}}</TOOLCALL>' WHEN 3 THEN '[{"name":"lookup","arguments":{}}]'
        WHEN 4 THEN '{"name":"nope","arguments":{}}' WHEN 5 THEN text WHEN 6 THEN '   ' ELSE 'lookup(id=' || conv_id || ')' END AS response FROM last_turns""",
    "preference_pairs": """SELECT a.conv_id, a.response AS chosen, coalesce(b.response, (SELECT response FROM responses WHERE conv_id = 0)) AS rejected
        FROM responses a LEFT JOIN responses b ON b.conv_id = a.conv_id + 1""",
    "judge_outputs": r"""SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN E'Verdict: NO_ISSUES\nPrimary Issue: none\nCritique: No issues' WHEN 1 THEN E'Verdict: ISSUES\nPrimary Issue: wrong_tool\nCritique: ' || text
        WHEN 2 THEN E'Verdict: ISSUES\nPrimary Issue: something_else\nCritique: x' WHEN 3 THEN E'Primary Issue: none\nCritique: x' WHEN 4 THEN ''
        ELSE E'verdict: issues\nprimary issue: bad_tool_call_format\ncritique: y' END AS critique_text,
        CASE conv_id % 6 WHEN 0 THEN E'Winner: A\nReason: ' || text WHEN 1 THEN E'winner: b\nreason: z' WHEN 2 THEN E'Winner: C\nReason: q' WHEN 3 THEN 'Reason: only' WHEN 4 THEN '' ELSE 'Winner: A' END AS preference_text FROM last_turns""",
    "messages": "SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id",
    "eval_samples": f"SELECT event_id AS uuid, event_type AS run_key, {LABEL_LIST}[1 + (1 + user_id % 3)] AS gold, {LABEL_LIST}[1 + event_id % 4] AS pred_raw, {LABEL_LIST}[1 + (event_id + user_id) % 4] AS pred_norm FROM events",
    "probe_preds": f"SELECT event_id AS uuid, event_type AS run_key, {LABEL_LIST}[1 + (1 + user_id % 3)] AS gold, {LABEL_LIST}[1 + (1 + event_id % 3)] AS probe FROM events",
    "label_dim": "SELECT unnest(['direct', 'tool_call', 'request_for_info', 'cannot_answer']) AS label, unnest([0, 1, 2, 3]) AS k",
    "choice_scores": "SELECT event_id AS uuid, label, ((event_id * 31 + 17 * (k + 1)) % 97)::DOUBLE AS score, repeat('x', (5 + k)::INT) AS text FROM events, label_dim",
    "long_samples": "SELECT uuid, run_key, gold, 'raw' AS scoring, pred_raw AS pred FROM eval_samples UNION ALL SELECT uuid, run_key, gold, 'normalized', pred_norm FROM eval_samples",
    "per_label": """SELECT r.run_key, r.scoring, d.label, d.k, count(*) FILTER (gold = d.label AND pred = d.label) AS tp, count(*) FILTER (pred = d.label) AS p, count(*) FILTER (gold = d.label) AS g,
        count(*) AS n, count(*) FILTER (gold = pred) AS hit FROM long_samples r, label_dim d GROUP BY ALL""",
    "f1s": "SELECT *, CASE WHEN p + g > 0 THEN 2 * tp / (p + g) ELSE 0.0 END AS f1 FROM per_label",
    "summaries": """SELECT run_key, scoring, max(n)::BIGINT AS n_examples, max(hit) / max(n) AS accuracy,
        (max(f1) FILTER (k = 0) + max(f1) FILTER (k = 1) + max(f1) FILTER (k = 2) + max(f1) FILTER (k = 3)) / 4 AS macro_f1 FROM f1s GROUP BY run_key, scoring""",
    "run_metrics": """SELECT run_key, 'middle' AS layer_tag, 0 AS position, accuracy, macro_f1, false AS is_placeholder FROM summaries WHERE scoring = 'raw'
        UNION ALL SELECT run_key, 'layer_75pct', 1, accuracy, macro_f1, false FROM summaries WHERE scoring = 'normalized'
        UNION ALL SELECT run_key, 'last', 2, accuracy, macro_f1 + 0.125, false FROM summaries WHERE scoring = 'normalized'""",
}
NEEDS = {
    "responses": ["last_turns"],
    "preference_pairs": ["responses"],
    "judge_outputs": ["last_turns"],
    "choice_scores": ["label_dim"],
    "long_samples": ["eval_samples"],
    "per_label": ["long_samples", "label_dim"],
    "f1s": ["per_label"],
    "summaries": ["f1s"],
    "run_metrics": ["summaries"],
}


def with_tables(*names: str) -> str:
    """A WITH clause for derived tables and what they are made from."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n"
