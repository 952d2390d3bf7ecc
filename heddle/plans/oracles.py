"""DuckDB SQL for the rows of the catalog's queries. Queries that parse Python's syntax, fit a model or generate have none."""

from __future__ import annotations

from ..functions import judge, prompts
from ..functions import metadata as M
from ..functions.text import PAYLOAD
from ..schemas import LABELS, PROBE_LABELS, RESPONSE_CLASSES
from . import fixtures as D
from .fixtures import TOOLS, quoted, sql_asks, sql_class, sql_marker, sql_payload, sql_refuses, sql_strip, with_tables
from .queries import JUDGE_TEMPLATE, REVISED, RUNS, SEED, SPELLINGS, TEMPLATE
from .stages import STUB

PERCENT = "round_even(100.0::DOUBLE * {n} / {all} * 100, 0) / 100"


def _cap(c: str) -> str:
    return f"(upper(substr({c}, 1, 1)) || lower(substr({c}, 2)))"


def _conversation(m: str) -> str:
    """A list of messages, as lines."""
    return f"array_to_string([CASE WHEN coalesce(x.role, '') = '' THEN 'Unknown' ELSE {_cap('x.role')} END || ': ' || {sql_strip('x.content')} FOR x IN {m}], chr(10))"


ANSWERED = "messages[-1].role = 'assistant'"
CONTEXT = "messages[1:len(messages) - 1]"
UNANSWERED = f"(CASE WHEN {ANSWERED} THEN {CONTEXT} ELSE messages END)"
_PAIRS = f"pairs AS (SELECT conv_id, chosen, rejected, {sql_class('chosen')} AS chosen_class, {sql_class('rejected')} AS rejected_class FROM preference_pairs)\n"


def _turn(role: str, content: str) -> str:
    return f"'<|start_header_id|>' || {role} || {quoted('<|end_header_id|>' + chr(10))} || {content} || {quoted(chr(10) + '<|eot_id|>' + chr(10))}"


def _training(family: str) -> str:
    first, rest = sql_strip("messages[1].content"), f"messages[2:len(messages) - 1]"
    if family == "llama":
        opening = f"'<|begin_of_text|>' || {_turn(quoted('system'), quoted(prompts.LLAMA_SYSTEM.rstrip()))} || {_turn(quoted('user'), quoted(prompts.LLAMA_TOOLS + TOOLS + chr(10) * 2) + ' || ' + first)}"
        turns = f"array_to_string([{_turn('x.role', sql_strip('x.content'))} FOR x IN {rest}], '')"
        tail = quoted("<|start_header_id|>assistant<|end_header_id|>\n")
    else:
        opening = f"{quoted('<start_of_turn>user' + chr(10) + prompts.GEMMA_USER + chr(10) + 'Functions:' + chr(10) + TOOLS + chr(10) + 'Question:' + chr(10))} || {first} || chr(10)"
        turns = f"array_to_string([{_cap('x.role')} || ':' || chr(10) || {sql_strip('x.content')} || chr(10) FOR x IN {rest}], '')"
        tail = quoted("<end_of_turn>\n<start_of_turn>model\n")
    return with_tables("messages") + f"SELECT conv_id, {opening} || {turns} || {tail} AS prompt, {sql_strip('messages[-1].content')} AS target FROM messages WHERE {ANSWERED} AND messages[1].role = 'user'"


def _fewshot() -> str:
    q = sql_strip("messages[1].content")
    user = f"<|start_header_id|>user<|end_header_id|>\n{prompts.LLAMA_TOOLS}"
    answer = "\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
    of = lambda c, k: f"(SELECT {c} FROM shots WHERE k = {k})"
    llama = quoted(f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{prompts.LLAMA_SYSTEM}<|eot_id|>\n") + "".join(f" || {quoted(user + TOOLS + chr(10) * 2)} || {of('question', k)} || {quoted(answer)} || {of('llama', k)} || {quoted(chr(10) + '<|eot_id|>' + chr(10))}" for k in (1, 2)) + f" || {quoted(user + TOOLS + chr(10) * 2)}"
    gemma = quoted("<start_of_turn>user\n" + prompts.GEMMA_USER) + "".join(f" || {quoted(f'{chr(10)}Example {k}{chr(10)}Functions:{chr(10)}{TOOLS}{chr(10)}Question:{chr(10)}')} || {of('question', k)} || {quoted(chr(10) + 'Answer:' + chr(10))} || {of('gemma', k)} || {quoted(chr(10))}" for k in (1, 2)) + f" || {quoted(chr(10) + 'Functions:' + chr(10) + TOOLS + chr(10) + 'Question:' + chr(10))}"
    shots = f"""shots AS (SELECT k, {q} AS question, CASE k WHEN 1 THEN '[lookup(id=' || conv_id || ')]' ELSE 'Which one is ' || conv_id || '?' END AS llama,
        CASE k WHEN 1 THEN '{{"name": "lookup", "arguments": {{"id": ' || conv_id || '}}}}' ELSE 'Which one is ' || conv_id || '?' END AS gemma FROM (SELECT *, row_number() OVER (ORDER BY conv_id) AS k FROM messages) WHERE k <= 2)"""
    return with_tables("messages").rstrip() + f", {shots} SELECT conv_id, {llama} || {q} || {quoted(answer)} AS llama, {gemma} || {q} || {quoted('<end_of_turn>' + chr(10) + '<start_of_turn>model' + chr(10))} AS gemma FROM messages"


def _template() -> str:
    text = f"replace(replace(replace({quoted(TEMPLATE)}, '{{{{RULES}}}}', 'Call tools when they fit.'), '{{{{REQUEST}}}}', {_conversation(UNANSWERED)}), '{{{{RESPONSE}}}}', {sql_strip('response')})"
    wraps = {"llama": ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n", "\n<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n"), "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"), "qwen": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "phi": ("", "")}
    return with_tables("responses", "messages") + f", t AS (SELECT conv_id, {text} AS t FROM responses JOIN messages USING (conv_id)) SELECT conv_id, " + ", ".join(f"{quoted(a)} || t || {quoted(b)} AS {f}" for f, (a, b) in wraps.items()) + " FROM t"


def _found(c: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {quoted(pattern)}) THEN regexp_extract({c}, {quoted(pattern)}, 1) END"


def _critique_cte() -> str:
    issues = ", ".join(map(quoted, judge.ISSUES))
    return (
        with_tables("judge_outputs")
        + f", raw AS (SELECT conv_id, {sql_strip('critique_text')} AS raw FROM judge_outputs)"
        + f", f AS (SELECT conv_id, raw, upper({_found('raw', judge.VERDICT)}) AS verdict, {sql_strip('(' + _found('raw', judge.ISSUE) + ')')} AS primary_issue, {sql_strip('(' + _found('raw', judge.CRITIQUE) + ')')} AS critique FROM raw)"
        + f", c AS (SELECT *, coalesce(CASE verdict WHEN 'NO_ISSUES' THEN primary_issue = 'none' WHEN 'ISSUES' THEN primary_issue IN ({issues}) ELSE false END AND primary_issue IS NOT NULL AND critique IS NOT NULL, false) AS valid FROM f)"
        + ", m AS (SELECT *, list_filter([CASE WHEN verdict IS NULL THEN 'Verdict' END, CASE WHEN primary_issue IS NULL OR coalesce(verdict = 'NO_ISSUES' AND primary_issue <> 'none', false) OR coalesce(verdict = 'ISSUES' AND NOT valid, false) THEN 'Primary Issue' END,"
        + " CASE WHEN coalesce(critique, '') = '' THEN 'Critique' END], lambda x: x IS NOT NULL) AS missing FROM c)"
    )


def _critique() -> str:
    empty = quoted("Critique parsing failed.\nMissing or invalid fields: Verdict, Primary Issue, Critique.\nUse the constitution to rewrite the response correctly.")
    rest = quoted(".\nUse the constitution and any useful critique content below to rewrite the response correctly.\nAttempt 1 raw critique:\n")
    head = quoted("Critique parsing failed.\nMissing or invalid fields: ")
    return _critique_cte() + f" SELECT conv_id, valid, verdict, primary_issue, critique, array_to_string(missing, ',') AS missing, CASE WHEN valid THEN critique WHEN raw = '' THEN {empty} ELSE {head} || CASE WHEN len(missing) > 0 THEN array_to_string(list_sort(missing), ', ') ELSE 'unknown' END || {rest} || raw END AS effective FROM m"


def _preference(c: str = "preference_text") -> str:
    raw = sql_strip(c)
    winner, reason = f"upper({_found(raw, judge.WINNER)})", sql_strip(f"({_found(raw, judge.REASON)})")
    return f"coalesce({winner} IN ('A', 'B') AND {reason} <> '', false) AS valid, {winner} AS winner, {reason} AS reason"


def _placed(table: str, by: str, key: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{SEED}|' || {key}), {key}) AS place, count(*) OVER (PARTITION BY {by}) AS n FROM {table}"


_LONG = "k AS (SELECT *, run_key || '|' || scoring AS key FROM long_samples)"
_DIV = "CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _div(a: str, b: str) -> str:
    return _DIV.format(a=a, b=b)


def _report() -> str:
    n = len(PROBE_LABELS)
    per = ", ".join(f"count(*) FILTER (gold = '{x}' AND pred_raw = '{x}') AS tp{k}, count(*) FILTER (pred_raw = '{x}') AS p{k}, count(*) FILTER (gold = '{x}') AS g{k}" for k, x in enumerate(PROBE_LABELS))
    inside = ", ".join(map(quoted, PROBE_LABELS))
    pr, rc, f1 = ([_div(*ab) for ab in xs] for xs in ([(f"tp{k}", f"p{k}") for k in range(n)], [(f"tp{k}", f"g{k}") for k in range(n)], [(f"tp{k} * 2", f"p{k} + g{k}") for k in range(n)]))
    plus = lambda xs: "(" + " + ".join(f"({x})" for x in xs) + ")"
    support, hits, guesses = (plus([f"{c}{k}" for k in range(n)]) for c in ("g", "tp", "p"))
    lines = [f"SELECT run_key, '{x}' AS row, {pr[k]} AS precision, {rc[k]} AS recall, {f1[k]} AS f1, g{k} AS support FROM w" for k, x in enumerate(PROBE_LABELS)]
    acc = _div("hit", "n")
    top = [f"CASE WHEN covered THEN {acc} ELSE {m} END" for m in (_div(hits, guesses), _div(hits, support), _div(f"{hits} * 2", f"{guesses} + {support}"))]
    lines.append(f"SELECT run_key, CASE WHEN covered THEN 'accuracy' ELSE 'micro avg' END, {', '.join(top)}, {support} FROM w")
    lines.append(f"SELECT run_key, 'macro avg', {', '.join(f'{plus(x)} / {n}' for x in (pr, rc, f1))}, {support} FROM w")
    lines.append(f"SELECT run_key, 'weighted avg', {', '.join(_div(plus([f'({v}) * g{k}' for k, v in enumerate(x)]), support) for x in (pr, rc, f1))}, {support} FROM w")
    return with_tables("eval_samples") + f", w AS (SELECT run_key, {per}, count(*) FILTER (gold = pred_raw) AS hit, count(*) AS n, bool_and(gold IN ({inside}) AND pred_raw IN ({inside})) AS covered FROM eval_samples GROUP BY run_key) " + " UNION ALL ".join(lines)


def _summary(labels: tuple[str, ...]) -> str:
    f1 = " + ".join("(" + _div(f"2 * count(*) FILTER (gold = '{x}' AND pred_raw = '{x}')", f"(count(*) FILTER (gold = '{x}') + count(*) FILTER (pred_raw = '{x}'))") + ")" for x in labels)
    return with_tables("eval_samples") + f"SELECT run_key, count(*) AS n_examples, count(*) FILTER (gold = pred_raw) / count(*) AS accuracy, ({f1}) / {len(labels)} AS macro_f1 FROM eval_samples GROUP BY run_key"


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(hay, {quoted(w)})" for w in words) + ")"


def _named() -> str:
    rows = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in (k, *r)) + ")" for k, r in enumerate(RUNS))
    group = f"CASE WHEN source IN ('Prompting', 'Post-Training', 'CAI', 'Probe') THEN source WHEN {_any('self_full', '_model_eval')} THEN 'CAI' WHEN {_any('sft_zeroshot_eval', 'dpo_zeroshot_eval')} THEN 'Post-Training' WHEN {_any('probe')} THEN 'Probe' WHEN {_any('4shot', '4-shot', 'zeroshot', 'zero-shot')} THEN 'Prompting' ELSE 'Unknown' END"
    four, zero = f"({_any('4shot', '4-shot')} OR shots = 4)", f"({_any('zeroshot', 'zero-shot')} OR shots = 0)"
    variant = (
        f"CASE run_group WHEN 'CAI' THEN CASE WHEN {_any('dpo_from_sft')} THEN 'DPO (From SFT)' WHEN {_any('dpo_base')} THEN 'DPO (Base)' WHEN {_any('dpo')} THEN 'DPO' WHEN {_any('sft')} THEN 'SFT' ELSE 'Unknown' END"
        f" WHEN 'Post-Training' THEN CASE WHEN {_any('dpo')} THEN 'DPO' WHEN {_any('sft')} THEN 'SFT' ELSE 'Unknown' END WHEN 'Prompting' THEN CASE WHEN {four} THEN '4-shot' WHEN {zero} THEN 'Zero-shot' ELSE shots || '-shot' END"
        f" ELSE CASE WHEN {_any('dpo')} THEN 'DPO' WHEN {_any('sft')} THEN 'SFT' WHEN {four} THEN '4-shot' WHEN shots = 0 THEN 'Zero-shot' ELSE shots || '-shot' END END"
    )
    short = "CASE run_group || '|' || variant_label " + " ".join(f"WHEN {quoted(f'{g}|{v}')} THEN {quoted(s)}" for (g, v), s in M.SHORT_VARIANT.items()) + " ELSE variant_label END"
    fam = "CASE model_family WHEN 'llama' THEN 'Llama' WHEN 'gemma' THEN 'Gemma' ELSE model_family END"
    return (
        f"WITH v(k, run_key, family, model, output_dir, shots, source) AS (VALUES {rows}), ev AS (SELECT DISTINCT event_type, user_id FROM events),"
        f" r AS (SELECT v.run_key || '_' || event_type || '_' || user_id AS run_key, family, model, output_dir || '/' || user_id AS output_dir, shots, source FROM ev JOIN v ON v.k = (length(event_type) + user_id) % {len(RUNS)}),"
        " a AS (SELECT *, lower(run_key || ' ' || family || ' ' || model) AS fh, lower(run_key || ' ' || output_dir || ' ' || model) AS hay FROM r),"
        f" b AS (SELECT *, CASE WHEN contains(fh, 'llama') THEN 'llama' WHEN contains(fh, 'gemma') THEN 'gemma' WHEN family <> '' THEN family ELSE 'unknown' END AS model_family, {group} AS run_group FROM a),"
        f" c AS (SELECT *, {variant} AS variant_label FROM b),"
        f" d AS (SELECT *, {fam} AS fam, {fam} || CASE WHEN run_group IN ('Prompting', 'Post-Training', 'CAI') THEN ' ' || run_group ELSE '' END || ' ' || variant_label AS run_display,"
        f" CASE WHEN model_family IN ('llama', 'gemma') THEN {fam} ELSE {_cap('model_family')} END || ' ' || {short} AS short_display FROM c)"
    )


def _metadata() -> str:
    setting = f"CASE WHEN {_any('4shot', '4-shot')} THEN '4-shot' WHEN {_any('zeroshot', 'zero-shot', 'probe_base')} THEN 'Zero-shot' ELSE 'Unknown' END"
    of = f"CASE WHEN {_any('_sft_probe', 'sft_zeroshot_eval')} THEN 'Post-Training SFT' WHEN {_any('_dpo_probe', 'dpo_zeroshot_eval')} THEN 'Post-Training DPO' WHEN {_any('probe_4shot', '4shot', '4-shot')} OR shots = 4 THEN 'Prompting 4-shot' WHEN {_any('probe_base', 'zeroshot', 'zero-shot')} OR shots = 0 THEN 'Prompting Zero-shot' ELSE 'Unknown source' END"
    # The setting looks at key and folder only; no model name of the list has its words.
    return _named() + f", e AS (SELECT *, {setting} AS setting, {of} AS probe_of FROM d) SELECT run_key, model_family, run_group, variant_label, run_display, short_display, setting, probe_of, fam || ' Probe' || CASE WHEN probe_of = 'Unknown source' THEN CASE WHEN setting = 'Unknown' THEN '' ELSE ' Prompting ' || setting END ELSE ' ' || probe_of END AS probe_display, replace(replace(model, '/', '_'), ':', '_') AS model_slug FROM e"


def _sorted() -> str:
    rank = lambda c, t: f"CASE {c} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in t.items()) + " ELSE 99 END"
    variant = "CASE run_group " + " ".join(f"WHEN {quoted(g)} THEN {rank('variant_label', t)}" for g, t in M.GROUP_VARIANT_RANK.items()) + f" ELSE {rank('variant_label', M.VARIANT_RANK)} END"
    return _named() + f" SELECT run_key, {rank('model_family', M.FAMILY_RANK)} AS family_rank, {rank('run_group', M.GROUP_RANK)} AS run_group_rank, 99 AS probe_source_rank, 99 AS probe_setting_rank, {variant} AS variant_rank FROM d"


_IDS = "i AS (SELECT doc_id, [len(w) FOR w IN string_split(text, ' ')] AS ids FROM documents), e AS (SELECT doc_id, ids[1:5] AS prompt, ids[6:] AS target FROM i), t AS (SELECT doc_id, prompt, CASE WHEN target[-1] = 0 THEN target ELSE list_append(target, 0) END AS target, len(prompt) + len(target) + 1 AS n0 FROM e), u AS (SELECT doc_id, n0, list_concat(prompt, target) AS ids, list_concat([-100 FOR x IN prompt], target) AS labels FROM t), v AS (SELECT doc_id, n0, ids[greatest(len(ids) - 256, 0) + 1:] AS ids, labels[greatest(len(ids) - 256, 0) + 1:] AS labels FROM u)"


def _latex() -> str:
    out = "replace(text, '\\', '\\textbackslash{}')"
    for s in "_&%#${}":
        out = f"replace({out}, '{s}', '\\{s}')"
    return f"SELECT doc_id, {out} AS escaped FROM documents"


def _selection() -> str:
    return with_tables("run_metrics") + """, s AS (SELECT *, dense_rank() OVER (PARTITION BY run_key ORDER BY accuracy DESC) AS accuracy_rank, dense_rank() OVER (PARTITION BY run_key ORDER BY macro_f1 DESC) AS macro_f1_rank,
      row_number() OVER o AS place, lead(accuracy) OVER o AS acc2, lead(macro_f1) OVER o AS f2 FROM run_metrics WINDOW o AS (PARTITION BY run_key ORDER BY accuracy DESC, macro_f1 DESC, position))
    SELECT run_key, layer_tag, position, accuracy, macro_f1, accuracy_rank, macro_f1_rank, place = 1 AS chosen,
      CASE WHEN place <> 1 THEN '' WHEN acc2 IS NULL OR abs(accuracy - acc2) > 1e-12 THEN 'Highest accuracy' WHEN macro_f1 > f2 + 1e-12 THEN 'Accuracy tie; higher macro-F1' ELSE 'Tie after accuracy and macro-F1' END AS selection_reason FROM s"""


_DIRECT = "dr AS (SELECT run_key, scoring, count(*) AS n_examples, count(*) FILTER (pred = 'direct') AS n_direct, count(*) FILTER (pred = 'direct') / greatest(count(*), 1) AS direct_rate FROM long_samples GROUP BY ALL)"
_COMPARED = "cmp AS (SELECT p.*, s.gold AS sample_gold, s.pred_norm, s.uuid IS NOT NULL AS matched FROM probe_preds p LEFT JOIN (SELECT uuid + 7 AS uuid, run_key, gold, pred_raw, pred_norm FROM eval_samples) s ON p.uuid = s.uuid)"
_INSIDE = "(" + ", ".join(map(quoted, PROBE_LABELS)) + ")"
_SPLIT = "CASE WHEN place <= round(n * {share})::BIGINT THEN 'eval' ELSE 'train' END AS split"


#: What is known of the eight kinds of derived responses, by conv_id % 8: the kinds that are calls, and why some aren't valid.
_CALLS = "conv_id % 8 IN (2, 3, 4, 7)"
_EVALUATED = (
    f"ev AS (SELECT conv_id, response, CASE WHEN {_CALLS} THEN 'tool_call' ELSE {sql_class(sql_strip('response'))} END AS class,"
    " CASE conv_id % 8 WHEN 2 THEN 'valid_tool_call' WHEN 7 THEN 'valid_tool_call' WHEN 3 THEN 'invalid_tool_call' WHEN 4 THEN 'invalid_tool_call' WHEN 6 THEN 'empty' ELSE 'plain_text' END AS structural_kind,"
    " conv_id % 8 NOT IN (3, 4, 6) AS valid, CASE conv_id % 8 WHEN 3 THEN 'missing_required:id' WHEN 4 THEN 'unknown_tool' WHEN 6 THEN 'empty_response' END AS reason,"
    " CASE conv_id % 8 WHEN 2 THEN 2 WHEN 7 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 6 THEN 0 ELSE 1 END::INT AS score FROM responses)"
)


def _counted(measure: str, value: str, table: str, where: str = "true") -> str:
    return f"SELECT '{measure}' AS measure, {value} AS value, count(*) AS n FROM {table} WHERE ({where}) AND {value} IS NOT NULL GROUP BY {value}"


def _total(measure: str, n: str, table: str) -> str:
    return f"SELECT '{measure}' AS measure, '' AS value, {n} AS n FROM {table}"


def _judge_prompt(answers: dict[str, str], before: str, after: str) -> str:
    out = quoted(JUDGE_TEMPLATE)
    for name, value in {"CONSTITUTION": "'Call tools when they fit.'", "USER_REQUEST": _conversation(UNANSWERED), "TOOLS": quoted(TOOLS), **{k: sql_strip(v) for k, v in answers.items()}}.items():
        out = f"replace({out}, '{{{{{name}}}}}', {value})"
    return f"{quoted(before)} || {out} || {quoted(after)}"


def _question(m: str) -> str:
    lines = f"array_to_string([{_cap(sql_strip('coalesce(x.role, ' + quoted('user') + ')'))} || ': ' || {sql_strip('x.content')} FOR x IN {m}], chr(10))"
    return f"CASE WHEN len({m}) = 1 AND {m}[1].role = 'user' THEN {sql_strip(f'{m}[1].content')} ELSE {sql_strip(lines)} END"


def _probe_class(c: str) -> str:
    return f"(CASE WHEN {sql_class(c)} IN {_INSIDE} THEN {sql_class(c)} END)"


def _drawn(attempt: str, prompt: str) -> str:
    """Which of the stub's answers a prompt gets in a round."""
    return f"('0x' || substr(md5({attempt} || '|' || {prompt}), 1, 2))::INT % 3"


def _sampled() -> str:
    kinds = ", ".join(map(quoted, (STUB[0], SPELLINGS[0], SPELLINGS[0])))
    return (
        f"WITH g AS (SELECT o_orderkey::VARCHAR AS example_id, k, [{kinds}][1 + {_drawn('k', chr(40) + 'o_orderkey || ' + quoted('|') + ' || o_orderpriority' + chr(41))}] AS form FROM orders, range(6) t(k)),"
        " f AS (SELECT example_id, arg_min(form, k) AS a FROM g GROUP BY example_id), e AS (SELECT example_id, min(k) AS later FROM g JOIN f USING (example_id) WHERE form <> a GROUP BY example_id),"
        " n AS (SELECT example_id, a, coalesce(later, 5) + 1 AS n, later IS NOT NULL AS two FROM f LEFT JOIN e USING (example_id))"
        f" SELECT example_id, n AS sampling_attempts, CASE WHEN two THEN 2 ELSE 1 END::BIGINT AS distinct_candidates_found, a AS response_a, CASE WHEN NOT two THEN a WHEN a = {quoted(STUB[0])} THEN {quoted(SPELLINGS[0])} ELSE {quoted(STUB[0])} END AS response_b,"
        # Plain texts are valid as calls are.
        " n AS n_valid FROM n"
    )


def _varied() -> dict[str, str]:
    kind, first = "o_orderkey % 7", D.CALL_FIRST
    reason = f"CASE {kind} WHEN 1 THEN 'missing_required:' || {first} WHEN 2 THEN 'unsupported_arguments:zz' WHEN 3 THEN 'bad_argument_type:' || {first} END"
    object_ = f"'{{{{' || {D.CALL_JSON} || '}}}}'".replace("{{", "{").replace("}}", "}")
    shown = f"'[' || {D.CALL_NAME} || '(' || {D.CALL_SHOWN} || ')]'"
    payload = f"regexp_extract({D.CALL_TEXT}, '<TOOLCALL>(.*)</TOOLCALL>', 1)"
    return {
        "varied_calls": f"SELECT o_orderkey, {D.CALL_NAME} AS name, {object_} AS arguments, {D.CALL_CANONICAL} AS canonical, {kind} NOT IN (1, 2, 3) AS valid, {reason} AS reason, CASE WHEN {kind} IN (1, 2, 3) THEN 'invalid_tool_call' ELSE 'valid_tool_call' END AS structural_kind FROM orders",
        "choice_conversion": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN trim({D.CALL_TEXT}) WHEN o_orderkey % 6 IN (3, 5) THEN {D.CALL_TEXT} ELSE {shown} END AS llama, CASE WHEN o_orderkey % 4 = 0 THEN trim({D.CALL_TEXT}) WHEN o_orderkey % 6 IN (0, 4) THEN trim({payload}) ELSE {D.CALL_TEXT} END AS gemma FROM orders",
    }


def _policy() -> str:
    whole = _training("llama"), _training("gemma")
    texts = [t.rsplit("SELECT conv_id, ", 1)[1].rsplit(" AS prompt, ", 1)[0].replace("messages[2:len(messages) - 1]", "u[2:]") for t in whole]
    return with_tables("messages").rstrip() + f", w AS (SELECT *, {UNANSWERED} AS u FROM messages) SELECT conv_id, {texts[0]} AS llama, {texts[1]} AS gemma FROM w WHERE messages[1].role = 'user'"


def _four() -> tuple[str, str]:
    head = _critique_cte() + f", responses AS ({D.CTE['responses']}), messages AS ({D.CTE['messages']}), j AS (SELECT *, {sql_class('response')} AS initial_class, len(messages) AS n_messages FROM m JOIN responses USING (conv_id) JOIN messages USING (conv_id)) "
    four = head + f"SELECT conv_id AS source_row_index, n_messages, initial_class, valid, verdict, CASE WHEN coalesce(valid AND verdict = 'NO_ISSUES', false) THEN response ELSE {quoted(REVISED)} END AS revised FROM j"
    return four, head + "SELECT initial_class, verdict, count(*) AS n_rows, sum(n_messages)::BIGINT AS n_messages FROM j GROUP BY ALL"


def _stage_sql() -> dict[str, str]:
    arguments = "CASE conv_id % 8 WHEN 2 THEN '{\"id\":' || conv_id || '}' WHEN 7 THEN '{\"id\":' || conv_id || '}' WHEN 3 THEN '{}' WHEN 4 THEN '{}' END"
    name = "CASE conv_id % 8 WHEN 2 THEN 'lookup' WHEN 3 THEN 'lookup' WHEN 7 THEN 'lookup' WHEN 4 THEN 'nope' END"
    ev = with_tables("responses") + f", {_EVALUATED} "
    pairs = with_tables("preference_pairs", "messages", "judge_outputs")
    key = """'{"book":{"name":"book","price":2.5},"lookup":{"description":"d' || conv_id % 3 || '","name":"lookup","parameters":{"properties":{"id":{"type":"int"}},"type":"dict"},"required":["id"]}}'"""
    first = sql_strip("messages[1].content")
    requests = with_tables("messages") + f", q AS (SELECT conv_id, len(messages) AS n_messages, {first} AS request, {key} AS tools FROM messages) "
    samples = "s AS (SELECT conv_id AS example_id, turn AS attempt, text AS answer FROM conversations), f AS (SELECT example_id, answer, min(attempt) AS first FROM s GROUP BY ALL), d AS (SELECT example_id, list(answer ORDER BY first) AS a FROM f GROUP BY example_id)"
    rp = f"WITH {samples}, rp AS (SELECT s.example_id, count(*) AS sampling_attempts, len(any_value(a))::BIGINT AS distinct_candidates_found, any_value(a)[1] AS response_a, coalesce(any_value(a)[2], arg_max(answer, attempt)) AS response_b FROM s JOIN d USING (example_id) GROUP BY s.example_id) "
    llama, gemma, qwen = ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n", "\n<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n"), ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"), ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")
    used = "conv_id % 6 = 0"
    revised = f"rv AS (SELECT conv_id, {used} AS used, CASE WHEN {used} THEN class ELSE {sql_class(quoted(REVISED))} END AS class, CASE WHEN {used} THEN structural_kind ELSE 'plain_text' END AS structural_kind, CASE WHEN {used} THEN valid ELSE true END AS valid, CASE WHEN {used} THEN reason END AS reason FROM ev)"
    shown = lambda c: f"CASE WHEN starts_with({c}, '<TOOLCALL>') THEN '[lookup(id=' || regexp_extract({c}, ':([0-9]+)', 1) || ')]' ELSE {sql_strip(c)} END"
    union = " UNION ALL ".join
    return {
        "toolcall_parse": with_tables("responses") + f"SELECT conv_id, {name} AS name, {arguments} AS arguments, CASE WHEN {_CALLS} THEN '<TOOLCALL>{{\"name\":\"' || {name} || '\",\"arguments\":' || {arguments} || '}}</TOOLCALL>' ELSE {sql_strip('response')} END AS canonical FROM responses",
        **_varied(),
        "question_render": with_tables("messages").rstrip() + f", u AS (SELECT conv_id, messages, {UNANSWERED} AS m FROM messages) SELECT conv_id, {_question('m')} AS question, {_question('messages[1:1]')} AS opening FROM u",
        "label_audit": with_tables("responses", "messages").rstrip() + f", x AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'tool_call' END AS explicit, CASE WHEN {ANSWERED} THEN {_probe_class('messages[-1].content')} END AS answer, {_probe_class('response')} AS chosen FROM messages JOIN responses USING (conv_id)) SELECT coalesce(explicit, answer, chosen, 'ignored') AS label, count(*) AS n FROM x GROUP BY ALL",
        "record_pools": with_tables("responses", "messages").rstrip()
        + f", p AS (SELECT 'train_sft' AS source_split, {sql_class('messages[-1].content')} AS behavior_class, len(messages) AS n, length(messages[-1].content) AS c FROM messages WHERE {ANSWERED} AND {sql_class('messages[-1].content')} <> 'tool_call'"
        + f" UNION ALL SELECT 'train_pref_chosen', 'tool_call', len(messages) + 1, length(response) FROM messages JOIN responses USING (conv_id) WHERE {sql_class('response')} = 'tool_call') SELECT source_split, behavior_class, count(*) AS n, sum(n)::BIGINT AS n_messages, sum(c)::BIGINT AS n_characters FROM p GROUP BY ALL",
        "label_sets": with_tables("long_samples") + f"SELECT run_key || '|' || scoring AS key, count(DISTINCT pred)::INT AS n_values, count(DISTINCT pred) FILTER (pred IN {_INSIDE}) = 3 AS covers, count(*) FILTER (pred NOT IN {_INSIDE}) = 0 AS within, covers AND within AS same,"
        + f" array_to_string([x FOR x IN list_sort(['tool_call', 'request_for_info', 'cannot_answer']) IF NOT list_contains(list(DISTINCT pred), x)], ',') AS missing FROM long_samples GROUP BY run_key, scoring",
        "sampled_pairs": _sampled(),
        "policy_prompts": _policy(),
        "stage_join_four": _four()[0],
        "stage_join_three": _four()[1],
        "toolcall_validate": ev + "SELECT conv_id, valid, reason FROM ev",
        "candidate_eval": ev + "SELECT conv_id, class, score, structural_kind FROM ev",
        "toolcall_render": with_tables("responses") + f"SELECT conv_id, {shown('response')} AS llama, CASE WHEN conv_id % 8 = 2 THEN '{{\"name\": \"lookup\", \"arguments\": {{\"id\": ' || conv_id || '}}}}' ELSE {sql_strip('response')} END AS gemma FROM responses",
        "rejected_valid_drop": with_tables("preference_pairs") + f", {_PAIRS} SELECT conv_id, chosen_class, rejected_class FROM pairs WHERE NOT (chosen_class = 'request_for_info' AND (starts_with(rejected, '<TOOLCALL>') OR starts_with(rejected, 'lookup(')))",
        "generate_stub_pairs": with_tables("responses")
        + f", g AS (SELECT conv_id::VARCHAR AS example_id, k::INT AS attempt, [{', '.join(map(quoted, STUB))}][1 + {_drawn('k', 'response')}] AS answer FROM responses, range(6) t(k))"
        + ", h AS (SELECT example_id, answer, min(attempt) AS attempt FROM g GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY attempt) AS place FROM h QUALIFY place <= 2",
        "request_keys": requests + "SELECT request, tools, count(*) AS n_rows, min(conv_id) AS first FROM q GROUP BY request, tools",
        "conflicting_requests": requests + "SELECT tools, count(DISTINCT n_messages % 2) AS n_labels, count(*) AS n_rows FROM q GROUP BY tools HAVING n_labels > 1",
        "judge_prompts": pairs
        + f"SELECT conv_id, {_judge_prompt({'ASSISTANT_RESPONSE': 'chosen'}, *llama)} AS critique, {_judge_prompt({'ASSISTANT_RESPONSE': 'chosen', 'CRITIQUE': 'critique_text'}, *gemma)} AS revision, {_judge_prompt({'RESPONSE_A': 'chosen', 'RESPONSE_B': 'rejected'}, *qwen)} AS preference FROM preference_pairs JOIN messages USING (conv_id) JOIN judge_outputs USING (conv_id)",
        "tools_indented": f"SELECT DISTINCT conv_id, '[' || chr(10) || '  {{' || chr(10) || '    \"name\": \"lookup\",' || chr(10) || '    \"id\": ' || conv_id || chr(10) || '  }}' || chr(10) || ']' AS shown, {quoted(TOOLS)} AS passed FROM conversations",
        "preference_examples": _training("llama").replace(f", {sql_strip('messages[-1].content')} AS target FROM messages", f", {shown('chosen')} AS chosen, {shown('rejected')} AS rejected FROM messages JOIN preference_pairs USING (conv_id)").replace("WITH ", with_tables("preference_pairs").rstrip() + ",\n", 1),
        "initial_summary": ev + union([_counted("output_class_counts", "class", "ev"), _counted("structural_kind_counts", "structural_kind", "ev"), _counted("invalid_reason_counts", "reason", "ev", "NOT valid"), _total("valid_rows", "count(*) FILTER (valid)", "ev")]),
        "critique_summary": _critique_cte() + " " + union([_total("final_valid_rows", "count(*) FILTER (valid)", "m"), _total("retry_rows", "count(*) FILTER (NOT valid)", "m"), _total("fallback_rows", "count(*) FILTER (NOT valid)", "m"), _total("invalid_attempt_total", "2 * count(*) FILTER (NOT valid)", "m"), "SELECT 'missing_field_counts', x, 2 * count(*) FROM (SELECT unnest(missing) AS x FROM m WHERE NOT valid) GROUP BY x"]),
        "revision_summary": with_tables("responses") + f", {_EVALUATED}, {revised} " + union([_counted("revision_class_counts", "class", "rv"), _counted("structural_kind_counts", "structural_kind", "rv"), _counted("invalid_reason_counts", "reason", "rv", "NOT valid"), _total("used_original_without_generation_rows", "count(*) FILTER (used)", "rv")]),
        "response_pairs": rp + "SELECT * FROM rp",
        "pair_summary": rp.rstrip() + f", c AS (SELECT *, {sql_class('response_a')} AS class_a, {sql_class('response_b')} AS class_b FROM rp) " + union([_counted("response_a_class_counts", "class_a", "c"), _counted("response_b_class_counts", "class_b", "c"), _total("duplicate_rows", "count(*) FILTER (response_a = response_b)", "c"), _total("resampled_rows", "count(*) FILTER (sampling_attempts > 2)", "c"), _total("max_sampling_attempts", "max(sampling_attempts)", "c")]),
        "export_summary": ev + union([_counted("exported_counts", "CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END", "ev", f"{sql_strip('response')} <> ''"), _counted("revised_structural_kind_counts", "structural_kind", "ev"), _counted("revised_valid_counts", "CASE WHEN valid THEN 'valid' ELSE 'invalid' END", "ev"), _total("empty_revised_rows", f"count(*) FILTER ({sql_strip('response')} = '')", "ev")]),
        "revision_reuse": _critique_cte() + " SELECT conv_id, valid AND verdict = 'NO_ISSUES' AS reused FROM m",
        "restricted_metrics": with_tables("probe_preds", "eval_samples", "label_dim")
        + f", {_COMPARED}, i AS (SELECT run_key, pred_norm AS gold, probe AS pred FROM cmp WHERE matched AND pred_norm IN {_INSIDE}), f AS (SELECT run_key, label, 2 * count(*) FILTER (gold = label AND pred = label) AS t, count(*) FILTER (gold = label) + count(*) FILTER (pred = label) AS b FROM i, label_dim WHERE label IN {_INSIDE} GROUP BY run_key, label)"
        + ", a AS (SELECT run_key, count(*) AS n_examples, count(*) FILTER (gold = pred) / count(*) AS accuracy FROM i GROUP BY run_key) SELECT run_key, any_value(n_examples) AS n_examples, any_value(accuracy) AS accuracy, sum(CASE WHEN b > 0 THEN t / b ELSE 0.0 END) / 3 AS macro_f1 FROM f JOIN a USING (run_key) GROUP BY run_key",
        "last_sample_wins": with_tables("probe_preds", "eval_samples") + "SELECT p.run_key, count(*) AS n, count(*) FILTER (CASE WHEN e.uuid % 3 = 0 THEN 'direct' ELSE e.pred_norm END = 'direct') AS n_direct FROM probe_preds p LEFT JOIN eval_samples e USING (uuid) GROUP BY p.run_key",
        "macro_f1_delta": with_tables("summaries") + "SELECT a.run_key, a.macro_f1 AS raw, b.macro_f1 AS normalized, b.macro_f1 - a.macro_f1 AS macro_f1_delta, printf('%.1f%%', b.macro_f1 * 100) AS percent FROM summaries a JOIN summaries b USING (run_key) WHERE a.scoring = 'raw' AND b.scoring = 'normalized'",
        "pending_panels": with_tables("run_metrics") + "SELECT run_key, 'normalized' AS scoring, unnest(['tool_call', 'request_for_info', 'cannot_answer']) AS label, 0.0::DOUBLE AS accuracy, upper(substr(run_key, 1, 1)) AS panel FROM run_metrics GROUP BY run_key HAVING max(accuracy) < (SELECT avg(accuracy) FROM run_metrics)",
        "value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "smoke_total": "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents QUALIFY place <= 5",
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "class_counts": with_tables("responses") + f", c AS (SELECT {sql_class('response')} AS class FROM responses) SELECT class, count(*) AS n, {PERCENT.format(n='count(*)', all='sum(count(*)) OVER ()')} AS percent FROM c GROUP BY class",
        "class_flags_overview": with_tables("responses") + ", f AS (SELECT " + ", ".join(f"{e} AS f{k}" for k, e in enumerate((sql_marker("response"), sql_refuses("response"), sql_asks("response")))) + " FROM responses) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (f{k}) AS n, {PERCENT.format(n=f'count(*) FILTER (f{k})', all='count(*)')} AS percent FROM f" for k, m in enumerate(("has_marker", "refuses", "asks"))),
        "class_pair_breakdown": with_tables("preference_pairs") + f", {_PAIRS} SELECT chosen_class, rejected_class, count(*) AS n FROM pairs GROUP BY ALL",
        "flag_pair_breakdown": with_tables("responses") + f"SELECT {sql_marker('response')} AS marker, {sql_asks('response')} AS asks, count(*) AS n FROM responses GROUP BY ALL",
        "class_crosstab": with_tables("preference_pairs") + f", {_PAIRS} SELECT chosen_class, " + ", ".join(f"count(*) FILTER (rejected_class = '{x}') AS {x}" for x in RESPONSE_CLASSES) + " FROM pairs GROUP BY chosen_class",
        "first_n_examples": with_tables("responses", "messages") + f", c AS (SELECT conv_id, {sql_class('response')} AS class, substr(array_to_string([x.role || ': ' || replace(x.content, chr(10), ' ') FOR x IN messages], ' | '), 1, 240) AS preview FROM responses JOIN messages USING (conv_id)) SELECT *, row_number() OVER (PARTITION BY class ORDER BY conv_id) AS place FROM c QUALIFY place <= 3",
        "last_assistant_turns": with_tables("messages") + f"SELECT conv_id, messages[-1].content AS answer FROM messages WHERE {ANSWERED}",
        "split_context_target": with_tables("messages") + f"SELECT conv_id, len(messages) - 1 AS n_context, messages[-1].content AS target, len(messages) AS n_again, 'assistant' AS last_role FROM messages WHERE {ANSWERED}",
        "render_conversation": with_tables("messages") + f"SELECT conv_id, {_conversation(UNANSWERED)} AS rendered FROM messages",
        "training_prompt_llama": _training("llama"),
        "training_prompt_gemma": _training("gemma"),
        "eval_prompt_fewshot": _fewshot(),
        "template_render": _template(),
        "payload_extract": with_tables("responses") + f"SELECT conv_id, {sql_payload('response')} AS payload, CASE WHEN regexp_matches(response, {quoted(PAYLOAD)}) THEN {sql_payload('response')} END AS tagged FROM responses",
        "parse_critique": _critique(),
        "parse_preference": with_tables("judge_outputs") + f"SELECT conv_id, {_preference()} FROM judge_outputs",
        "example_ids": "SELECT conv_id, turn, role || ':' || lpad((conv_id * 10 + turn)::VARCHAR, greatest(5, length((conv_id * 10 + turn)::VARCHAR))::INT, '0') AS example_id FROM conversations",
        "label_coalesce": with_tables("preference_pairs")
        + f", {_PAIRS} SELECT conv_id, coalesce(CASE WHEN conv_id % 3 = 0 THEN 'tool_call' END, CASE WHEN chosen_class IN {_INSIDE} THEN chosen_class END, CASE WHEN rejected_class IN {_INSIDE} THEN rejected_class END) AS label, CASE conv_id % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'none' ELSE 'unlisted' END AS plain FROM pairs",
        "conflicting_keys": "SELECT sha256(text) AS key, count(DISTINCT source) AS n_labels, count(*) AS n_rows FROM documents GROUP BY key HAVING count(DISTINCT source) > 1",
        "without_conflicting_keys": "SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)",
        "balanced_sample": f"SELECT o_orderpriority, o_orderkey, place FROM ({_placed('orders', 'o_orderpriority', 'o_orderkey')}) WHERE place <= 50",
        "balanced_half_split": f"WITH p AS ({_placed('orders', 'o_orderpriority', 'o_orderkey')}), t AS (SELECT min(n) - min(n) % 2 AS total FROM p) SELECT o_orderpriority, o_orderkey, CASE WHEN place <= total // 2 THEN 'sft' ELSE 'dpo' END AS half FROM p, t WHERE place <= total",
        "balanced_cap": with_tables("eval_samples") + f", p AS ({_placed('eval_samples', 'gold', 'uuid')}) SELECT uuid, gold FROM p WHERE (SELECT count(*) FROM events) <= 1000 OR gold IN {_INSIDE} AND place <= 333 + CASE WHEN gold = 'tool_call' THEN 1 ELSE 0 END",
        "smoke_subset": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events QUALIFY place <= 8",
        "stratified_dev_split": f"SELECT vec_id, label, {_SPLIT.format(share=0.2)} FROM ({_placed('embeddings', 'label', 'vec_id')})",
        "train_eval_split": f"SELECT doc_id, {_SPLIT.format(share=0.05)} FROM ({_placed('documents', '1', 'doc_id')})",
        "stage_join_ordered": "SELECT o_orderkey AS example_id, o_orderkey AS source_row_index, any_value(o_orderstatus) AS o_orderstatus, max(l_linenumber) AS n_lines, count(*) AS n_rows, min(l_partkey) AS least_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
        "resume_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "stage_summary": _critique_cte() + " SELECT 'n_records' AS field, count(*) AS n FROM m UNION ALL SELECT 'n_valid', count(*) FILTER (valid) FROM m UNION ALL SELECT 'n_invalid', count(*) FILTER (NOT valid) FROM m UNION ALL SELECT 'missing ' || x, count(*) FROM (SELECT unnest(missing) AS x FROM m) GROUP BY x",
        "sft_export": with_tables("responses", "messages") + f"SELECT {quoted(TOOLS)} AS tools, 'fixture' AS source_split, {sql_class('response')} AS behavior_class, len({UNANSWERED}) + 1 AS n_messages, {sql_strip('response')} AS answer FROM responses JOIN messages USING (conv_id) WHERE {sql_strip('response')} <> ''",
        "dpo_export": with_tables("preference_pairs", "judge_outputs")
        + f", x AS (SELECT conv_id, {sql_strip('chosen')} AS a, {sql_strip('rejected')} AS b, {_preference()} FROM preference_pairs JOIN judge_outputs USING (conv_id))"
        + ", y AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 'empty_candidate' WHEN a = b THEN 'duplicate_candidates' WHEN NOT valid THEN 'preference_parse_failed' END AS failure_reason FROM x)"
        + f" SELECT conv_id, failure_reason IS NULL AS valid, failure_reason, CASE WHEN failure_reason IS NULL THEN CASE winner WHEN 'A' THEN a ELSE b END END AS preferred, CASE WHEN failure_reason IS NULL THEN CASE winner WHEN 'A' THEN b ELSE a END END AS rejected, CASE WHEN failure_reason IS NULL THEN CASE winner WHEN 'A' THEN {sql_class('a')} ELSE {sql_class('b')} END END AS chosen_class FROM y",
        "distinct_candidates": "WITH f AS (SELECT conv_id AS example_id, text AS answer, min(turn) AS attempt FROM conversations GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY attempt) AS place FROM f QUALIFY place <= 2",
        "confusion_matrix": with_tables("eval_samples", "label_dim") + "SELECT r.run_key, a.label AS gold, b.label AS pred, count(e.uuid) AS n FROM (SELECT DISTINCT run_key FROM eval_samples) r, label_dim a, label_dim b LEFT JOIN eval_samples e ON e.run_key = r.run_key AND e.gold = a.label AND e.pred_raw = b.label GROUP BY ALL",
        "accuracy_macro_f1": _summary(LABELS),
        "accuracy_macro_f1_three": _summary(PROBE_LABELS),
        "classification_report": _report(),
        "one_vs_rest": with_tables("eval_samples", "label_dim") + "SELECT run_key, label, count(*) FILTER ((gold = label) = (pred_norm = label)) / count(*) AS accuracy, count(*) FILTER (gold = label) AS support FROM eval_samples, label_dim GROUP BY ALL",
        "direct_rate": with_tables("long_samples") + f", {_DIRECT} SELECT * FROM dr",
        "prediction_mix": with_tables("long_samples", "label_dim") + f", {_LONG} SELECT key, label AS value, count(*) FILTER (pred = label) AS n, count(*) FILTER (pred = label) / count(*) AS fraction FROM k, label_dim GROUP BY ALL",
        "norm_outcome": with_tables("eval_samples")
        + ", o AS (SELECT run_key, CASE WHEN pred_raw = gold AND pred_norm = gold THEN 'stay_correct' WHEN pred_norm = gold THEN 'fixed' WHEN pred_raw = gold THEN 'broken' ELSE 'stay_wrong' END AS o FROM eval_samples), v AS (SELECT unnest(['stay_correct', 'fixed', 'broken', 'stay_wrong']) AS value) SELECT run_key, value, count(*) FILTER (o = value) AS n, count(*) FILTER (o = value) / count(*) AS fraction FROM o, v GROUP BY ALL",
        "norm_delta": with_tables("summaries")
        + f", {_DIRECT} SELECT a.run_key, a.accuracy AS raw, b.accuracy AS normalized, c.direct_rate AS direct_raw, d.direct_rate AS direct_normalized, b.accuracy - a.accuracy AS accuracy_delta, d.direct_rate - c.direct_rate AS direct_delta FROM summaries a JOIN summaries b USING (run_key) JOIN dr c USING (run_key) JOIN dr d USING (run_key) WHERE a.scoring = 'raw' AND b.scoring = 'normalized' AND c.scoring = 'raw' AND d.scoring = 'normalized'",
        "agreement": with_tables("probe_preds", "eval_samples")
        + f", {_COMPARED} SELECT run_key, count(*) AS n, count(*) FILTER (pred_norm IN {_INSIDE}) AS n_inside, count(*) FILTER (pred_norm NOT IN {_INSIDE}) AS n_outside, count(*) FILTER (probe = pred_norm) / count(*) AS agreement, count(*) FILTER (probe = pred_norm AND pred_norm IN {_INSIDE}) / count(*) FILTER (pred_norm IN {_INSIDE}) AS agreement_inside FROM cmp WHERE matched GROUP BY run_key",
        "join_audit": with_tables("probe_preds", "eval_samples") + f", {_COMPARED} SELECT count(*) AS n_probe, count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_unmatched, count(*) FILTER (matched AND gold <> sample_gold) AS n_gold_mismatch FROM cmp",
        "latest_sample": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "argmax_choice": with_tables("choice_scores") + ", r AS (SELECT uuid, label, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, length(text)) AS a, row_number() OVER (PARTITION BY uuid ORDER BY score / length(text) DESC, length(text)) AS b FROM choice_scores) SELECT uuid, max(label) FILTER (a = 1) AS pred_raw, max(label) FILTER (b = 1) AS pred_norm FROM r GROUP BY uuid",
        "probe_layer_rank": _selection(),
        "probe_layer_pivot": with_tables("run_metrics")
        + ", w AS (SELECT run_key, max(accuracy) FILTER (layer_tag = 'middle') AS middle, max(accuracy) FILTER (layer_tag = 'layer_75pct') AS layer_75pct, max(accuracy) FILTER (layer_tag = 'last') AS last, bool_and(is_placeholder) AS is_pending FROM run_metrics GROUP BY run_key), b AS (SELECT run_key, layer_tag AS best_layer FROM run_metrics QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY accuracy DESC, macro_f1 DESC, position) = 1) SELECT *, greatest(middle, layer_75pct, last) AS best_accuracy FROM w JOIN b USING (run_key)",
        "best_hparam": with_tables("run_metrics") + "SELECT run_key, layer_tag, macro_f1 FROM run_metrics QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY macro_f1 DESC, position) = 1",
        "sort_runs": _sorted(),
        "unique_displays": with_tables("run_metrics") + ", d AS (SELECT DISTINCT run_key, CASE WHEN length(run_key) % 2 = 0 THEN 'even' ELSE run_key END AS run_display FROM run_metrics) SELECT run_key, CASE WHEN count(*) OVER (PARTITION BY run_display) > 1 THEN run_display || ' (' || run_key || ')' ELSE run_display END AS run_display FROM d",
        "placeholders": with_tables("run_metrics")
        + ", k AS (SELECT DISTINCT run_key || '_next' AS run_key FROM run_metrics), s AS (SELECT unnest(['raw', 'normalized']) AS scoring), c AS (SELECT unnest(['tool_call', 'request_for_info', 'cannot_answer']) AS label) SELECT run_key, 'raw' AS scoring, layer_tag AS label, accuracy, macro_f1, is_placeholder FROM run_metrics UNION ALL SELECT run_key, scoring, label, 0.0, 0.0, true FROM k, s, c",
        "extrema_bold": with_tables("run_metrics")
        + ", b AS (SELECT max(accuracy) FILTER (layer_tag <> 'last') AS a, min(macro_f1) FILTER (layer_tag <> 'last') AS f FROM run_metrics), x AS (SELECT run_key, layer_tag, printf('%.3f', accuracy) AS ac, printf('%+.3f', macro_f1) AS fc, layer_tag <> 'last' AND abs(accuracy - a) <= 1e-12 AS ab, layer_tag <> 'last' AND abs(macro_f1 - f) <= 1e-12 AS fb FROM run_metrics, b) SELECT run_key, layer_tag, CASE WHEN ab THEN '\\textbf{' || ac || '}' ELSE ac END AS accuracy_cell, CASE WHEN fb THEN '\\textbf{' || fc || '}' ELSE fc END AS macro_f1_cell FROM x",
        "run_metadata": _metadata(),
        "latex_escape": _latex(),
        "token_encode": f"WITH {_IDS} SELECT doc_id, len(ids) AS n, list_sum(ids)::BIGINT AS sum_input_ids, list_sum(labels)::BIGINT AS sum_labels, len(ids) AS sum_attention_mask, n0 > 256 AS truncated, least(n0, 256) - 1 AS extracted_index FROM v",
        "pad_batch": f"WITH {_IDS}, g AS (SELECT *, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS longest FROM v) SELECT doc_id, longest AS n, (list_sum(ids) + longest - len(ids))::BIGINT AS sum_input_ids, (list_sum(labels) - 100 * (longest - len(ids)))::BIGINT AS sum_labels, len(ids) AS sum_attention_mask, longest AS n_zero_types FROM g",
        "layer_specs": "WITH n AS (SELECT n_nationkey + 1 AS n_layers FROM nation), l AS (SELECT n_layers, ceil(n_layers * 0.5)::INT AS m, ceil(n_layers * 0.75)::INT AS t, n_layers AS l FROM n) SELECT n_layers, 'middle' AS tag, m AS transformer_layer, m AS hidden_state_index FROM l UNION ALL SELECT n_layers, 'layer_75pct', t, t FROM l WHERE t <> m UNION ALL SELECT n_layers, 'last', l, l FROM l WHERE l <> m AND l <> t",
    }
    routed = f"WITH d AS ({out['dpo_export']}) "
    out["preference_summary"] = routed + " UNION ALL ".join([_counted("valid_counts", "CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END", "d", "valid"), _counted("chosen_class_counts", "chosen_class", "d"), _counted("failure_counts", "failure_reason", "d")])
    return {f"q_{k}": v for k, v in (out | _stage_sql()).items()}
