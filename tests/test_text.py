"""Text, tool call, judge and metadata functions against tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from heddle.functions import judge, metadata, prompts, text, toolcall

CASES = {
    None: "other_plain_text",
    "": "other_plain_text",
    " \t\n\x1c": "other_plain_text",
    "I am SORRY": "cannot_answer",
    "sorryé": "other_plain_text",
    "whiché one": "other_plain_text",
    "Tell me which": "request_for_info",
    "Is it so? ": "request_for_info",
    "can’t do": "other_plain_text",
    "I can't do": "cannot_answer",
    "<TOOLCALL>open": "tool_call",
    "<TOOLCALL> {} </TOOLCALL>": "tool_call",
    " [1]": "tool_call",
    "plain": "other_plain_text",
}


def test_classes(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", text.response_class(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == CASES


def test_payload_and_flags(spark):
    rows = [("a <TOOLCALL>\n{x}\n</TOOLCALL> b <TOOLCALL>y</TOOLCALL>",), (" none ",), ("<TOOLCALL></TOOLCALL>",)]
    x = spark.createDataFrame(rows, "t string").select(text.payload(F.col("t")).alias("p"), text.payload(F.col("t"), "null").alias("q"), text.asks(F.lit("<TOOLCALL>which")).alias("a")).collect()
    assert [(r["p"], r["q"]) for r in x] == [("{x}", "{x}"), ("none", None), ("", "")] and x[0]["a"]


@pytest.mark.parametrize(
    ("said", "call"),
    [
        ('{"name":"f","arguments":{"a":1.0}}', {"name": "f", "arguments": {"a": 1.0}}),
        ('<TOOLCALL>[{"name":"f","parameters":null}]</TOOLCALL>', {"name": "f", "arguments": {}}),
        ('[TOOLCALL] {"name":"f"}', {"name": "f", "arguments": {}}),
        ('{"name":"f","name":"g"} and more', {"name": "g", "arguments": {}}),
        ("f(a=true, b=[1, 2], c=x, d=None)", {"name": "f", "arguments": {"a": True, "b": [1, 2], "c": "x", "d": None}}),
        ("[f(a='x')]", {"name": "f", "arguments": {"a": "x"}}),
        ("f(1)", None),
        ("a.b(x=1)", None),
        ("[f(a=1), g(b=2)]", None),
        ('[{"name":"f"},{"name":"g"}]', None),
        ('{"arguments":{}}', None),
        ("plain words", None),
        (None, None),
    ],
)
def test_parse(said, call):
    assert toolcall.parse(said) == call


TOOL = {"name": "f", "parameters": {"properties": {"n": {"type": "int"}, "s": {"type": "string"}, "b": {"type": "boolean"}, "u": {"type": "what"}}}, "required": ["n"]}


@pytest.mark.parametrize(
    ("said", "reason"),
    [
        ("f(n=1)", None),
        ("f(n='5')", None),
        ("f(n=True)", "bad_argument_type:n"),
        ("f(s='x')", "missing_required:n"),
        ("f(n=1, z=2, y=3)", "unsupported_arguments:z,y"),
        ("f(n=1, s=2)", "bad_argument_type:s"),
        ("f(n=1, b='TRUE', u=[1])", None),
        ("g(n=1)", "unknown_tool"),
        ("hello", "not_single_tool_call"),
    ],
)
def test_validation(said, reason):
    assert toolcall.fault(toolcall.parse(said), toolcall.tools_of([json.dumps(TOOL)])) == reason


def test_candidates(spark):
    said = ["f(n=1)", '{"name":"f"}', "just text", " ", "could you say?"]
    x = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").select("i", toolcall.candidate(F.col("t"), F.lit(json.dumps([TOOL]))).alias("c")).orderBy("i").collect()
    assert [r["c"]["structural_kind"] for r in x] == ["valid_tool_call", "invalid_tool_call", "plain_text", "empty", "plain_text"]
    assert [r["c"]["score"] for r in x] == [2, 0, 1, 0, 1] and x[0]["c"]["canonical"] == '<TOOLCALL>{"name":"f","arguments":{"n":1}}</TOOLCALL>'
    assert x[4]["c"]["class"] == "request_for_info" and x[3]["c"]["reason"] == "empty_response"


def test_rendering():
    call = '<TOOLCALL>[{"name":"f","arguments":{"a":"it\'s","b":true,"c":null,"d":1.5}}]</TOOLCALL>'
    assert toolcall.render(call, "llama") == '[f(a="it\'s", b=True, c=None, d=1.5)]'
    assert toolcall.render(call, "gemma") == '{"name": "f", "arguments": {"a": "it\'s", "b": true, "c": null, "d": 1.5}}'
    assert toolcall.render(" text ", "llama") == "text"
    with pytest.raises(ValueError):
        toolcall.render(call, "other")


def test_judges(spark):
    said = ["Verdict: no_issues\nPrimary Issue: none\nCritique: ok\nmore", "Verdict: ISSUES\nPrimary Issue: none\nCritique: x", "Critique: only", "", None]
    x = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").withColumn("c", judge.critique(F.col("t")))
    rows = x.select("i", "c.valid", "c.critique", judge.missing_fields(F.col("c")).alias("m"), judge.fallback_critique(F.array("t"), F.array("c")).alias("f")).orderBy("i").collect()
    assert [r["valid"] for r in rows] == [True, False, False, False, False] and rows[0]["critique"] == "ok\nmore"
    assert [r["m"] for r in rows[:4]] == [[], ["Primary Issue"], ["Verdict", "Primary Issue"], ["Verdict", "Primary Issue", "Critique"]]
    assert "Attempt 1 raw critique:\nCritique: only" in rows[2]["f"] and rows[3]["f"].endswith("response correctly.")


def test_layers_latex_and_names(spark):
    x = spark.range(1).select(metadata.layers(F.lit(28)).alias("a"), metadata.layers(F.lit(1)).alias("b"), text.latex(F.lit("a_b\\{")).alias("l"), metadata.redacted(F.lit("k")).alias("r"), metadata.decimals(F.lit(-0.25), signed=True, bold=F.lit(True)).alias("d")).first()
    assert [r["transformer_layer"] for r in x["a"]] == [14, 21, 28] and len(x["b"]) == 1
    assert x["l"] == "a\\_b\\textbackslash\\{\\}\\{" and x["r"] == "[REDACTED]" and x["d"] == "\\textbf{-0.250}"
    assert text.slug("a/b", None, "c") == "a__b__c"


def test_prompts_want_a_user_first(spark):
    rows = spark.createDataFrame([([("assistant", "x")],)], "m array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="user"):
        rows.select(prompts.training_prompt("llama", F.lit("[]"), F.col("m"))).collect()
    with pytest.raises(ValueError):
        prompts.chat("unknown", F.lit("x"))
