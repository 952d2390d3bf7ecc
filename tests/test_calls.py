"""Calls read in the JVM against the parser in Python, keys of tools, and choices as families write them."""

import json
import random

from pyspark.sql import functions as F

from heddle.functions import calls, toolcall
from heddle.plans import fixtures


def _value(draw, depth=0):
    kinds = [lambda: draw.choice([0, -1, 7, 10**15 - 1, 10**18, -0.5, 2.25, 1.0, 1e20, 0.001, 1e-7, 12.30]), lambda: draw.choice(["", "a b", "é", 'q"q', "back\\slash", "line\nend", "\t", "a{[,:]}", "</TOOLCALL", "7", " ", "🙂"]), lambda: draw.choice([True, False, None])]
    if depth < 3:
        kinds += [lambda: [_value(draw, depth + 1) for _ in range(draw.randint(0, 3))], lambda: {draw.choice(["a", "b", "é", "name", "x y"]): _value(draw, depth + 1) for _ in range(draw.randint(0, 3))}]
    return draw.choice(kinds)()


def _text(draw):
    """A call in JSON, in some spelling, sometimes broken."""
    call = {"name": draw.choice(["f", "é f", "", 3, 'q"']), draw.choice(["arguments", "arguments", "parameters", "other"]): draw.choice([None, 5, *[{k: _value(draw) for k in draw.sample(["a", "b", "c", "ü"], draw.randint(0, 3))} for _ in range(6)]])}
    if draw.random() < 0.1:
        call["more"] = {}
    if draw.random() < 0.1:
        call = dict(reversed(call.items()))
    body = json.dumps(call, ensure_ascii=draw.random() < 0.3, indent=draw.choice([None, None, 2]), separators=draw.choice([None, (",", ":"), (" , ", " :\t")]))
    body = draw.choice([body, body, f"[{body}]", f" [ {body} ] ", f"{body}, {body}", f"[{body}, {body}]", f"{body} and on", f"{body}}}", body.replace("1", "01", 1), body.replace('"b"', '"a"'), body[:-1], body.replace("0", "-0", 1), body.replace("/", "\\/"), f"[TOOLCALL] {body}"])
    return draw.choice([body, f"<TOOLCALL>{body}</TOOLCALL>", f"so <TOOLCALL>\n{body} </TOOLCALL> and <TOOLCALL>x</TOOLCALL>", f" {body}\n"])


def test_native_calls_equal_parsed_ones(spark):
    draw = random.Random(11)
    texts = [_text(draw) for _ in range(4000)] + [None, "", "  ", "f(a=1)", "[f(a=1)]", "plain", "{}", "[]", "null", "{" * 3000, '{"name":"f","arguments":' + '{"a":' * 300 + "1" + "}" * 301, '{"name":"f","arguments":{"a":"' + "x" * 300_000 + '"}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    native = rows.select("k", calls.native_call(F.col("text")).alias("c"))
    assert "Python" not in native._jdf.queryExecution().toString()
    found = {r["k"]: r["c"] for r in native.collect()}
    settled = 0
    for k, text in enumerate(texts):
        if found[k] is not None:
            want = toolcall.parse(text)
            assert want is not None, text
            assert tuple(found[k]) == (want["name"], json.dumps(want["arguments"], ensure_ascii=False, separators=(",", ":")), toolcall.canonical(text)), text
            settled += 1
    made = sum(toolcall.parse(t) is not None for t in texts)
    assert settled > 0.1 * made and found[len(texts) - 1] is not None
    both = {r["k"]: r["call"] for r in calls.parsed_calls(rows, "text").collect()}
    for k, text in enumerate(texts):
        want = toolcall.parse(text)
        assert (both[k]["name"], both[k]["canonical"]) == (want and want["name"], toolcall.canonical(text))


def test_plain_json_needs_no_python(spark, sf_dir):
    x = fixtures.varied_calls(spark, sf_dir).select("o_orderkey", calls.native_call(F.col("text")).isNotNull().alias("told"))
    by = {r["s"]: r["share"] for r in x.groupBy((F.col("o_orderkey") % 6).alias("s")).agg(F.avg(F.col("told").cast("double")).alias("share")).collect()}
    # Syntaxes 3 and 5 are Python's and JSON with a text behind it; a price that ends in .0 is left to Python.
    assert all(by[k] == 0 for k in (3, 5)) and all(by[k] > 0.95 for k in (0, 1, 2, 4))


def test_keys_of_tools(spark):
    a, b = {"name": "b", "z": [1, {"y": 2.5, "x": None}], "d": "éé"}, {"name": "a"}
    same = [json.dumps([a, b]), json.dumps([b, a], indent=1), json.dumps([{"name": "b", "old": 1}, json.dumps(b), dict(reversed(a.items()))]), json.dumps([a, b, {"no": "name"}, 7, None], ensure_ascii=False)]
    other = [json.dumps([a]), json.dumps([a, {**b, "k": 1}]), "[]", "nope", None, '{"name":"a"}', '[{"name":"a","name":"b"}]']
    out = [r[0] for r in spark.createDataFrame([(t,) for t in same + other], "t string").coalesce(1).select(calls.tools_key(F.col("t"))).collect()]
    assert set(out[: len(same)]) == {'{"a":{"name":"a"},"b":{"d":"éé","name":"b","z":[1,{"x":null,"y":2.5}]}}'}
    assert out[len(same) :] == ['{"b":{"d":"éé","name":"b","z":[1,{"x":null,"y":2.5}]}}', '{"a":{"k":1,"name":"a"},"b":{"d":"éé","name":"b","z":[1,{"x":null,"y":2.5}]}}', "{}", "{}", "{}", "{}", "{}"]


def test_choices_by_label(spark):
    tagged, bare = ' <TOOLCALL> {"name": "f", "arguments": {"a": 1, "b": "x"}} </TOOLCALL> ', ' {"name":"f","parameters":{"a":true}} '
    rows = [("tool_call", tagged), ("tool_call", bare), ("tool_call", " plain "), ("tool_call", '<TOOLCALL>[{"name":"f"},{"name":"g","arguments":{"a":null}}]</TOOLCALL>'), ("tool_call", '<TOOLCALL></TOOLCALL>'), ("cannot_answer", tagged), ("tool_call", '[{"arguments":{}}]'), (None, " x "), ("tool_call", None)]
    want = {
        "llama": ["[f(a=1, b='x')]", "[f(a=True)]", " plain ", "[f(), g(a=None)]", "<TOOLCALL></TOOLCALL>", tagged.strip(), '[{"arguments":{}}]', "x", ""],
        "gemma": ['{"name": "f", "arguments": {"a": 1, "b": "x"}}', bare, " plain ", '[{"name":"f"},{"name":"g","arguments":{"a":null}}]', "", tagged.strip(), '[{"arguments":{}}]', "x", ""],
        "phi": [tagged.strip(), bare.strip(), "plain", rows[3][1], rows[4][1], tagged.strip(), rows[6][1], "x", ""],
    }
    x = spark.createDataFrame(rows, "label string, text string").coalesce(1)
    for family, texts in want.items():
        assert [r[0] for r in x.select(toolcall.converted_choice(F.col("label"), F.col("text"), family)).collect()] == texts
    assert [toolcall.shot_answer(t, "llama") for t in (tagged, " plain ", None)] == ["[f(a=1, b='x')]", "plain", ""] and toolcall.shot_answer(tagged, "gemma") == want["gemma"][0]
