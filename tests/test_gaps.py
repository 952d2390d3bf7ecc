"""Sources, sinks, prompts, calls and stages that no query shows whole."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import metadata, text, toolcall
from heddle.operators import encoding, joins, metrics, probe, records, report, sampling
from heddle.plans import stages
from heddle.sources import rows as sources
from heddle.sources import sinks
from heddle.streaming import resume

ROW = T.StructType([T.StructField("a", T.LongType())])
LABELS = ("direct", "tool_call", "request_for_info", "cannot_answer")


#: Published confusion matrices (gold by prediction, in order of LABELS) with their accuracy and macro F1.
PUBLISHED = (
    ([[0, 0, 0, 0], [291, 451, 358, 195], [201, 354, 333, 174], [310, 305, 427, 253]], 0.2839539978094195, 0.2361276642869872),
    ([[0, 0, 0, 0], [347, 431, 284, 233], [245, 346, 271, 200], [410, 295, 293, 297]], 0.2735487404162103, 0.2353192567081843),
    ([[0, 0, 0, 0], [1, 1291, 1, 2], [7, 1025, 27, 3], [76, 1011, 148, 60]], 0.3773274917853231, 0.17262166514732538),
    ([[0, 0, 0, 0], [14, 1268, 8, 5], [32, 880, 108, 42], [399, 403, 150, 343]], 0.4707009857612267, 0.30728965989643126),
)


def test_published_matrices_give_the_published_scores(spark):
    rows = [(k, LABELS[i], LABELS[j], n) for k, (matrix, _, _) in enumerate(PUBLISHED) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    out = metrics.summary(spark.createDataFrame(rows, "run int, gold string, pred string, n long"), "run", LABELS).collect()
    assert len(out) == len(PUBLISHED)
    for r in out:
        assert (r["accuracy"], r["macro_f1"]) == pytest.approx(PUBLISHED[r["run"]][1:], abs=1e-12)


def test_files_in_order_of_arguments(spark, tmp_path):
    for name, values in (("b.jsonl", [5, 6, 7]), ("a.x.jsonl", [1])):
        (tmp_path / name).write_text("".join(f'{{"a": {v}}}\n' for v in values))
    out = sources.json_files(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.x.jsonl")], ROW).orderBy("file_order", "source_row_index").collect()
    assert [(r["example_id"], r["a"]) for r in out] == [("b:00000", 5), ("b:00001", 6), ("b:00002", 7), ("a.x:00000", 1)]


def test_ordinals_over_many_partitions(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.json(str(tmp_path / "n"))
    out = sources.numbered(spark.read.schema("id long").json(str(tmp_path / "n")))
    assert sorted(r["source_row_index"] for r in out.collect()) == list(range(1000)) and out.columns == ["id", "source_row_index"]
    part = sources.numbered(spark.range(0, 100, 1, 4))
    assert part.where("id <> source_row_index").isEmpty()
    assert sources.numbered(spark.range(0)).isEmpty()


def test_small_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a {{B}}\n\nc\n")
    path = str(tmp_path / "t.txt")
    assert sources.template(spark, path) == "a {{B}}\n\nc\n" and sources.line_count(spark, path) == 2
    assert sources.has_rows(spark, path, 2) and not sources.has_rows(spark, path, exactly=3) and not sources.has_rows(spark, path + "x")
    (tmp_path / "s.json").write_text(json.dumps([{"id": k, "category": "c", "question": f"q{k}", "tools": "[]", "answer": "a"} for k in "xyz"]))
    assert [r["question"] for r in sources.few_shots(spark, str(tmp_path / "s.json"), 2)] == ["qx", "qy"] and sources.few_shots(spark, "none", 0) == []
    with pytest.raises(ValueError, match="4 examples"):
        sources.few_shots(spark, str(tmp_path / "s.json"), 4)
    docs = sources.json_documents(spark, str(tmp_path / "s.json"), T.StructType([T.StructField("id", T.StringType())]))
    assert docs.count() == 3 and docs.first()["path"].endswith("s.json")
    assert [r[0] for r in sources.sliced(spark.range(10), "id", 4, 2).collect()] == [4, 5]


def test_features_and_models_come_back(spark, tmp_path):
    x = spark.createDataFrame([(f"e{k}", [float(k % 2), float(k)], k % 2) for k in range(40)], "example_id string, features array<double>, label_id long")
    sinks.write_features(x.withColumn("layer_tag", F.lit("middle")), str(tmp_path / "f"))
    back = sources.features(spark, str(tmp_path / "f"))
    assert {r["layer_tag"] for r in back.collect()} == {"middle"} and back.first()["hidden_state_index"] == -1
    model, _, _ = probe.fit(x, penalties=(1.0,))
    sinks.write_model(model, str(tmp_path / "m"))
    again = probe.predict(sinks.read_model(str(tmp_path / "m")), x).select("example_id", "prediction").collect()
    assert set(again) == set(probe.predict(model, x).select("example_id", "prediction").collect())
    sinks.write_preview(x.withColumn("n", F.substring("example_id", 2, 9).cast("int")), "n", str(tmp_path / "p"), 3)
    assert {r["example_id"] for r in spark.read.json(str(tmp_path / "p")).collect()} == {"e0", "e1", "e2"}


def test_attempts_end_when_answers_differ(spark):
    rows = spark.createDataFrame([("x", 0, "p"), ("y", 1, "q")], "example_id string, source_row_index long, prompt string")
    answers = lambda prompts, seed: ["same" if p == "q" or seed < 2 * stages.ROUND else "other" for p in prompts]
    made = stages.generated_attempts(rows, answers, seed=0)
    out = made.collect()
    assert sorted((r["example_id"], r["attempt"]) for r in out) == [("x", 0), ("x", 1), ("x", 2), *[("y", k) for k in range(6)]]
    pairs = {r["example_id"]: r for r in records.response_pairs(spark.createDataFrame(out, made.schema)).collect()}
    assert (pairs["x"]["response_a"], pairs["x"]["response_b"], pairs["x"]["sampling_attempts"]) == ("same", "other", 3)
    assert (pairs["y"]["response_a"], pairs["y"]["response_b"], pairs["y"]["distinct_candidates_found"]) == ("same", "same", 1)


def test_missing_tables_are_made_once(spark, tmp_path):
    made = []
    make = lambda s: made.append(1) or s.range(3)
    assert [stages.ensured(spark, str(tmp_path / "t"), make).count() for _ in range(2)] == [3, 3] and made == [1]
    source = spark.createDataFrame([(str(k), k) for k in (3, 1, 2)], "example_id string, source_row_index long")
    out = stages.resumed(source, source.where("source_row_index = 2"), lambda x: x)
    assert [r["source_row_index"] for r in out.collect()] == [1, 2, 3]
    assert stages.Options.parsed({"TEMPERATURE": "0.7", "START_INDEX": "2"}).settings == {"TEMPERATURE": 0.7}


def test_checks_raise(spark):
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "label string, n long")
    with pytest.raises(ValueError, match="1 to 2"):
        sampling.check_even(x, "label")
    assert sampling.check_even(x.where("n > 1"), "label") == 1
    with pytest.raises(ValueError, match="evenly"):
        sampling.smoke(x, "label", "n", 4)
    probes = spark.createDataFrame([("u", "r", "a", "b")], "uuid string, run_key string, gold string, probe string")
    samples = spark.createDataFrame([("v", "a", "a", "a")], "uuid string, gold string, pred_raw string, pred_norm string")
    with pytest.raises(joins.IntegrityError):
        joins.overlap(joins.compared(probes, samples))
    scores = spark.createDataFrame([("u", "direct", 1.0, ""), ("u", "tool_call", 0.5, "x")], "uuid string, label string, score double, text string")
    assert metrics.best_choice(scores, "uuid", LABELS).first()["pred_norm"] == "tool_call"


@pytest.mark.parametrize(
    ("value", "want"),
    [((1, [2, (3,)]), [1, [2, [3]]]), ({1: {True: None}}, {"1": {"True": None}}), ({"b", "a"}, ["a", "b"]), (b"x", "b'x'"), (1 + 2j, "(1+2j)"), ({(1, 2): {3}}, {"(1, 2)": [3]}), (True, True)],
)
def test_values_that_json_can_hold(value, want):
    out = toolcall.plain(value)
    assert out == want and json.dumps(out) and type(out) is type(want)


def test_reasons_come_in_order():
    tools = toolcall.tools_of([{"name": "f", "parameters": {"properties": {"a": {"type": "int"}, "b": {"type": "str"}}}, "required": ["a", "b"]}, {"name": "g"}, {"name": "h", "parameters": {"properties": {"a": {"type": ["int"]}}}}])
    call = lambda name, **arguments: toolcall.fault({"name": name, "arguments": arguments}, tools)
    assert (call("x"), call("f"), call("f", a=1, b="", c=2), call("f", a="q", b=3), call("f", a=1, b="z"), call("g", z=1)) == ("unknown_tool", "missing_required:a,b", "unsupported_arguments:c", "bad_argument_type:a", None, None)
    assert toolcall.fault(None, tools) == "not_single_tool_call" and toolcall.fault({"name": "f", "arguments": 3}, tools) == "arguments_not_object" and call("h", a=1) == "tool_validation_error"


def test_renderings_and_settings(spark):
    assert toolcall.render("  plain ", "llama") == "plain" and toolcall.render(" <TOOLCALL>{\"name\": \"f\", \"arguments\": {}}</TOOLCALL>", "llama") == "[f()]"
    assert metadata.layer_count({"x": {"text_config": {"num_hidden_layers": 28}}}) == 28 and metadata.layer_count({"a": 1}) is None
    one = spark.range(1).select(metadata.percent(F.lit(0.4567)).alias("p"), metadata.redacted(F.lit("s")).alias("r"), encoding.zero_types(F.array(F.lit(4), F.lit(5))).alias("z"), text.filled("{{A}}", A=F.lit("x")).alias("t")).first()
    assert (one["p"], one["r"], list(one["z"]), one["t"]) == ("45.7%", "[REDACTED]", [0, 0], "x")


def test_orders(spark):
    rows = [("z", "llama", "Prompting", "Zero-shot"), ("a", "gemma", "CAI", "DPO"), ("b", "llama", "Prompting", "4-shot"), ("c", "other", None, None)]
    x = spark.createDataFrame(rows, "run_key string, model_family string, run_group string, variant_label string")
    ranks = report.with_ranks(x).collect()
    want = [r["run_key"] for r in sorted(ranks, key=lambda r: tuple(r[c] for c in report.RANKS))]
    assert [r["run_key"] for r in report.sorted_runs(x).collect()] == want and want[-1] == "c"
    counted = report.value_counts(spark.createDataFrame([(v,) for v in "bbaac"], "v string"), "v").collect()
    assert [tuple(r) for r in counted] == [("a", 2), ("b", 2), ("c", 1)]


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "x")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in resume.windowed_counts(events).collect()) == [1, 2]
