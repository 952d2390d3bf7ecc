"""Joins, samples, metrics, reports, sources and stages."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heddle.operators import encoding, joins, metrics, records, report, sampling
from heddle.plans import stages
from heddle.sources import rows as sources
from heddle.sources import sinks
from heddle.streaming import resume

KEYED = StructType([StructField("example_id", StringType()), StructField("n", LongType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, KEYED)


@pytest.mark.parametrize(("rows", "why"), [([("a", 1)], "no row"), ([("a", 1), ("b", 1), ("b", 2)], "more than one"), ([("a", 1), ("b", 1), ("", 2)], "without"), ([("a", 1), ("b", 1), ("c", 1)], "lacks")])
def test_stage_joins_check_keys(spark, rows, why):
    source = frame(spark, [("a", 0), ("b", 0)])
    with pytest.raises(Exception, match=f"IntegrityError.*{why}"):
        joins.stage_join(source, frame(spark, rows).withColumnRenamed("n", "m")).collect()
    good = joins.stage_join(source, frame(spark, [("b", 2), ("a", 1)]).withColumnRenamed("n", "m"))
    assert {tuple(r) for r in good.collect()} == {("a", 0, 1), ("b", 0, 2)}


def test_resume(spark):
    source, done = frame(spark, [("a", 0), ("b", 1)]), frame(spark, [("a", 0)])
    assert [r[0] for r in joins.pending(source, done, "example_id").collect()] == ["b"]
    with pytest.raises(Exception, match="IntegrityError"):
        joins.pending(done, source, "example_id").collect()
    assert stages.resumed(source, done, lambda x: x.withColumn("n", F.lit(9).cast("long"))).orderBy("example_id").collect()[1]["n"] == 9
    assert joins.latest(frame(spark, [("a", 1), ("a", 3), ("a", 2)]), "example_id", "n").collect()[0]["n"] == 3


def test_samples(spark):
    x = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").otherwise("b").alias("c"))
    places = {(r["c"], r["place"]) for r in sampling.ranked(x, "c", "id", 1).collect()}
    assert places == {("a", k) for k in range(1, 701)} | {("b", k) for k in range(1, 301)}
    halves = sampling.balanced_halves(x, "c", "id", 1).groupBy("c", "half").count().collect()
    assert {r["count"] for r in halves} == {150} and len(halves) == 4
    with pytest.raises(ValueError):
        sampling.sample_each(x, "c", "id", 301, 1)
    with pytest.raises(ValueError):
        sampling.even_total(x, "c", 7)
    split = sampling.fraction_split(x, "id", 0.1, 1, by="c").groupBy("c", "split").count().collect()
    assert {(r["c"], r["split"]): r["count"] for r in split}["a", "eval"] == 70
    pick = random.Random(3)
    picks = {(r["label"], r["place"]): r["ordinal"] for r in sampling.replayed(spark, {"x": 10, "y": 5}, 2, 3).collect()}
    assert picks == {(x, k): v for x, size in (("x", 10), ("y", 5)) for k, v in enumerate(pick.sample(range(size), 2))}


def test_metrics_by_hand(spark):
    rows = [("r", "a", "a"), ("r", "a", "b"), ("r", "b", "b"), ("r", "b", "z"), ("r", "c", None)]
    counted = metrics.cells(spark.createDataFrame(rows, "run string, gold string, pred string"), "run", "gold", "pred")
    s = metrics.summary(counted, "run", ("a", "b", "c")).first()
    assert s["n_examples"] == 5 and s["accuracy"] == 0.4 and s["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    totals = {r["row"]: r for r in metrics.report_totals(counted, "run", ("a", "b", "c")).collect()}
    assert set(totals) == {"micro avg", "macro avg", "weighted avg"} and totals["micro avg"]["precision"] == pytest.approx(2 / 3)
    assert sum(r["n"] for r in metrics.confusion(counted, "run", ("a", "b", "c")).collect()) == 3


def test_published_matrices_give_the_published_scores(spark):
    """Accuracy and macro F1 of a four-label matrix whose first label is never right."""
    matrix = [[0, 0, 0, 0], [285, 1000, 5, 5], [400, 600, 200, 57], [117, 700, 200, 83]]
    names = ("direct", "tool_call", "request_for_info", "cannot_answer")
    rows = [("r", names[i], names[j], n) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    s = metrics.summary(spark.createDataFrame(rows, "run string, gold string, pred string, n long"), "run", names).first()
    total = sum(map(sum, matrix))
    f1 = [2 * matrix[k][k] / (sum(matrix[k]) + sum(r[k] for r in matrix)) for k in range(4)]
    assert s["accuracy"] == pytest.approx(sum(matrix[k][k] for k in range(4)) / total) and s["macro_f1"] == pytest.approx(sum(f1) / 4)


def test_selection_reasons(spark):
    rows = [("p", "x", 0, 0.5, 0.4, False), ("p", "y", 1, 0.5, 0.6, False), ("q", "x", 0, 0.5, 0.5, False), ("q", "y", 1, 0.5, 0.5, False), ("s", "x", 0, 0.9, 0.5, False), ("s", "y", 1, 0.5, 0.5, False), ("t", "x", 0, 0.0, 0.0, True)]
    x = spark.createDataFrame(rows, "parent string, layer_tag string, position int, accuracy double, macro_f1 double, is_placeholder boolean")
    out = {r["parent"]: (r["layer_tag"], r["selection_reason"]) for r in report.selection(x, "parent", "position").where("chosen").collect()}
    assert out == {"p": ("y", "Accuracy tie; higher macro-F1"), "q": ("x", "Tie after accuracy and macro-F1"), "s": ("x", "Highest accuracy"), "t": ("x", report.PENDING)}


def test_encoding(spark):
    x = spark.createDataFrame([([1, 2], [3, 4, 5]), ([], [9])], "p array<int>, t array<int>").select(encoding.encoded(F.col("p"), F.col("t"), 9, 4).alias("e")).select("e.*", F.lit(1).alias("b"))
    rows = encoding.padded(x, "b", 0).collect()
    assert {(tuple(r["input_ids"]), tuple(r["labels"]), tuple(r["attention_mask"])) for r in rows} == {((2, 3, 4, 9)[0:0] + (3, 4, 5, 9), (3, 4, 5, 9), (1, 1, 1, 1)), ((9, 0, 0, 0), (9, -100, -100, -100), (1, 0, 0, 0))}


def test_json_sources(spark, tmp_path):
    good, torn, bad = (str(tmp_path / n) for n in ("good", "torn", "bad"))
    line = json.dumps({"example_id": "a", "n": 1})
    for path, text in ((good, f"{line}\n\n{line}\n"), (torn, f'{line}\n{{"example_id": "b'), (bad, f'{{"x\n{line}\n')):
        with open(path, "w") as f:
            f.write(text)
    assert sources.json_rows(spark, good, KEYED).count() == 2
    assert [r["n"] for r in sources.json_rows(spark, torn, KEYED, torn_end=True).collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017
        sources.json_rows(spark, bad, KEYED).collect()
    with pytest.raises(sources.TornFile):
        sources.json_rows(spark, bad, KEYED, torn_end=True)
    assert [r["source_row_index"] for r in sources.numbered(spark.range(5).toDF("n").coalesce(1)).collect()] == list(range(5))
    with pytest.raises(FileNotFoundError):
        sources.snapshot(spark, str(tmp_path), "x/y")
    made = sources.snapshot(spark, str(tmp_path), "x/y", "c", "train", fallback=lambda s: s.range(3).toDF("n"))
    assert made.count() == 3 and (tmp_path / "x__y__c" / "train").exists()


def test_run_folders_and_sinks(spark, tmp_path):
    for run, files in (("Probe/b", ("summary.json", "run.json")), ("Probe/a", ("summary.json", "run.json")), ("c", ("summary.json",))):
        (tmp_path / "runs" / run).mkdir(parents=True)
        for f in files:
            (tmp_path / "runs" / run / f).write_text("{}")
    found = sources.run_folders(spark, str(tmp_path / "runs"), ("summary.json", "run.json"), ("Probe",)).collect()
    assert [(r["group"], r["run_key"]) for r in found] == [("Probe", "a"), ("Probe", "b")]
    sinks.write_document(spark, {"é": 1}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"é": 1}
    sinks.write_rows(frame(spark, [("a", None)]), str(tmp_path / "o"))
    sinks.write_rows(frame(spark, [("b", 1)]), str(tmp_path / "o"), append=True)
    assert sources.json_rows(spark, str(tmp_path / "o"), KEYED).count() == 2
    sinks.write_latex(spark, frame(spark, [("a", 1)]), ["example_id", "n"], ["Id", "N"], "c", "l", str(tmp_path / "t.tex"))
    assert "a & 1 \\\\" in (tmp_path / "t.tex").read_text()


def test_stages(spark, tmp_path):
    steps = [stages.Step("one", str(tmp_path / "one"), lambda s: s.range(2).toDF("n")), stages.Step("two", str(tmp_path / "two"), lambda s: s.read.parquet(str(tmp_path / "one")))]
    assert stages.run(spark, steps, stages.Options(dry=True)) == [("one", "planned"), ("two", "planned")]
    assert [w for _, w in stages.run(spark, steps)] == ["made", "made"] and [w for _, w in stages.run(spark, steps)] == ["skipped", "skipped"]
    with pytest.raises(ValueError):
        stages.Options(dry=True, smoke=True)
    assert not stages.Options.parsed({"SMOKE": "yes"}).strict_balance
    x = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "source_row_index long, prompt string")
    out = stages.retried(x, stages.stub, "prompt", "said", F.col("said").contains("Here"))
    assert out.count() == 20 and {r["attempts"] for r in out.collect()} == {1, 2}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"example_id": "a", "n": 1}\n')
    go = lambda: resume.stage(spark, str(source), KEYED, lambda x: x.withColumn("m", F.col("n") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (source / "2.json").write_text('{"example_id": "b", "n": 2}\n')
    go()
    go()
    assert {(r["example_id"], r["m"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 4)}
    assert records.example_id is not None
