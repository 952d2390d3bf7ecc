"""Stage joins that check their keys on the way, rounds of attempts, steps that know their inputs, committed parts and shuffles."""

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from heddle.functions import toolcall
from heddle.operators import joins, records, report, sampling
from heddle.plans import queries, stages
from heddle.sources import manifest, sinks
from heddle.sources import rows as sources


def frame(spark, rows, columns="example_id string, n long"):
    return spark.createDataFrame(rows, columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_four_stages_meet_in_one_exchange(spark, tmp_path):
    for k in range(5):
        spark.range(200).select(F.col("id").cast("string").alias("example_id"), (F.col("id") * 10 + k).alias(f"c{k}"), F.lit(k).alias("both")).repartition(3).write.parquet(str(tmp_path / str(k)))
    source, *made = (spark.read.parquet(str(tmp_path / str(k))) for k in range(5))
    seen = Observation("sides")
    out = joins.stage_join(source, *made, names=list("abcd"), seen=seen)
    assert out.columns == ["example_id", "c0", "both", "c1", "c2", "c3", "c4"]
    text = plan(out)
    assert text.count("FileScan") == 5 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    rows = out.collect()
    assert len(rows) == 200 and all((r["c0"] + k == r[f"c{k}"] and r["both"] == 0) for r in rows for k in range(1, 5))
    assert seen.get == {"source": 200, "stage_1": 200, "stage_2": 200, "stage_3": 200, "stage_4": 200}


@pytest.mark.parametrize(("rows", "why"), [([("a", 1)], "second: no row of b"), ([("a", 1), ("b", 1), ("b", 2)], "second: more than one row of b"), ([("a", 1), ("b", 1), ("", 2)], "second: a row without"), ([("a", 1), ("b", 1), (None, 2)], "second: a row without"), ([("a", 1), ("b", 1), ("c", 1)], "second: the source lacks c")])
def test_faults_end_the_action(spark, rows, why):
    source, good = frame(spark, [("a", 0), ("b", 0)]), frame(spark, [("b", 2), ("a", 1)], "example_id string, m long")
    out = joins.stage_join(source, good, frame(spark, rows, "example_id string, k long"), names=["first", "second"])
    for act in (lambda: out.collect(), lambda: out.select("example_id").count(), lambda: out.where("example_id = 'a'").collect()):
        with pytest.raises(Exception, match=f"IntegrityError: {why}"):
            act()


def test_a_source_may_repeat_a_key_and_tables_may_be_empty(spark):
    source, good = frame(spark, [("a", 0), ("a", 1), ("b", 2)]), frame(spark, [("b", 2), ("a", 1)], "example_id string, m long")
    assert {tuple(r) for r in joins.stage_join(source, good).collect()} == {("a", 0, 1), ("a", 1, 1), ("b", 2, 2)}
    assert {tuple(r) for r in joins.stage_join(source, good, checked=False).collect()} == {("a", 0, 1), ("a", 1, 1), ("b", 2, 2)}
    none = good.limit(0)
    assert joins.stage_join(source.limit(0), none).count() == 0
    with pytest.raises(Exception, match="no row of"):
        joins.stage_join(source, none).collect()
    nested = frame(spark, [("a", None), ("b", [1])], "example_id string, x array<int>")
    assert {r["example_id"]: r["x"] for r in joins.stage_join(source, nested).collect()} == {"a": None, "b": [1]}


def test_pending_rows_and_records_that_do_not_belong(spark):
    source = frame(spark, [("a", 0), ("b", 1), ("b", 2), (None, 3)])
    done = frame(spark, [("a", 9)])
    assert sorted(r["n"] for r in joins.pending(source, done, "example_id").collect()) == [1, 2, 3]
    assert sorted(r["n"] for r in joins.pending(source, done, "example_id", checked=False).collect()) == [1, 2, 3]
    for rows, why in (([("z", 1)], "the source lacks z"), ([("a", 1), ("a", 2)], "more than one row of a"), ([("", 1)], "a row without")):
        with pytest.raises(Exception, match=f"IntegrityError: records: {why}"):
            joins.pending(source, frame(spark, rows), "example_id").collect()
    assert plan(joins.pending(source, done, "example_id")).count("Exchange hashpartitioning") == 1


def test_rounds_of_whole_batches(spark):
    sent = spark.sparkContext.accumulator([], _Lists())

    def generator(prompts, seed):
        sent.add([(seed, len(prompts))])
        spelled = ['{"name":"f","arguments":{"a":1}}', '{ "name" : "f", "arguments" : {"a" : 1} }', "[f(a=1)]", "Which one?"]
        rounds = seed // stages.ROUND
        return [spelled[min(rounds, 3)] if p == "late" else spelled[2 if rounds else 3] if p == "soon" else spelled[rounds % 3] for p in prompts]

    rows = [(f"e{k}", k, ("late", "soon", "never")[k % 3]) for k in range(30)]
    x = frame(spark, rows, "example_id string, source_row_index long, prompt string").withColumn("tools", F.lit('[{"name":"f"}]')).coalesce(1)
    out = stages.generated_attempts(x, generator, attempts=5, seed=0, batch=8)
    found = out.collect()
    tries = {e: sum(r["example_id"] == e for r in found) for e, *_ in rows}
    assert {tries[f"e{k}"] for k in range(0, 30, 3)} == {4} and {tries[f"e{k}"] for k in range(1, 30, 3)} == {2} and {tries[f"e{k}"] for k in range(2, 30, 3)} == {5}
    # 30 open prompts in two rounds, 20 in two, 10 in the last: batches of 8.
    assert [n for _, n in sent.value] == [8, 8, 8, 6] * 2 + [8, 8, 4] * 2 + [8, 2] and len({s for s, _ in sent.value}) == len(sent.value)
    assert {(r["canonical"], r["valid"], r["structural_kind"]) for r in found if r["answer"] != "Which one?"} == {('<TOOLCALL>{"name":"f","arguments":{"a":1}}</TOOLCALL>', True, "valid_tool_call")}
    pairs = {r["example_id"]: r for r in records.response_pairs(spark.createDataFrame(found, out.schema).select("example_id", "attempt", F.col("canonical").alias("answer"))).collect()}
    assert pairs["e0"]["response_b"] == "Which one?" and pairs["e2"]["distinct_candidates_found"] == 1 and pairs["e2"]["sampling_attempts"] == 5
    assert stages.generated_attempts(x.limit(0), generator).count() == 0
    odd = frame(spark, [("x", None, None), ("x", None, None)], "example_id string, source_row_index long, prompt string")
    assert stages.generated_attempts(odd, stages.stub, attempts=1).count() == 2


def test_sampled_pairs_draw_once(spark, sf_dir):
    out = queries.CATALOG["q_sampled_pairs"](spark, sf_dir)
    # Pairs and their counts come of one run of the generator.
    assert plan(out).count("MapInArrow") == 1 and plan(out).count("FileScan") == 1
    samples = frame(spark, [("a", 0, "x", True), ("a", 1, "x", False), ("a", 2, "y", True), ("b", 0, "x", None), (None, 0, "x", True)], "example_id string, attempt int, answer string, valid boolean")
    got = {r["example_id"]: tuple(r)[1:] for r in records.response_pairs(samples, n_valid=F.col("valid"), n_first=F.col("attempt") == 0).collect()}
    assert got == {"a": (3, 2, "x", "y", 2, 1), "b": (1, 1, "x", "x", 0, 1), None: (1, 1, "x", "x", 1, 1)}


def test_answers_are_parsed_once(monkeypatch):
    parsed, read = [], toolcall.parse
    monkeypatch.setattr(toolcall, "parse", lambda text: parsed.append(text) or read(text))
    evaluate, spec = toolcall.evaluator(), '[{"name":"f","required":["a"]}]'
    valid = ("f(a=1)", '{"name":"f","arguments":{}}', " plain ", "", None)
    want = [("valid_tool_call", None), ("invalid_tool_call", "missing_required:a"), ("plain_text", None), ("empty", "empty_response"), ("empty", "empty_response")]
    for _ in range(3):
        assert [(e["structural_kind"], e["reason"]) for e in (evaluate(t, spec) for t in valid)] == want
    # A call again in its canonical form; nothing again for texts that come again.
    assert len(parsed) == 7
    assert evaluate("f(a=1)", "[]")["reason"] == toolcall.NO_TOOL and evaluate("f(a=1)", None)["reason"] == toolcall.NO_TOOL
    long = "x" * (toolcall.REMEMBERED_LENGTH + 1)
    del parsed[:]
    assert [evaluate(long, spec)["canonical"] for _ in range(2)] == [long, long] and len(parsed) == 2


class _Lists:
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def test_steps_follow_their_inputs(spark, tmp_path):
    for name in ("in", "other"):
        spark.range(3).write.parquet(str(tmp_path / name))
    path = lambda n: str(tmp_path / n)
    copy = lambda a, k: lambda s: s.read.parquet(path(a)).withColumn("k", F.lit(k))

    def steps(k=1):
        return [
            stages.Step("a", path("a"), copy("in", k), (path("in"),), {"k": k}),
            stages.Step("b", path("b"), copy("a", 0), (path("a"),)),
            stages.Step("c", path("c"), copy("other", 0), (path("other"),)),
            stages.Step("d", path("d"), copy("b", 0), (path("b"), path("c"))),
        ]

    happened = lambda s, **o: "".join(w[0] for _, w in stages.run(spark, s, stages.Options(**o)))
    assert happened(steps(), dry=True) == "pppp" and happened(steps()) == "mmmm" and happened(steps()) == "ssss"
    assert happened(steps(2), dry=True) == "ppsp" and happened(steps(2)) == "mmsm" and happened(steps(2)) == "ssss"
    spark.range(5).write.mode("overwrite").parquet(path("other"))
    assert happened(steps(2)) == "ssmm" and spark.read.parquet(path("c")).count() == 5
    # A table made again from the same inputs is the same table.
    (tmp_path / "a" / "_SUCCESS").unlink()
    assert happened(steps(2)) == "msss"
    (tmp_path / "d" / stages.FINGERPRINT).unlink()
    assert happened(steps(2)) == "sssm"


def test_tables_of_committed_parts_survive_their_writers(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "n long"
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("n")).repartition(4)
    read = lambda: sorted(r["n"] for r in manifest.read(spark, path, _schema(schema)).collect())
    with pytest.raises(FileNotFoundError):
        read()
    with pytest.raises(Exception, match="killed"):
        manifest.replace(broken, path)
    assert manifest.parts(spark, path) == []
    manifest.replace(spark.range(2).toDF("n"), path)
    with pytest.raises(Exception, match="killed"):
        manifest.replace(broken, path)
    assert read() == [0, 1]
    assert manifest.append(spark.range(2, 3).toDF("n"), path, "x") and not manifest.append(spark.range(2, 3).toDF("n"), path, "x")
    with pytest.raises(Exception, match="killed"):
        manifest.append(broken, path, "y")
    assert read() == [0, 1, 2] and manifest.append(spark.range(3, 4).toDF("n"), path, "y") and read() == [0, 1, 2, 3]
    manifest.replace(manifest.read(spark, path, _schema(schema)).select((F.col("n") + 10).alias("n")), path)
    assert read() == [10, 11, 12, 13]
    assert len(manifest.vacuum(spark, path)) >= 3 and read() == [10, 11, 12, 13] and manifest.vacuum(spark, path) == []


def _schema(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def test_a_small_file_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "d.json")
    for k in range(3):
        sinks.write_document(spark, {"k": k}, path)
        assert json.loads(sources.small_text(spark, path)) == {"k": k}
    assert sources.small_text(spark, path + "x") is None
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["d.json"]


def test_a_shuffle_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000, 99_991):
        out = sampling.permuted(np.arange(n), n, 5)
        assert sorted(out.tolist()) == list(range(n))
    big = sampling.permuted(np.arange(10**12, 10**12 + 1000), 10**13 + 7, 1)
    assert len(set(big.tolist())) == 1000 and big.min() >= 0 and big.max() < 10**13 + 7
    a, b = (sampling.permuted(np.arange(5000), 5000, s) for s in (1, 2))
    assert (a == b).mean() < 0.01 and (a == np.arange(5000)).mean() < 0.01 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05
    x = sampling.shuffled(spark.range(500), "id", 500, 9)
    assert "Exchange" not in plan(x) and sorted(r["place"] for r in x.collect()) == list(range(500))
    for bad in (spark.range(501), spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))):
        with pytest.raises(Exception, match="ordinals have to be"):
            sampling.shuffled(bad, "id", 500, 9).collect()


def test_shuffled_sample_query(spark, sf_dir):
    from heddle.plans import queries

    rows = queries.CATALOG["q_global_shuffle"](spark, sf_dir).collect()
    assert sorted(r["place"] for r in rows) == sorted(r["ordinal"] for r in rows) == list(range(len(rows))) and len({r["o_orderkey"] for r in rows}) == len(rows)
    assert [r["place"] for r in sorted(rows, key=lambda r: r["ordinal"])] == sampling.permuted(np.arange(len(rows)), len(rows), queries.SEED).tolist()
    by = [r["o_orderpriority"] for r in sorted(rows, key=lambda r: r["place"])]
    assert len({by.count(c) for c in set(by)}) == 1 and len(set(by[:40])) == len(set(by))


def test_question_of_messages(spark):
    from heddle.functions import text

    m = "array<struct<role:string,content:string>>"
    rows = [([("user", " a ")],), ([("assistant", "b")],), ([("user", "a"), (None, None)],), ([("", " x")],), ([],), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, f"m {m}").coalesce(1).select(text.question(F.col("m"))).collect()]
    assert out == ["a", "Assistant: b", "User: a\nUser:", ": x", "", None]


def test_sets_of_values(spark):
    x = frame(spark, [("p", "a"), ("p", "b"), ("p", "a"), ("q", "a"), ("r", "a"), ("r", "b"), ("r", "c"), ("s", None)], "k string, v string")
    out = {r["k"]: tuple(r)[1:] for r in report.value_sets(x, "k", "v", ("b", "a")).collect()}
    assert out == {"p": (2, True, True, True, ""), "q": (1, False, True, False, "b"), "r": (3, True, False, False, ""), "s": (0, False, True, False, "a,b")}


def test_split_audit(spark):
    x = spark.range(100).select("id", F.when(F.col("id") < 60, "a").otherwise("b").alias("c"))
    r = sampling.split_audit(sampling.balanced_halves(x, "c", "id", 1, 20), "c", 20).first()
    assert (r["requested_per_class"], r["total"], r["even"]) == (20, 40, True) and [tuple(c) for c in r["counts"]] == [("a", "dpo", 10), ("a", "sft", 10), ("b", "dpo", 10), ("b", "sft", 10)]


def test_totals_leave_the_groups_where_they_are(spark):
    x = spark.range(20_000).select((F.col("id") % 5000).alias("v"))
    out = report.counted(x, "v")
    main = plan(out).split("Subquery", 1)[0]
    assert "SinglePartition" not in main and "Window" not in plan(out)
    rows = out.collect()
    assert len(rows) == 5000 and {(r["n"], r["percent"]) for r in rows} == {(4, 0.02)}
    assert report.counted(spark.createDataFrame([(None,), ("a",), (None,)], "v string"), "v").where("v is null").first()["percent"] == 66.67
