"""The pipeline's stages, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heddle.llm import language

from .test_operators import plain_components


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456 !!", "en", "src1", 10), (10**6 + 1, None, "en", None, 0)], docs.schema)
    out = [("documents", docs.unionByName(junk))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1][1], sf_dir).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return out


def test_stages_keep_columns_and_take_effect(staged):
    names, tables = zip(*staged)
    assert names[1:] == ("language_id", "exact_dedup", "near_dedup", "mixing", "packing")
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    ids = [{r[0] for r in t.select("doc_id").collect()} for t in tables[:-1]]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and 10**6 not in ids[1] and len(ids[2]) < len(ids[1])


def test_language_stage_keeps_clean_documents(staged):
    before, after = staged[0][1], staged[1][1]
    gone = before.join(after, "doc_id", "left_anti").select("doc_id").collect()
    assert {r[0] for r in gone} <= {10**6, 10**6 + 1} | {r[0] for r in before.where(F.length("text") < 100).select("doc_id").collect()}


def test_dedup_stages(staged):
    exact, near = staged[2][1].collect(), staged[3][1].collect()
    by = {}
    for r in staged[1][1].collect():
        by[r["text"]] = max(by.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(by.values())
    parts = plain_components([(r["doc_id"], r["text"]) for r in exact], 5, 80)
    assert {r["doc_id"] for r in near} == {i for i, (_, c) in parts.items() if i == c}


def test_stages_on_odd_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = {c: F.lit(f"own {c}") for c in ("size", "source_size", "target", "copies", "lang_pred", "score", "keep_id", "kept", "component_id", "text_sha256", "node")}
    long = spark.createDataFrame([(10**6, "the of and that was with this from " * 40_000, "en", "long", 1)], docs.schema)
    odd = docs.unionByName(docs).unionByName(long).withColumns(clash)
    for table, empty in ((odd, False), (odd.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.isEmpty() == empty, name
            if name != "packing":
                assert out.columns == odd.columns and out.where(" or ".join(f"{c} <> 'own {c}'" for c in clash)).isEmpty()
    assert corpus_pipeline.exact(spark, odd, sf_dir).count() == docs.select("text").distinct().count() + 1


def test_run_deletes_what_stages_wrote(spark, sf_dir):
    from heddle.llm import common

    before = common.tables()
    out = corpus_pipeline.run(spark, sf_dir)
    assert common.tables() == before + 1 and out.count() > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:3] == ["doc_id", "start", "length"]
    assert language.UNDETERMINED == "und"
