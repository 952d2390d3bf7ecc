"""Every query of the catalog runs, and equals its SQL in a second engine."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from heddle.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.CATALOG))
def test_query(spark, sf_dir, engine, name):
    out = queries.CATALOG[name](spark, sf_dir)
    rows, sql = out.collect(), oracles.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(out.columns)) == len(out.columns)
        return
    want = engine.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert plain(rows, out.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and os.path.exists("/root/testdata")


def test_rows_only_queries_give_what_is_known(spark, sf_dir):
    kinds = {r["conv_id"] % 8: r for r in queries.CATALOG["q_candidate_eval"](spark, sf_dir).collect()}
    assert {k: kinds[k]["structural_kind"] for k in (2, 3, 4, 6, 7)} == {2: "valid_tool_call", 3: "invalid_tool_call", 4: "invalid_tool_call", 6: "empty", 7: "valid_tool_call"}
    probe = queries.CATALOG["q_probe_fit_predict"](spark, sf_dir).collect()
    # Predictions are compared with plain numbers in test_probe.py; the labels of these rows don't follow from their vectors.
    assert {r["prediction"] for r in probe} <= {r["label_id"] for r in probe} and all(0.1 < r["confidence"] <= 1 for r in probe)
