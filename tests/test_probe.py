"""Probes: one pass for all penalties, against separate fits and plain numbers."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from heddle.operators import probe
from heddle.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    y = draw.integers(0, 3, 240)
    x = draw.normal(size=(240, 5)) * [1, 20, 0.1, 1, 0] + np.eye(5)[y] * [1, 10, 0.1, 0, 0] + [0, 1000, 0, 0, 4]
    made = [(f"e{k}", v.tolist(), int(c) * 2) for k, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame([*made, ("no features", None, 2), ("no label", [0.0] * 5, None)], "example_id string, features array<double>, label_id long").repartition(5)


def test_penalties_fitted_together_equal_separate_fits(spark, rows):
    known = probe._known(rows, "features", "label_id").persist()
    probes, passes = probe.fit_all(known, [0, 2, 4], probe.PENALTIES, tolerance=1e-9)
    alone = [probe.fit_all(known, [0, 2, 4], (c,), tolerance=1e-9) for c in probe.PENALTIES]
    assert passes <= max(n for _, n in alone) + 5 < sum(n for _, n in alone)
    n, mean, deviation = probe._moments(known)
    assert n == 240 and deviation[4] == 1
    x = known.withColumn("v", F.transform(F.zip_with(F.zip_with("x", F.lit(mean.tolist()), lambda a, b: a - b), F.lit(deviation.tolist()), lambda a, b: a / b), lambda v: v)).select(array_to_vector("v").alias("v"), (F.col("y") / 2).alias("c"))
    for c, together, ([separate], _) in zip(probe.PENALTIES, probes, alone):
        assert np.abs(together.weights - separate.weights).max() < 1e-6
        model = LogisticRegression(featuresCol="v", labelCol="c", family="multinomial", standardization=False, regParam=1 / (c * 240), maxIter=2000, tol=1e-12).fit(x)
        assert np.abs(together.weights[:, :-1] - model.coefficientMatrix.toArray()).max() < 1e-4
        free = model.interceptVector.toArray()
        assert np.abs(together.weights[:, -1] - (free - free.mean())).max() < 1e-4
    known.unpersist()


def test_one_scan_a_pass_and_sums_of_many_tasks(spark, rows, monkeypatch):
    scanned = spark.sparkContext.accumulator(0)
    known = probe._known(rows, "features", "label_id")

    def count(b):
        scanned.add(b.num_rows)
        return np.array([b.num_rows, 1.0])

    assert probe.summed(known, count)[0] == 240 and scanned.value == 240
    monkeypatch.setattr(probe, "FAN", 2)
    assert probe.summed(known, lambda b: np.array([b.num_rows, 0.5]))[0] == 240
    assert len(probe.summed(known.where("y = 77"), count)) == 0
    with pytest.raises(ValueError, match="rows with features"):
        probe._moments(known.where("y = 77"))


def test_chosen_penalty_and_predictions(spark, rows):
    model, best, scores = probe.fit(rows)
    assert [c for c, _ in scores] == list(probe.PENALTIES) and best == max(scores, key=lambda s: s[1])[0] and model.labels == [0, 2, 4]
    out = {r["example_id"]: r for r in probe.predict(model, rows.withColumn("prediction", F.lit("own"))).collect()}
    assert out["no features"]["prediction"] is None and out["no features"]["probabilities"] is None and out["no label"]["prediction"] in (0, 2, 4)
    told = [(r["label_id"], r["prediction"]) for r in out.values() if r["features"] and r["label_id"] is not None]
    assert sum(a == b for a, b in told) > 0.5 * len(told) and all(abs(sum(r["probabilities"]) - 1) < 1e-12 for r in out.values() if r["features"])
    assert probe.predict(model, rows.limit(0)).count() == 0
    assert probe.macro_f1([(0, 0, 3), (0, 2, 1), (2, 2, 4), (4, 0, 2)]) == pytest.approx((6 / 9 + 8 / 9 + 0) / 3)


def test_query_scores_rows_that_it_did_not_learn_from(spark, sf_dir):
    """The same split, scaling, grid and loss in plain numbers, by Newton's method."""
    out = {r["example_id"]: r for r in queries.CATALOG["q_probe_fit_predict"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("features"), F.col("label").alias("label_id"))
    from heddle.operators import sampling

    parts = sampling.fraction_split(rows, "example_id", 0.25, queries.SEED, by="label_id").collect()
    assert set(out) == {r["example_id"] for r in parts if r["split"] == "eval"}
    learnt = spark.createDataFrame([r for r in parts if r["split"] == "train"]).drop("split")
    inner = {r["example_id"]: r["split"] for r in sampling.fraction_split(learnt, "example_id", 0.2, 42, by="label_id").collect()}
    split = lambda name: [r for r in parts if inner.get(r["example_id"]) == name]
    labels = sorted({r["label_id"] for r in parts if r["split"] == "train"})

    def fitted(chosen, c):
        x, y = np.array([r["features"] for r in chosen]), np.array([labels.index(r["label_id"]) for r in chosen])
        mean, deviation = x.mean(axis=0), x.std(axis=0)
        z = np.hstack([(x - mean) / deviation, np.ones((len(x), 1))])
        k, d, w = len(labels), z.shape[1], np.zeros((len(labels), z.shape[1]))
        free = np.ones(d)
        free[-1] = 0
        for _ in range(60):
            p = np.exp(z @ w.T - (z @ w.T).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = ((p - np.eye(k)[y]).T @ z) / len(z) + w * free / (c * len(z))
            if np.abs(slope).max() < 1e-9:
                break
            curve = np.zeros((k, d, k, d))
            for a in range(k):
                for b in range(k):
                    curve[a, :, b, :] = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z / len(z)
            square = curve.reshape(k * d, k * d) + np.diag(np.tile(free / (c * len(z)), k)) + 1e-9 * np.eye(k * d)
            w = w - np.linalg.solve(square, slope.ravel()).reshape(k, d)
        return mean, deviation, w

    def told(model, chosen):
        mean, deviation, w = model
        z = np.hstack([(np.array([r["features"] for r in chosen]) - mean) / deviation, np.ones((len(chosen), 1))]) @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def score(c):
        p = told(fitted(split("train"), c), split("eval")).argmax(axis=1)
        pairs = [(r["label_id"], labels[k], 1) for r, k in zip(split("eval"), p)]
        return probe.macro_f1(pairs)

    best = max(probe.PENALTIES, key=score)
    held = [r for r in parts if r["split"] == "eval"]
    p = told(fitted([r for r in parts if r["split"] == "train"], best), held)
    same = [labels[q.argmax()] == out[r["example_id"]]["prediction"] for r, q in zip(held, p)]
    assert sum(same) >= len(same) - 1 and all(abs(q.max() - out[r["example_id"]]["confidence"]) < 1e-3 for r, q in zip(held, p))
