"""Linear probes: standardized multinomial logistic regression, the penalty chosen on a stratified part.

All penalties are fitted together: each pass over the rows works out the loss and the gradient of every penalty that hasn't
converged, and the steps of L-BFGS between passes are taken on the driver, which sees sums only."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sampling import fraction_split

#: Inverse penalties that are tried, in order.
PENALTIES = (0.01, 0.1, 1.0, 10.0)
#: Tasks whose sums go to the driver as they are; those of more meet in about the root of their number first.
FAN = 64
#: Past steps that a descent remembers.
MEMORY = 10


class Probe(NamedTuple):
    """A fitted probe: its labels in order, the mean and deviation of each feature, and a row of weights for each label, the
    intercept last. Its size is that of labels times features."""

    labels: list[int]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _standardized(x, self.mean, self.deviation) @ self.weights.T


def _standardized(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Rows of unit deviation, with a 1 for the intercept at the end."""
    return np.hstack([(x - mean) / deviation, np.ones((len(x), 1))])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("features of one length are needed")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], tasks: int | None = None) -> np.ndarray:
    """The sum over all batches of an array of numbers. Tasks, of which there are `tasks`, send one each; the sums of many tasks
    meet in two steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else total + of(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part", "v"])

    def meet(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v.values) for v in table["v"]], axis=0)
        return pa.table([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "v"])

    parts, tasks = rows.mapInArrow(task, "part int, v array<double>"), tasks or rows.rdd.getNumPartitions()
    if tasks > FAN:
        parts = parts.groupBy(F.col("part") % math.isqrt(tasks)).applyInArrow(meet, "part int, v array<double>")
    found = [r["v"] for r in parts.collect()]
    return np.sum(np.array(found), axis=0) if found else np.zeros(0)


def descent(x: np.ndarray, tolerance: float, most: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a coroutine: it yields a point, is sent its value and gradient, and returns the point where the largest part of
    the gradient is below `tolerance`, or the last of `most` steps."""
    value, slope = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.abs(slope).max() <= tolerance:
            break
        direction, sent = -slope, []
        for s, y in reversed(past):
            a = (s * direction).sum() / (s * y).sum()
            sent.append(a)
            direction = direction - a * y
        if past:
            s, y = past[-1]
            direction = direction * ((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(past, reversed(sent)):
            direction = direction + s * (a - (y * direction).sum() / (s * y).sum())
        along, step = (slope * direction).sum(), 1.0 if past else min(1.0, 1.0 / np.abs(slope).sum())
        while True:
            there = x + step * direction
            value_there, slope_there = yield there
            if value_there <= value + 1e-4 * step * along or step < 1e-12:
                break
            # The minimum of the parabola through what is known, within bounds.
            step = min(max(-along * step**2 / (2 * (value_there - value - along * step)), 0.1 * step), 0.5 * step)
        s, y = there - x, slope_there - slope
        if (s * y).sum() > 1e-12 * (y * y).sum():
            past = [*past[-(MEMORY - 1) :], (s, y)]
        x, value, slope = there, value_there, slope_there
    return x


def together(descents: list[Generator], evaluated: Callable[[np.ndarray], list[tuple[float, np.ndarray]]]) -> tuple[list[np.ndarray], int]:
    """(where each descent ends, passes): all that go on are evaluated at their points in one pass."""
    points, ends, passes = {k: next(d) for k, d in enumerate(descents)}, {}, 0
    while points:
        passes += 1
        order = list(points)
        for k, found in zip(order, evaluated(order, [points[k] for k in order])):
            try:
                points[k] = descents[k].send(found)
            except StopIteration as end:
                ends[k] = end.value
                del points[k]
    return [ends[k] for k in range(len(descents))], passes


def _known(rows: DataFrame, features: str, label: str, more: list = []) -> DataFrame:  # noqa: B006
    x = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), *more)
    return x.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _moments(known: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, deviation) of the features; a constant feature has a deviation of 1. Sums are of differences from one of
    the rows, so large means cost no digits."""
    first = known.select("x").first()
    if first is None:
        raise ValueError("a probe needs rows with features and labels")
    pivot = np.array(first["x"])

    def sums(b: pa.RecordBatch) -> np.ndarray:
        d = _matrix(b.column(0)) - pivot
        return np.concatenate([[len(d)], d.sum(axis=0), (d**2).sum(axis=0)])

    n, *rest = summed(known.select("x"), sums)
    d, squares = np.array(rest).reshape(2, -1) / n
    deviation = np.sqrt(np.maximum(squares - d**2, 0))
    return int(n), pivot + d, np.where(deviation > 1e-12, deviation, 1.0)


def fit_all(known: DataFrame, labels: list[int], penalties: tuple[float, ...], tolerance: float = 1e-6, most: int = 200) -> tuple[list[Probe], int]:
    """(a probe for each inverse penalty, passes over the rows): `known` has x and y, and is read once a pass whatever the number
    of penalties. The loss is the mean over rows plus 1 / (2 C n) times the squared weights without intercepts."""
    n, mean, deviation = _moments(known)
    k, d = len(labels), len(mean)
    spark, place, asked = known.sparkSession, np.array(labels), known.select("x", "y")
    tasks = asked.rdd.getNumPartitions()

    def evaluated(order: list[int], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        sent = spark.sparkContext.broadcast(np.concatenate(points))
        of = len(points)

        def sums(b: pa.RecordBatch) -> np.ndarray:
            x, y = _standardized(_matrix(b.column(0)), mean, deviation), np.searchsorted(place, np.asarray(b.column(1)))
            z = (x @ sent.value.T).reshape(len(x), of, k)
            top = z.max(axis=2)
            losses = top + np.log(np.exp(z - top[:, :, None]).sum(axis=2)) - z[np.arange(len(x)), :, y]
            over = _softmax(z)
            over[np.arange(len(x)), :, y] -= 1
            return np.concatenate([losses.sum(axis=0), (over.reshape(len(x), of * k).T @ x).ravel()])

        found = summed(asked, sums, tasks) / n
        sent.destroy()
        slopes = found[of:].reshape(of, k, d + 1)
        out = []
        for at, w, loss, slope in zip(order, points, found, slopes):
            weight = 1.0 / (penalties[at] * n)
            free = np.hstack([w[:, :-1], np.zeros((k, 1))])
            out.append((loss + weight / 2 * (free**2).sum(), slope + weight * free))
        return out

    ends, passes = together([descent(np.zeros((k, d + 1)), tolerance, most) for _ in penalties], evaluated)
    # A constant added to all intercepts changes nothing, so theirs sum to 0.
    centred = [np.hstack([w[:, :-1], w[:, -1:] - w[:, -1].mean()]) for w in ends]
    return [Probe(labels, mean, deviation, w) for w in centred], passes


def macro_f1(pairs: list[tuple[int, int, int]]) -> float:
    """Mean F1 over the labels that occur, from counts of (label, prediction)."""
    scores = []
    for x in {v for a, b, _ in pairs for v in (a, b)}:
        hit = sum(n for a, b, n in pairs if a == b == x)
        whole = sum(n * ((a == x) + (b == x)) for a, b, n in pairs)
        scores.append(2 * hit / whole if whole else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def scored(probes: list[Probe], held: DataFrame) -> list[float]:
    """Macro F1 of each probe on rows of x and y, all in one pass; counts of pairs of labels go to the driver."""
    sent = held.sparkSession.sparkContext.broadcast(probes)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1)
            for k, p in enumerate(sent.value if b.num_rows else []):
                told = np.array(p.labels)[p.logits(x).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.int32()), y, pa.array(told, pa.int64())], ["probe", "y", "told"])

    counts = held.select("x", "y").mapInArrow(pairs, "probe int, y long, told long").groupBy("probe", "y", "told").agg(F.count(F.lit(1)).alias("n")).collect()
    return [macro_f1([(r["y"], r["told"], r["n"]) for r in counts if r["probe"] == k]) for k in range(len(probes))]


def fit(rows: DataFrame, features: str = "features", label: str = "label_id", key: str = "example_id", seed: int = 42, share: float = 0.2, penalties: tuple[float, ...] = PENALTIES) -> tuple[Probe, float, list[tuple[float, float]]]:
    """(probe refitted on all rows, chosen inverse penalty, macro F1 of each on the held-out part). Rows without features or a
    label are left out; of penalties that score alike the first is chosen. Means and deviations of the trial are those of
    the rows that are learnt from."""
    known = _known(fraction_split(rows, key, share, seed, by=label), features, label, ["split"]).persist()
    try:
        labels = sorted(r["y"] for r in known.select("y").distinct().collect())
        probes, _ = fit_all(known.where("split = 'train'"), labels, tuple(penalties), tolerance=1e-5)  # near enough to score
        scores = list(zip(penalties, scored(probes, known.where("split = 'eval'"))))
        best = max(scores, key=lambda s: s[1])[0]
        [model], _ = fit_all(known, labels, (best,))
        return model, best, scores
    finally:
        known.unpersist()


def predict(model: Probe, rows: DataFrame, features: str = "features") -> DataFrame:
    """`rows` with prediction (long) and probabilities (array of double, in the order of the labels); both null where there are
    no features."""
    schema = StructType([*(f for f in rows.schema.fields if f.name not in ("prediction", "probabilities")), *StructType.fromDDL("prediction long, probabilities array<double>").fields])
    sent, kept = rows.sparkSession.sparkContext.broadcast(model), rows.drop("prediction", "probabilities")
    asked = kept.withColumn("__x", F.col(features).cast("array<double>"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            given = b.column(b.num_columns - 1)
            has = np.flatnonzero(np.asarray(given.is_valid()))
            z = _softmax(p.logits(_matrix(given.take(pa.array(has))))) if len(has) else np.zeros((0, len(p.labels)))
            told, shares = [None] * b.num_rows, [None] * b.num_rows
            for k, row in zip(has.tolist(), z):
                told[k], shares[k] = p.labels[int(row.argmax())], row.tolist()
            own = [pa.array(told, pa.int64()), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], "prediction", "probabilities"])

    return asked.mapInArrow(tell, schema)
