"""Repeatable samples and splits, ranked by hash so that no class is ordered in one task."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of the hash that cut a class into buckets.
BUCKET_DIGITS = 3


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def ranked(rows: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """`rows` with `place`, a row's rank from 1 in its class by the hash of its key.

    Counts by (class, bucket of the hash) give the places before each bucket; rows are ordered within their bucket
    only, so a class with a third of all rows is spread over 16 ** BUCKET_DIGITS groups."""
    hashed = rows.withColumn("__hash", order_hash(F.col(key), seed)).withColumn("__bucket", F.left("__hash", F.lit(BUCKET_DIGITS)))
    counts = hashed.groupBy(F.col(by).alias("__by"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__by").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__by", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = hashed.join(counts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__b")))
    within = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy("__hash", key))
    return joined.withColumn("place", (F.col("__before") + within).cast("long")).drop("__hash", "__bucket", "__by", "__b", "__before")


def class_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def sample_each(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows of each class; an error if one has fewer."""
    short = class_counts(rows, by).where(F.col("n") < n).first()
    if short is not None:
        raise ValueError(f"class {short[0]!r} has {short[1]} rows; {n} are wanted")
    return ranked(rows, by, key, seed).where(F.col("place") <= n)


def even_total(rows: DataFrame, by: str, wanted: int | None = None) -> int:
    """Rows to take of each class so that halves are equal: `wanted` (0 or None: all that the least class allows)."""
    least = class_counts(rows, by).agg(F.min("n")).first()[0] or 0
    total = wanted or least - least % 2
    if total <= 0 or total % 2 or total > least:
        raise ValueError(f"{total} rows of each class can't be halved; the least class has {least}")
    return total


def balanced_halves(rows: DataFrame, by: str, key: str, seed: int, wanted: int | None = None) -> DataFrame:
    """Equal numbers of each class with `half`: sft for the first half of its sample, dpo for the other."""
    total = even_total(rows, by, wanted)
    return ranked(rows, by, key, seed).where(F.col("place") <= total).withColumn("half", F.when(F.col("place") <= total // 2, "sft").otherwise("dpo"))


def balanced_cap(rows: DataFrame, by: str, key: str, labels: tuple[str, ...], most: int, seed: int) -> DataFrame:
    """At most `most` rows, shared evenly by label, what is left over to the first labels; a label with fewer rows
    gives what it has. No more rows than `most`: all."""
    if rows.count() <= most:
        return rows
    share, over = divmod(most, len(labels))
    limit = F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (v, share + (k < over))])
    return ranked(rows.where(F.col(by).isin(*labels)), by, key, seed).where(F.col("place") <= F.element_at(limit, F.col(by))).drop("place")


def fraction_split(rows: DataFrame, key: str, fraction: float, seed: int, by: str | None = None) -> DataFrame:
    """`rows` with `split`: eval for round(fraction * n) of them, of each class if `by` is given; train for the rest."""
    one = rows if by else rows.withColumn("__all", F.lit(0))
    name = by or "__all"
    sizes = F.broadcast(class_counts(one, name).select(F.col(name).alias("__c"), F.round(F.col("n") * fraction).cast("long").alias("__k")))
    out = ranked(one, name, key, seed).join(sizes, F.col(name).eqNullSafe(F.col("__c")))
    return out.withColumn("split", F.when(F.col("place") <= F.col("__k"), "eval").otherwise("train")).drop("__c", "__k", "__all", "place")


def leading(rows: DataFrame, by: str, ordinal: str, n: int) -> DataFrame:
    """The first n rows of each class in file order; an error if one has fewer. A top n: tasks keep n rows of a class."""
    short = class_counts(rows, by).where(F.col("n") < n).first()
    if short is not None:
        raise ValueError(f"class {short[0]!r} has {short[1]} rows; {n} are wanted")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(ordinal))).where(F.col("place") <= n)


def smoke(rows: DataFrame, by: str, ordinal: str, total: int, classes: int = 3) -> DataFrame:
    """The first rows of each class, `total` in all; an error if they can't be shared evenly or a class is short."""
    if total <= 0 or total % classes:
        raise ValueError(f"{total} rows can't be shared evenly by {classes} classes")
    return leading(rows, by, ordinal, total // classes)


def check_even(rows: DataFrame, by: str) -> int:
    """Rows of each class; an error unless all have the same number."""
    least, most = class_counts(rows, by).agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"classes have {least} to {most} rows")
    return least or 0


def replayed(spark: SparkSession, sizes: dict[str, int], n: int, seed: int) -> DataFrame:
    """(label, place, ordinal): what a sequential sampler with one generator picks from pools of these sizes, in the pools' order.
    Picks depend on sizes only; a task makes them one pool after the other, and they are joined to the pools by ordinal."""
    pools = list(sizes.items())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            generator = random.Random(seed)
            for label, size in pools:
                picks = generator.sample(range(size), n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(picks, pa.int64())], ["label", "place", "ordinal"])

    return spark.range(0, 1, 1, 1).mapInArrow(pick, "label string, place long, ordinal long")


#: Rounds of a permutation.
ROUNDS = 6


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The numbers 0 to n - 1 under a keyed permutation: a Feistel network over pairs (x // b, x % b), whose halves are of about
    the root of n, walked on from what falls beyond n until it comes back, which it does."""
    x, n = np.array(x, np.uint64), int(n)
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = -(-n // a)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // np.uint64(b), v % np.uint64(b)
        for k in range(ROUNDS):
            # The halves take turns; the one that stays says by how much the other moves on.
            stays, moves, size = (right, left, a) if k % 2 == 0 else (left, right, b)
            by = _mixed(stays, hash_of(seed, k))
            moved = (moves + by % np.uint64(size)) % np.uint64(size)
            left, right = (moved, right) if k % 2 == 0 else (left, moved)
        return left * np.uint64(b) + right

    out = once(x)
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def hash_of(seed: int, k: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{k}".encode(), digest_size=8).digest(), "big")


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64 bits that depend on all bits of x and of the key: two rounds of an odd multiplication and a shift."""
    x = x ^ np.uint64(key)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def shuffled(rows: DataFrame, ordinal: str, n: int, seed: int, name: str = "place") -> DataFrame:
    """`rows` with the place, from 0, of each in a shuffle of all n: a keyed permutation of their ordinals 0 to n - 1. Nothing
    is moved or sorted; a writer that wants the order sorts by the place, or cuts it into ranges. An ordinal that is null or
    out of range raises."""

    @F.pandas_udf("long")
    def at(x: pd.Series) -> pd.Series:
        if len(x) and (x.isna().any() or x.min() < 0 or x.max() >= n):
            raise ValueError(f"ordinals have to be 0 to {n - 1}")
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return rows.withColumn(name, at(F.col(ordinal).cast("long")))


def split_audit(halves: DataFrame, by: str, requested: int | None = None) -> DataFrame:
    """One row: seed-independent facts of a balanced split: rows of each class and half, whether halves and classes are even,
    and the total, for the record that goes with the split."""
    counts = halves.groupBy(by, "half").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct(F.col(by).alias("class"), "half", "n"))).alias("counts"))
    return one.select(F.lit(requested).cast("long").alias("requested_per_class"), "total", (F.col("least") == F.col("most")).alias("even"), "counts")
