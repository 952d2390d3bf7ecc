"""Exact deduplication: two passes over a counting Bloom filter, and a shuffle of possible repeats only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_of, kept, shared_dir, tidied, without, written

#: Cells per filter segment; a segment is the unit in which partial filters are merged.
SEGMENT = 1 << 16
#: Probes per key.
PROBES = 3
#: Cells per row that filters are sized for, and the bounds of one filter's size in cells. A cell is a bit when the filter
#: is sent out and two while a task counts, so a task holds 32 MB of them at most; more rows make more filters.
CELLS_PER_ROW, LEAST_CELLS, MOST_CELLS = 16, 1 << 20, 1 << 27
#: Keys that are looked at together.
TOGETHER = 1 << 16
#: Groups of at least this many rows, and of at least a row in SHARE, go to every task with what is decided of them: there
#: are SHARE of them at most. The rows of smaller ones meet them by shuffle.
HOT, SHARE = 1024, 100_000


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The PROBES cells of each 64-bit key, (n, PROBES), by double hashing; `cells` is a power of two."""
    k = keys.view(np.uint64)
    a, b = k, (k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + steps[None, :] * b[:, None]) & np.uint64(cells - 1)).astype(np.int64)


def filter_size(rows: int, most: int = MOST_CELLS) -> tuple[int, int]:
    """(filters, cells of each) for so many rows, both powers of two."""
    wanted = max(LEAST_CELLS, 1 << int(np.ceil(np.log2(max(1, rows) * CELLS_PER_ROW))))
    return max(1, wanted // most), min(most, wanted)


def _packed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, masks) of the cells `at`, ascending and distinct, among packed bits."""
    where, first = np.unique(at >> 3, return_index=True)
    return where, np.add.reduceat((128 >> (at & 7)).astype(np.uint8), first)


def repeat_filter(keys: DataFrame, cells: int) -> bytes:
    """Bits of the cells that two or more rows of `keys` (one column, key long) hit. Pass one: each task
    counts its rows per cell, saturating at two; only the touched segments travel and meet in partial sums, one segment
    at a time. Size on the driver: cells / 8 bytes."""
    segment = min(SEGMENT, cells) // 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for b in batches:
            for part in range(0, b.num_rows, TOGETHER):
                at = np.sort(_cells(np.asarray(b.column(0))[part : part + TOGETHER], cells), axis=1)
                first = np.ones(at.shape, np.bool_)  # the probes of one key count once a cell
                first[:, 1:] = at[:, 1:] != at[:, :-1]
                u, n = np.unique(at[first], return_counts=True)
                if (n > 1).any():
                    where, mask = _packed(u[n > 1])
                    twice[where] |= mask
                if len(u):
                    where, mask = _packed(u)
                    twice[where] |= once[where] & mask
                    once[where] |= mask
        for s in np.flatnonzero(once.reshape(-1, segment).any(axis=1)):
            part = slice(s * segment, (s + 1) * segment)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([once[part].tobytes()]), pa.array([twice[part].tobytes()])], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], ["segment", "twice"])

        now, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for b in batches:
            for s, o, t in zip(*(c.to_pylist() for c in b.columns)):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if s == now:
                    once, twice = once | o, twice | t | (once & o)
                else:
                    if twice.any():
                        yield out()
                    now, once, twice = s, o, t
        if twice.any():
            yield out()

    parts = keys.mapInArrow(tidied(count), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    bits = np.zeros((max(1, cells // SEGMENT), segment), np.uint8)
    for s, t in merged.collect():
        bits[s] = np.frombuffer(t, np.uint8)
    return bits.tobytes()


def _flagged(hashed: DataFrame, sent, cells: int) -> DataFrame:
    """`hashed` with maybe_repeated: pass two, each row against the filter that has been `sent` to all tasks."""
    schema = hashed.select("*", F.lit(True).alias("maybe_repeated")).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            keys = np.asarray(b.column(b.schema.get_field_index("hash_key")))
            hit = np.zeros(b.num_rows, np.bool_)
            for part in range(0, b.num_rows, TOGETHER):
                at = _cells(keys[part : part + TOGETHER], cells)
                hit[part : part + TOGETHER] = ((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "maybe_repeated"])

    return hashed.mapInArrow(look, schema)


def flagged(hashed: DataFrame, rows: int, most: int = MOST_CELLS) -> DataFrame:
    """`hashed` (hash_key, and what else it has), written with maybe_repeated. Keys are cut by range so that each range has
    a filter of at most `most` cells; one after the other is built, sent out, used and given up."""
    spark = hashed.sparkSession
    filters, cells = filter_size(rows, most)
    path = f"{shared_dir(spark)}/exact-flagged-{uuid.uuid4().hex}"
    step = 2**64 // filters
    for k in range(filters):
        low = -(2**63) + k * step
        part = hashed if filters == 1 else hashed.where(F.col("hash_key").between(low, low + step - 1))
        sent = spark.sparkContext.broadcast(repeat_filter(part.select("hash_key"), cells))
        out = _flagged(part, sent, cells)
        out.write.mode("append").parquet(path)
        sent.destroy()
    return kept(spark, path, out.schema)


def hashes(docs: DataFrame, text: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, hash_key): the digest of each text, null as empty, and 64 bits of it."""
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("text_sha256"))
    return hashed.withColumn("hash_key", F.xxhash64("text_sha256"))


def group_exact(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per row of `docs`, dropped ones too: doc_id, keep_id (the largest doc_id of the equal texts),
    group_size, kept, text_sha256.

    `text` is the normalised text to compare (default: column text as it is). Null text counts as empty;
    empty texts equal each other. Of rows with the same text and the same largest doc_id each is a row of
    the result, and kept is true for them all; a null doc_id stays only where its group has no other id.
    An empty table gives no rows. Other columns of `docs` play no part.

    Only rows that a filter flags shuffle, as digests; their groups are summed map-side first. What is decided of the
    largest groups is sent to every task, so a group that holds a third of all rows never meets in one task. Hashes are
    sorted by key as they are written, so that a range of keys is read without the others."""
    hashed = written(hashes(docs, F.col("text") if text is None else text).sortWithinPartitions("hash_key"), "exact-hashes")
    rows = hashed.count()
    told = flagged(hashed, rows)
    alone = told.where(~F.col("maybe_repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    again = told.where("maybe_repeated").select("doc_id", "text_sha256")
    groups = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    hot = F.col("group_size") >= max(HOT, rows // SHARE)
    marked = again.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    large = marked.where("group_size is not null")
    small = marked.where("group_size is null").select("doc_id", "text_sha256").join(groups.where(~hot), "text_sha256")
    back = large.unionByName(small).select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(back).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, text: Column | None = None, once: bool = False) -> DataFrame:
    """`docs` without rows whose text equals that of a row with a larger doc_id; all columns stay.
    Rows that share both the text and the doc_id (or have none) are all kept, or with `once` one of them.
    Each row goes or stays by its own verdict, which is joined back by doc_id and digest."""
    text = F.col("text") if text is None else text
    judged = group_exact(docs, text)
    # Rows alone in their group are kept, so only those of larger groups are looked at.
    again = judged.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("once"), F.count(F.lit(1)).alias("n"))
    return without(docs, text, again.where((~F.col("once")) | (F.lit(once) & (F.col("n") > 1))))
