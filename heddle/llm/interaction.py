"""Filter interaction audit: what each order of filters keeps and removes, from histograms of which filters a text fails."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import together
from .common import tidied, written

#: The filters, a bit each from the lowest on: few words, few distinct words, many capitals, marks, repeated text.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITAL, _MARK = re.compile("[A-Z]"), re.compile(r"[#$%&*|]")


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.encode("utf-8", "surrogatepass").split()
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * len(_CAPITAL.findall(text)) > MOST_CAPITALS * len(text)
    return few | same << 1 | loud << 2 | (_MARK.search(text) is not None) << 3


def outcomes() -> dict[str, np.ndarray]:
    """Integer matrices, MASKS by orders times steps: whether a document of a mask is kept after the step, removed there,
    failing but removed before, failing that filter only, and, for shapley, at how many steps of any order its filter
    removes a document of the mask."""
    step = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    own = 1 << step
    before = np.cumsum(own, axis=1) - own
    mask = np.arange(MASKS)[:, None, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    removed = fails & ~gone
    times = np.stack([(removed & (step == k)).sum(axis=(1, 2)) for k in range(len(FILTERS))], axis=1)
    parts = {"kept": ~gone & ~fails, "removed": removed, "redundant": fails & gone, "unique_fails": mask == own, "shapley": times[:, step]}
    return {name: m.reshape(MASKS, -1).astype(np.int64) for name, m in parts.items()}


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row of `docs` (doc_id, text, source): the bits of A to D, and the SHA-256 of the text."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = kept.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, "text"):
            masks = [failures(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"])

    return kept.mapInArrow(tidied(judge), "doc_id long, part string, digest binary, mask int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask of failed filters, and those labelled so.

    Rows of a text meet by digest after those of a part and text have been put together, so that a text that a third of all
    rows hold has a row a part there. The first row of a text, which doesn't fail E, is the one with the smallest doc_id;
    rows that share it are all first, and so are those without a doc_id, which are smaller than none."""
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("long"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = written(judged(docs), "interaction-judged")
    anonymous = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    named = rows.where("doc_id is not null").join(known, "doc_id", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    by_id = named.groupBy("doc_id", "digest", "part", "mask").agg(count(F.lit(1)).alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))
    each = by_id.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.min(F.struct("doc_id", "n", "good", "toxic")).alias("head")
    )
    # Of a part's rows of a text, those with the smallest doc_id of all parts are first, the others fail E too.
    texts = each.groupBy("digest").agg(F.min("head.doc_id").alias("least"), F.collect_list(F.struct("part", "mask", "n", "good", "toxic", "head")).alias("parts"))
    split = texts.select("least", F.inline("parts"))
    is_first = F.col("head.doc_id") == F.col("least")
    first = split.where(is_first).select("part", "mask", "head.n", "head.good", "head.toxic")
    rest = [(F.col(c) - F.when(is_first, F.col(f"head.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    again = split.select("part", (F.col("mask") + F.lit(REPEATED)).alias("mask"), *rest).where("n > 0")
    told = first.unionByName(again).unionByName(anonymous)
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters do in every order: a row for each part (a source of `docs`; null is empty), filter_order and step,
    with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    `docs` has doc_id, text and source, `labels` doc_id, quality and toxic; other columns play no part. A null text is
    empty, and fails A only (and E, if another is empty); a document with several labels is good or toxic if one says so,
    and one without any is neither. A null doc_id has no label. Repeated rows count each. No documents give no rows.

    A text is read once. The masks that it fails are counted by part, all, good and toxic ones; the histograms are stacked
    as rows, and one integer product with each of the 32 by 600 outcome matrices gives all orders and steps."""
    counts = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    order, step = [o for o in ORDERS for _ in FILTERS], [k + 1 for _ in ORDERS for k in range(len(FILTERS))]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = outcomes()
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                stacked = np.zeros((3, b.num_rows, MASKS), np.int64)
                for row, masks in enumerate(b.column(1).to_pylist()):
                    for m in masks:
                        stacked[:, row, m["mask"]] = m["n"], m["good"], m["toxic"]
                every, good, toxic = stacked
                made = [every @ matrices[n] for n in names[:4]] + [good @ matrices["removed"], toxic @ matrices["removed"], every @ matrices["shapley"]]
                part = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(order))))
                own = [part, pa.array(order * b.num_rows, pa.string()), pa.array(step * b.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(m.ravel()) for m in made)], ["part", "filter_order", "step", *names])

    return counts.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
