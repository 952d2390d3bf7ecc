"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weights of the sources by code point of their name, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take altogether, as a share of all words, and the largest number of epochs of a source.
SHARE, EPOCHS = 1.5, 2.0
#: Seed of the order in which a source's documents join the fractional epoch.
SEED = 20177
#: Hexadecimal digits of a document's draw.
DRAW_DIGITS = 15
#: Hash buckets a source's documents are summed by before the boundary bucket is looked at row by row.
BUCKETS = 4096
#: Sources up to which their table is sent to every task; beyond, it is joined by shuffle.
MOST_SENT = 10_000


def words_of(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """`sources` (source, weight, source_size) with target: words to take of each.

    Targets are proportional to weight, but no more than `epochs` times source_size; what a clamped source
    cannot take is shared by weight among the rest until none is above its limit. Rounds of clamping end at
    the level where sum(min(weight * level, limit)) is the total; sources in order of limit / weight reach
    their limits one after the other, so one ordered pass over the source table finds them. If even the
    limits sum to less than the total, every source stops at its limit. Empty sources get 0."""
    limit = F.lit(float(epochs)) * F.col("source_size")
    by = Window.orderBy("__full_at", F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("__full_at", F.col("source").asc_nulls_last())
    x = sources.withColumn("__limit", limit).withColumn("__full_at", F.col("__limit") / F.col("weight"))
    x = x.withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    x = x.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    x = x.withColumn("__clamped", F.col("__full_at") <= F.col("__level") * (1 + 1e-12))
    # The level that holds for the rest is that of the first source which isn't clamped.
    x = x.withColumn("__free", F.min(F.when(~F.col("__clamped"), F.struct("__full_at", F.col("source").isNull(), "source", "__level"))).over(everything)["__level"])
    target = F.when(F.col("__clamped"), F.col("__limit")).otherwise(F.least("__limit", F.col("weight") * F.col("__free")))
    return x.select("source", "weight", "source_size", target.alias("target"))


def plan(sized: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per source: source, source_size, target, whole (epochs that every document joins), cut (documents
    with a __draw up to it join one epoch more; null: none). `sized` has source, size and __draw.

    The fractional epoch takes documents in order of __draw while that brings the source's words nearer to
    its target. Sums by (source, bucket of the draw) find the bucket in which it ends; only that bucket's
    rows are ordered, so a source with a third of all rows costs no more than one with few."""
    span = 16**DRAW_DIGITS // BUCKETS
    bucketed = sized.withColumn("__bucket", F.floor(F.col("__draw") / F.lit(span)).cast("int"))
    sums = bucketed.groupBy("source", "__bucket").agg(F.sum("size").alias("__size"))
    sums = written(sums, "mix-sums")
    sources = sums.groupBy("source").agg(F.sum("__size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(position, F.lit(len(weights))) + 1).cast("int")).cast("double")
    filled = water_fill(sources.withColumn("weight", weight), share, epochs)
    epochs_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(epochs_of).cast("int"))
    filled = written(filled.withColumn("__rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "mix-sources")
    filled = F.broadcast(filled) if filled.count() <= MOST_SENT else filled
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__size").over(upto), F.lit(0)))
    edge = sums.join(filled.select(F.col("source").alias("__s"), "__rest"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # A source that takes whole epochs only has no edge, so that its empty documents don't join one epoch more.
    edge = edge.where((F.col("__rest") > 0) & (F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__size")))
    edge = edge.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before", "__rest")
    edge = written(edge, "mix-edges")
    edge = F.broadcast(edge) if edge.count() <= MOST_SENT else edge
    near = bucketed.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    near = near.groupBy("source", "__draw", "__before", "__rest").agg(F.sum("size").alias("__size"))
    within = Window.partitionBy("source").orderBy("__draw").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__after", F.col("__before") + F.sum("__size").over(within))
    nearer = F.col("__after") - F.col("__rest") <= F.col("__rest") - (F.col("__after") - F.col("__size"))
    # Every edge bucket yields a cut: its last draw that brings the words nearer, or the end of the bucket before.
    cuts = near.groupBy("source").agg(F.max(F.when(nearer, F.col("__draw"))).alias("__in"))
    cuts = cuts.select(F.col("source").alias("__s"), "__in")
    edge = edge.withColumnRenamed("__s", "__e")
    cuts = edge.join(cuts, F.col("__e").eqNullSafe(F.col("__s"))).select(F.col("__e").alias("__c"), F.coalesce("__in", F.col("__b") * F.lit(span) - 1).alias("cut"))
    return filled.join(cuts, F.col("source").eqNullSafe(F.col("__c")), "left").select("source", "source_size", "target", "whole", "cut")


def mix(docs: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, source, and what else it has) with size, source_size, target and copies: how often
    the mix repeats each document. taken words are copies * size; copies is floor(target / source_size), or one
    more for the documents of the fractional epoch, and never above `epochs` rounded up.

    Null text has size 0; a null source is a source of its own, last in order. Rows with the same doc_id and
    seed draw the same number, so they join or miss the fractional epoch together. An empty table gives no
    rows. Columns size, source_size, target and copies of `docs` are replaced. A source whose documents are few
    and long misses its target by half a document at most. Reruns agree: draws hash the seed and the id."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("long")
    docs = docs.drop("source_size", "target", "copies").withColumn("size", words_of(F.col("text"))).withColumn("__draw", draw)
    sized = written(docs.select("source", "size", "__draw"), "mix-sizes")
    chosen = written(plan(sized, share, epochs, weights), "mix-plan")
    chosen = chosen.withColumnRenamed("source", "__s")
    chosen = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen
    extra = F.coalesce(F.col("__draw") <= F.col("cut"), F.lit(False)).cast("int")
    return docs.join(chosen, F.col("source").eqNullSafe(F.col("__s"))).withColumn("copies", F.col("whole") + extra).drop("__s", "__draw", "whole", "cut")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of `mixed` as often as its copies say."""
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copies > 0").drop("__copy")
