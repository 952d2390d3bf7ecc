"""Joins between stages' records, with the checks that they want."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Records of two stages that don't belong together."""


def _blank(key: str) -> Column:
    return F.col(key).isNull() | (F.col(key).cast("string") == "")


def _sided(source: DataFrame, stages: Sequence[DataFrame], key: str) -> tuple[DataFrame, list[list[str]]]:
    """All sides' rows with the number of stage rows of their key (`__n1`, ...) and each stage's other columns as a struct
    (`__s1`, ...), the source's rows marked `__side` = 0; and the columns of each struct. Each side is read once; the rows of
    a key meet in the one exchange, where a window over them counts and spreads what a join would repeat."""
    taken, columns = set(source.columns), []
    sides = source.withColumn("__side", F.lit(0))
    for k, stage in enumerate(stages, 1):
        own = [c for c in stage.columns if c not in taken]
        taken |= set(own)
        columns.append(own)
        sides = sides.unionByName(stage.select(key, F.struct(F.lit(True).alias("__"), *own).alias(f"__s{k}"), F.lit(k).alias("__side")), allowMissingColumns=True)
    of_key = Window.partitionBy(key)
    added = {f"__n{k}": F.count_if(F.col("__side") == k).over(of_key) for k in range(1, len(columns) + 1)}
    added |= {f"__s{k}": F.first(f"__s{k}", ignorenulls=True).over(of_key) for k in range(1, len(columns) + 1)}
    return sides.withColumns({"__n0": F.count_if(F.col("__side") == 0).over(of_key), **added}), columns


def _faults(key: str, stages: int, names: Sequence[str] | None, every: bool) -> Column:
    """What is wrong with the rows of a key, as a text, or null. `every` demands a row of each stage for each of the source's."""
    shown = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = F.lit(None).cast("string")
    for k in reversed(range(1, stages + 1)):
        n, name = F.col(f"__n{k}"), names[k - 1] if names else f"stage {k}"
        say = lambda text: F.concat(F.lit(f"{name}: {text} "), shown)  # noqa: B023, E731
        out = F.when((n > 0) & _blank(key), F.lit(f"{name}: a row without {key}")).when(n > 1, say("more than one row of")).when((n > 0) & (F.col("__n0") == 0), say("the source lacks")).otherwise(out)
        out = F.when((F.col("__n0") > 0) & (n == 0), say("no row of")).otherwise(out) if every else out
    return out


def _kept(sides: DataFrame, fault: Column, wanted: Column) -> DataFrame:
    """The rows that are `wanted`; any row with a fault ends the action, also one that a later filter wouldn't want: the number
    of the partition decides nothing, but keeps filters from being moved before the check."""
    return sides.where((F.spark_partition_id() >= 0) & F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("IntegrityError: "), fault)).cast("boolean")).otherwise(wanted))


def stage_join(source: DataFrame, *stages: DataFrame, key: str = "example_id", checked: bool = True, names: Sequence[str] | None = None, seen: Observation | None = None) -> DataFrame:
    """Source rows with the columns of each stage, one to one; of columns that share a name the first stays.

    Checked, every source row has to have one row of each stage, and no stage may hold a key twice, a blank one, or one
    that the source lacks: the action on the result raises where one is found, with the stage's name (`names`). `seen`
    then counts the rows of each side (source, stage_1, ...) on the way. All sides are read once and meet in one exchange by
    key, whatever their number. A source may repeat a key. Unchecked, it is a chain of inner joins by the key."""
    if not checked:
        out = source
        for stage in stages:
            out = out.join(stage.select(key, *[c for c in stage.columns if c not in out.columns]), key)
        return out
    sides, columns = _sided(source, stages, key)
    if seen is not None:
        sides = sides.observe(seen, *(F.count_if(F.col("__side") == k).alias(f"stage_{k}" if k else "source") for k in range(len(stages) + 1)))
    out = _kept(sides, _faults(key, len(stages), names, True), F.col("__side") == 0)
    return out.select(*source.columns, *(F.col(f"__s{k}.{c}").alias(c) for k, own in enumerate(columns, 1) for c in own))


def pending(source: DataFrame, done: DataFrame, key: str, checked: bool = True) -> DataFrame:
    """Source rows that no record of `done` covers. Checked, the action raises for records whose key is blank, repeated or not
    the source's; both sides are read once and meet in one exchange."""
    if not checked:
        return source.join(done.select(key), key, "left_anti")
    sides, _ = _sided(source, [done.select(key)], key)
    return _kept(sides, _faults(key, 1, ["records"], False), (F.col("__side") == 0) & (F.col("__n1") == 0)).select(*source.columns)


def latest(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of each key with the largest ordinal, by partial maxima."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r"))
    return kept.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def compared(probe: DataFrame, samples: DataFrame, key: str = "uuid", ordinal: str | None = None) -> DataFrame:
    """Probe rows with the model's sample of the same key, the one of the largest `ordinal` (by default the last that is
    read); `matched` tells whether there is one, `same_gold` whether its gold label agrees."""
    right = samples.select(key, F.col("gold").alias("sample_gold"), "pred_raw", "pred_norm", F.lit(True).alias("__has"), (F.col(ordinal) if ordinal else F.monotonically_increasing_id()).alias("__at"))
    out = probe.join(latest(right, key, "__at").drop("__at"), key, "left")
    return out.withColumn("matched", F.coalesce("__has", F.lit(False))).withColumn("same_gold", F.coalesce(F.col("gold") == F.col("sample_gold"), F.lit(False))).drop("__has")


def audit(joined: DataFrame) -> DataFrame:
    """One row: probe rows, matched and unmatched ones, and matched ones whose gold labels differ."""
    return joined.agg(
        F.count(F.lit(1)).alias("n_probe"),
        F.count_if("matched").alias("n_matched"),
        F.count_if(~F.col("matched")).alias("n_unmatched"),
        F.count_if(F.col("matched") & ~F.col("same_gold")).alias("n_gold_mismatch"),
    )


def overlap(joined: DataFrame) -> DataFrame:
    """The matched rows; an error if there are none."""
    out = joined.where("matched")
    if out.isEmpty():
        raise IntegrityError("no key of the probe's rows is among the samples")
    return out


def conflicting(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n_labels, n_rows) of keys whose rows bear more than one label."""
    by = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("__n"))
    return by.groupBy(key).agg(F.count(F.lit(1)).alias("n_labels"), F.sum("__n").alias("n_rows")).where("n_labels > 1")


def without_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    return rows.join(conflicting(rows, key, label).select(key), key, "left_anti")
