"""Ranked, pivoted and marked result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M

#: Values this near count as equal.
EPSILON = 1e-12
PENDING = "Pending probe run"


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., n, percent) of each combination of values, nulls kept; percent of all rows to two decimals, half to even."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # The total is a subquery of one number, to which each task adds one; the groups stay where they were counted.
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.rint(F.lit(100.0) * F.col("n") / whole * 100) / 100)


def overview(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(metric, n, percent) of each flag, in one pass."""
    wide = rows.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(c).alias(f"f{k}") for k, c in enumerate(flags.values())])
    row = lambda k, name: F.struct(F.lit(name).alias("metric"), F.col(f"f{k}").alias("n"), (F.rint(F.lit(100.0) * F.col(f"f{k}") / F.greatest(F.col("all"), F.lit(1)) * 100) / 100).alias("percent"))
    return wide.select(F.inline(F.array(*[row(k, name) for k, name in enumerate(flags)])))


def crosstab(rows: DataFrame, by: str, across: str, values: tuple[str, ...]) -> DataFrame:
    """(by, a column per value): counts, zero where there are none."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(across) == v).alias(v) for v in values])


def pivoted(rows: DataFrame, by: list[str], across: str, values: tuple[str, ...], value: str, order: str, fill: float | None = 0.0) -> DataFrame:
    """(by..., a column per value of `across`): the value of the first row by `order`; `fill` where there is none (None: null)."""
    first = [F.min_by(F.when(F.col(across) == v, F.col(value)), F.when(F.col(across) == v, F.col(order))).alias(v) for v in values]
    out = rows.groupBy(*by).agg(*first)
    return out if fill is None else out.na.fill(fill, list(values))


def dense_ranks(rows: DataFrame, parent: str, columns: list[str]) -> DataFrame:
    """`rows` with <column>_rank: 1 for the largest value within the parent, equal values alike."""
    return rows.withColumns({f"{c}_rank": F.dense_rank().over(Window.partitionBy(parent).orderBy(F.col(c).desc())) for c in columns})


def best_layer(rows: DataFrame, parent: str, position: str) -> DataFrame:
    """(parent, layer_tag): of the largest accuracy, then macro F1, then the earlier layer."""
    return rows.groupBy(parent).agg(F.max_by("layer_tag", F.struct("accuracy", "macro_f1", -F.col(position))).alias("layer_tag"))


def selection(rows: DataFrame, parent: str, position: str) -> DataFrame:
    """`rows` with accuracy_rank, macro_f1_rank, chosen and selection_reason, the latter on the chosen layer of each parent."""
    order = Window.partitionBy(parent).orderBy(F.col("accuracy").desc(), F.col("macro_f1").desc(), position)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = dense_ranks(rows, parent, ["accuracy", "macro_f1"])
    x = x.withColumns({"__place": F.row_number().over(order), "__acc": F.lead("accuracy").over(order), "__f1": F.lead("macro_f1").over(order), "__pending": F.bool_and("is_placeholder").over(whole)})
    tie = F.abs(F.col("accuracy") - F.col("__acc")) <= EPSILON
    reason = (
        F.when(F.col("__pending"), PENDING)
        .when(F.col("__acc").isNull() | ~tie, "Highest accuracy")
        .when(F.col("macro_f1") > F.col("__f1") + EPSILON, "Accuracy tie; higher macro-F1")
        .otherwise("Tie after accuracy and macro-F1")
    )
    x = x.withColumn("chosen", F.col("__place") == 1)
    return x.withColumn("selection_reason", F.when(F.col("chosen"), reason).otherwise("")).drop("__place", "__acc", "__f1", "__pending")


def best_parameter(rows: DataFrame, by: str, parameter: str, score: str, position: str) -> DataFrame:
    """(by, parameter) of the largest score; the earlier wins ties."""
    return rows.groupBy(by).agg(F.max_by(parameter, F.struct(score, -F.col(position))).alias(parameter), F.max(score).alias(score))


def with_ranks(runs: DataFrame) -> DataFrame:
    """`runs` with the rank columns that they are shown in order of; columns that `runs` lacks rank 99."""
    has = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast("string")
    return runs.withColumns(
        {
            "family_rank": M.looked_up(F.col("model_family"), M.FAMILY_RANK, M.MISSING_RANK),
            "run_group_rank": M.looked_up(has("run_group"), M.GROUP_RANK, M.MISSING_RANK),
            "probe_source_rank": M.looked_up(has("probe_source_variant"), M.SOURCE_RANK, M.MISSING_RANK),
            "probe_setting_rank": M.looked_up(has("probe_eval_setting"), M.SETTING_RANK, M.MISSING_RANK),
            "variant_rank": M.variant_rank(has("run_group"), has("variant_label")),
        }
    )


RANKS = ("family_rank", "run_group_rank", "probe_source_rank", "probe_setting_rank", "variant_rank", "run_key")


def sorted_runs(runs: DataFrame) -> DataFrame:
    return with_ranks(runs).orderBy(*RANKS)


def unique_displays(runs: DataFrame) -> DataFrame:
    """`runs` with their key added to a display name that others share."""
    n = F.count(F.lit(1)).over(Window.partitionBy("run_display"))
    return runs.withColumn("run_display", F.when(n > 1, F.concat("run_display", F.lit(" ("), "run_key", F.lit(")"))).otherwise(F.col("run_display")))


def missing_keys(existing: DataFrame, expected: DataFrame, key: str = "run_key") -> DataFrame:
    """Keys of `expected` that `existing` lacks."""
    return expected.select(key).distinct().join(existing.select(key), key, "left_anti")


def is_subset(a: Column, b: Column) -> Column:
    """Whether each value of one array is in the other; of an empty one, it is."""
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, however often and in whatever order."""
    return is_subset(a, b) & is_subset(b, a)


def value_sets(rows: DataFrame, by: str, value: str, expected: tuple[str, ...]) -> DataFrame:
    """(by, n_values, covers, within, same, missing): how the values of each group stand to the expected ones. Distinct values
    are found by partial aggregation; a group's are as few as the values there are."""
    x = rows.groupBy(by).agg(F.collect_set(value).alias("__v"))
    wanted = F.array(*map(F.lit, expected))
    missing = F.array_sort(F.array_except(wanted, F.col("__v")))
    return x.select(by, F.size("__v").alias("n_values"), is_subset(wanted, F.col("__v")).alias("covers"), is_subset(F.col("__v"), wanted).alias("within"), same_set(F.col("__v"), wanted).alias("same"), F.array_join(missing, ",").alias("missing"))


def placeholders(missing: DataFrame, scorings: tuple[str, ...], classes: tuple[str, ...], key: str = "run_key") -> DataFrame:
    """A row of zeros for each missing key, scoring and class, made by unfolding literals in place."""
    zero = F.lit(0.0)
    out = missing.select(key, F.explode(F.array(*map(F.lit, scorings))).alias("scoring"))
    out = out.select("*", F.explode(F.array(*map(F.lit, classes))).alias("label"))
    return out.withColumns({"accuracy": zero, "macro_f1": zero, "is_placeholder": F.lit(True)})


def pending_probes(missing: DataFrame, scorings: tuple[str, ...], classes: tuple[str, ...], key: str = "run_key") -> DataFrame:
    """Placeholders of probes that are still to be run."""
    return placeholders(missing, scorings, classes, key).withColumn("is_probe_pending", F.lit(True))


def with_panels(pending: DataFrame, panels: DataFrame, key: str = "run_display") -> DataFrame:
    """Pending rows with the panel that their run is shown in; rows without one stay. `panels` has a row per run."""
    return pending.join(panels.select(key, "panel").dropDuplicates([key]), key, "left")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(column, n), the commonest value first, equal numbers by value."""
    return counts_of(rows, column).orderBy(F.desc("n"), column)


def counts_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def extrema(rows: DataFrame, preferences: dict[str, str], eligible: Column | None = None) -> DataFrame:
    """`rows` with <column>_best: whether a value is its column's max or min among eligible rows, to within EPSILON.
    The extremes are one row, joined to all."""
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    wanted = {c: p for c, p in preferences.items() if p in ("max", "min")}
    best = rows.agg(*[(F.max if p == "max" else F.min)(F.when(ok, F.col(c))).alias(f"__{c}") for c, p in wanted.items()])
    out = rows.withColumn("__one", F.lit(1)).join(F.broadcast(best.withColumn("__one", F.lit(1))), "__one")
    marks = {f"{c}_best": (F.coalesce(ok & (F.abs(F.col(c) - F.col(f"__{c}")) <= EPSILON), F.lit(False)) if c in wanted else F.lit(False)) for c in preferences}
    return out.withColumns(marks).drop("__one", *[f"__{c}" for c in wanted])


def latex_table(rows: list[list[str]], header: list[str], caption: str, label: str) -> str:
    """A booktabs table of cells that are escaped already."""
    lines = ["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{l{'r' * (len(header) - 1)}}}", "\\toprule", " & ".join(header) + " \\\\", "\\midrule"]
    return "\n".join([*lines, *[" & ".join(r) + " \\\\" for r in rows], "\\bottomrule", "\\end{tabular}", "\\end{table}", ""])
