"""Summaries of stage records: (measure, value, n), in one pass with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarized(rows: DataFrame, values: dict[str, Column], totals: dict[str, Column], most: dict[str, Column] | None = None) -> DataFrame:
    """Of each measure in `values`, the rows of each value that isn't null; of each in `totals`, the rows that it holds for,
    or the sum of a number; of each in `most`, the largest number. The latter two have an empty value, and 0 where no row
    counts; no rows give no measures."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    item = lambda m, v, n, top: F.struct(F.lit(m).alias("measure"), v.cast("string").alias("value"), n.alias("n"), top.alias("top"))
    items = [item(m, v, one, zero) for m, v in values.items()]
    items += [item(m, F.lit(""), F.coalesce(t.cast("long"), zero), zero) for m, t in totals.items()]
    items += [item(m, F.lit(""), zero, F.coalesce(t.cast("long"), zero)) for m, t in (most or {}).items()]
    long = rows.select(F.inline(F.array(*items))).where("value is not null")
    return long.groupBy("measure", "value").agg((F.sum("n") + F.max("top")).alias("n"))


def _reason(valid: Column, reason: Column) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)) & (reason != ""), reason)


def initial_outputs(rows: DataFrame) -> DataFrame:
    """Of records (class, structural_kind, valid, reason)."""
    c = F.col
    values = {"output_class_counts": c("class"), "structural_kind_counts": c("structural_kind"), "invalid_reason_counts": _reason(c("valid"), c("reason"))}
    return summarized(rows, values, {"valid_rows": c("valid")})


def critiques(rows: DataFrame) -> DataFrame:
    """Of records (final_valid, attempts, fallback_used, invalid_attempts, missing_by_attempt: array<array<string>>)."""
    c = F.col
    wide = summarized(rows, {}, {"final_valid_rows": c("final_valid"), "retry_rows": c("attempts") > 1, "fallback_rows": c("fallback_used"), "invalid_attempt_total": c("invalid_attempts")})
    fields = rows.select(F.explode(F.flatten("missing_by_attempt")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return wide.unionByName(fields.select(F.lit("missing_field_counts").alias("measure"), "value", "n"))


def revisions(rows: DataFrame) -> DataFrame:
    """Of records (class, structural_kind, valid, reason, used_original)."""
    c = F.col
    values = {"revision_class_counts": c("class"), "structural_kind_counts": c("structural_kind"), "invalid_reason_counts": _reason(c("valid"), c("reason"))}
    return summarized(rows, values, {"used_original_without_generation_rows": c("used_original")})


def pairs(rows: DataFrame) -> DataFrame:
    """Of records (response_a, response_b, class_a, class_b, sampling_attempts)."""
    c = F.col
    return summarized(
        rows,
        {"response_a_class_counts": c("class_a"), "response_b_class_counts": c("class_b")},
        {"duplicate_rows": c("response_a") == c("response_b"), "resampled_rows": c("sampling_attempts") > 2},
        {"max_sampling_attempts": c("sampling_attempts")},
    )


def preferences(rows: DataFrame) -> DataFrame:
    """Of records (behavior_class, valid, chosen_class, failure_reason)."""
    c = F.col
    return summarized(rows, {"valid_counts": F.when(c("valid"), c("behavior_class")), "chosen_class_counts": F.nullif(c("chosen_class"), F.lit("")), "failure_counts": F.nullif(c("failure_reason"), F.lit(""))}, {})


def exports(rows: DataFrame) -> DataFrame:
    """Of records (behavior_class, selected, structural_kind, valid): rows to be exported as training data."""
    c = F.col
    has = F.coalesce(c("selected"), F.lit("")) != ""
    values = {"exported_counts": F.when(has, c("behavior_class")), "revised_structural_kind_counts": F.nullif(c("structural_kind"), F.lit("")), "revised_valid_counts": F.when(c("valid"), "valid").otherwise("invalid")}
    return summarized(rows, values, {"empty_revised_rows": ~has})
