"""Token id arrays for training: prompts masked, truncation from the left, padding on the right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The label of tokens that bear no loss.
IGNORED = -100


def encoded(prompt: Column, target: Column, end: int, most: int) -> Column:
    """struct(input_ids, labels, attention_mask) of prompt and target ids: the end id follows the target if it isn't there
    already, labels hide the prompt, and only the last `most` tokens stay."""
    target = F.when(F.coalesce(F.try_element_at(target, F.lit(-1)) == end, F.lit(False)), target).otherwise(F.concat(target, F.array(F.lit(end))))
    ids = F.concat(prompt, target)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), target)
    tail = lambda x: F.slice(x, F.greatest(F.size(x) - most, F.lit(0)) + 1, most)
    return F.struct(tail(ids).alias("input_ids"), tail(labels).alias("labels"), F.transform(tail(ids), lambda _: F.lit(1)).alias("attention_mask"))


def padded(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """input_ids, labels and attention_mask filled on the right to the longest of their batch."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    x = rows.withColumn("__gap", longest - F.size("input_ids"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__gap")))
    return x.withColumns({"input_ids": fill("input_ids", pad), "labels": fill("labels", IGNORED), "attention_mask": fill("attention_mask", 0)}).drop("__gap")


def zero_types(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(0))


def truncation(length: Column, most: int) -> Column:
    """struct(truncated, extracted_index): whether a prompt was cut, and the last position that is left."""
    return F.struct((length > most).alias("truncated"), (F.least(length, F.lit(most)) - 1).alias("extracted_index"))
