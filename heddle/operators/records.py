"""Rows of messages: filters, projections, keys, labels and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import response_class, stripped
from ..functions.calls import tools_key
from ..schemas import PROBE_LABELS


def last(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))


def ends_with_assistant(messages: Column) -> Column:
    return F.coalesce(last(messages)["role"] == "assistant", F.lit(False))


def without_answer(messages: Column) -> Column:
    """Messages without a last one of the assistant's."""
    return F.when(ends_with_assistant(messages), F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def context(messages: Column) -> Column:
    """Messages before the answer; an error where there is none or it isn't the assistant's."""
    return F.when(ends_with_assistant(messages), F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(F.raise_error(F.lit("the last message has to be the assistant's")))


def with_answer(messages: Column, content: Column) -> Column:
    return F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), content.alias("content"))))


def example_id(stem: Column, ordinal: Column) -> Column:
    return F.format_string("%s:%05d", stem, ordinal)


def filled_or(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def behavior_label(explicit: Column, answer: Column, chosen: Column, allowed: tuple[str, ...] = PROBE_LABELS) -> Column:
    """An explicit label if allowed, else the class of the answer, else that of the chosen response, else null."""
    ok = lambda c: F.when(c.isin(*allowed), c)
    return F.coalesce(ok(explicit), F.when(answer.isNotNull(), ok(response_class(answer))), F.when(chosen.isNotNull(), ok(response_class(chosen))))


def canonical_record(tools: Column, messages: Column, source_split: str | Column, behavior_class: Column) -> list[Column]:
    """The four columns of a training record, in order."""
    split = F.lit(source_split) if isinstance(source_split, str) else source_split
    return [tools.alias("tools"), messages.alias("messages"), split.alias("source_split"), behavior_class.alias("behavior_class")]


def sft_pool(rows: DataFrame, classes: tuple[str, ...] = ("cannot_answer", "request_for_info", "other_plain_text")) -> DataFrame:
    """Records of the rows (tools, messages) that end with an answer of one of the classes."""
    label = response_class(last(F.col("messages"))["content"])
    return rows.where(ends_with_assistant(F.col("messages")) & label.isin(*classes)).select(*canonical_record(F.col("tools"), F.col("messages"), "train_sft", label))


def preference_pool(rows: DataFrame) -> DataFrame:
    """Records of the rows (tools, messages, chosen: a text) whose chosen response is a call, with it as the answer."""
    label = response_class(F.col("chosen"))
    return rows.where(label == "tool_call").select(*canonical_record(F.col("tools"), with_answer(F.col("messages"), F.col("chosen")), "train_pref_chosen", label))


def label_audit(rows: DataFrame, label: Column) -> DataFrame:
    """(label, n): rows of each label, and as `ignored` those without one, which no pool takes."""
    return rows.groupBy(F.coalesce(label, F.lit("ignored")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def request_key(messages: Column, tools: Column) -> Column:
    """What makes two rows one request: the first message's text, and the tools (JSON text) by name, the last of a name,
    whatever the order and spacing of their specifications."""
    return F.struct(stripped(F.coalesce(F.get(messages, F.lit(0))["content"], F.lit(""))).alias("request"), tools_key(tools).alias("tools"))


def sft_export(rows: DataFrame, response: Column) -> DataFrame:
    """Training rows with the response appended; rows without one are left out."""
    return rows.where(F.coalesce(response, F.lit("")) != "").select("tools", with_answer(F.col("messages"), response).alias("messages"), "source_split", "behavior_class")


def routed_preference(a: Column, b: Column, class_a: Column, class_b: Column, judged: Column) -> Column:
    """struct(valid, failure_reason, preferred, rejected, chosen_class) for two candidates and a judge's
    struct(valid, winner): candidates that are empty or equal are not judged."""
    failure = F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "empty_candidate").when(a == b, "duplicate_candidates").when(~F.coalesce(judged["valid"], F.lit(False)), "preference_parse_failed")
    ok, first = failure.isNull(), judged["winner"] == "A"
    pick = lambda x, y: F.when(ok, F.when(first, x).otherwise(y))
    return F.struct(ok.alias("valid"), failure.alias("failure_reason"), pick(a, b).alias("preferred"), pick(b, a).alias("rejected"), pick(class_a, class_b).alias("chosen_class"))


def distinct_candidates(samples: DataFrame, wanted: int = 2) -> DataFrame:
    """The first `wanted` distinct answers of each prompt, numbered: samples (example_id, attempt, answer)."""
    first = samples.groupBy("example_id", "answer").agg(F.min("attempt").alias("attempt"))
    place = F.row_number().over(Window.partitionBy("example_id").orderBy("attempt"))
    return first.withColumn("place", place).where(F.col("place") <= wanted)


def response_pairs(samples: DataFrame, **counted: Column) -> DataFrame:
    """(example_id, sampling_attempts, distinct_candidates_found, response_a, response_b) of samples (example_id, attempt,
    answer): the first two distinct answers, the last sample standing in for a second one. A prompt has a bounded number of
    samples. `counted` are further columns: how many of a prompt's samples meet each condition, counted in the same pass."""
    by = samples.groupBy("example_id", "answer").agg(F.min("attempt").alias("first"), F.max("attempt").alias("last"), F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"__n_{k}") for k, c in counted.items()))
    whole = by.groupBy("example_id").agg(F.sum("n").alias("sampling_attempts"), F.array_sort(F.collect_list(F.struct("first", "answer"))).alias("__d"), F.max_by("answer", "last").alias("__last"), *(F.sum(f"__n_{k}").alias(k) for k in counted))
    second = F.coalesce(F.get("__d", F.lit(1))["answer"], F.col("__last"))
    return whole.select("example_id", "sampling_attempts", F.size("__d").cast("long").alias("distinct_candidates_found"), F.get("__d", F.lit(0))["answer"].alias("response_a"), second.alias("response_b"), *counted)


def real(placeholder: Column) -> Column:
    """Whether a row is no placeholder; a row that doesn't say is real."""
    return ~F.coalesce(placeholder, F.lit(False))


def scored(scoring: Column, wanted: str, label: Column, labels: tuple[str, ...]) -> Column:
    """Whether a row is of one scoring and of a label in a list."""
    return F.coalesce((scoring == wanted) & label.isin(*labels), F.lit(False))


def first_of_each(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group. Rows go through a per-group top n; none but those n are kept while it sorts."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def last_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, text) of each conversation's last turn, found by partial maxima."""
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): a conversation's turns in order."""
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
