"""The operators' queries over the whole tables, under the names that the driver calls them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, exact_dedup, extraction, interaction, language, mixing, near_dedup, packing, pii, quality, tokens, urls
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables are made up, so this key is no secret.
    return pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), key="op3")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_exact(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group_near(read(spark, sf_dir, "documents"), size=3, threshold=0.85)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), texts=False)
    digest = F.sha2(F.array_join("items", ","), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("lang", "source", "text")).select("lang", "source", "part", "item", "value", "rank")


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "labels"))


def queries() -> dict:
    made = (op1_quality_rules, op2_mixing, op3_pii, op4_exact_dedup, op5_language_id, op6_packing, op7_near_dedup, op8_html_extraction, op9_url_filter, op10_token_counts)
    return {f.__name__: f for f in (*made, op11_decontamination, op12_source_divergence, op13_filter_interaction)}
