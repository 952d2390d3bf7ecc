"""The corpus pipeline: stages over documents, each reading all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever other columns there are and however they are
called. An empty table gives no rows at any stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import exact_dedup, language, mixing, near_dedup, packing
from heddle.llm.common import apart, read, settled, tables

#: Mean posterior of a text's language below which the text goes; a text of two languages in equal parts has one half.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those that are `und` or of a score below LEAST_SCORE go, and so do null and
    empty texts. A document without an id is judged as the others, but not learnt from; repeated rows go or stay alike."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    labelled, columns = apart(docs, lambda d: language.identify(d, model), ("lang_pred", "score"))
    return labelled.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id, and one row of it. Null and empty texts
    are one group; a document without an id stays only where no other has its text."""
    return exact_dedup.drop_exact(docs, once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one with the least doc_id; of rows with
    that id, the one whose text has the least digest. Texts without a word are linked with nothing and stay."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the sources' targets want; a repeated one is a row each time. A null source is a
    source; null and empty texts have no words and come as often as the others of their draw."""
    mixed, columns = apart(docs, mixing.mix, ("size", "source_size", "target", "copies"))
    return mixing.repeated(mixed).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences; a text without tokens is its end alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language identification, sketches and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes as soon as its rows are written."""
    docs, since = read(spark, sf_dir, "documents"), tables()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
