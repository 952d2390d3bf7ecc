"""What the operators of this subpackage share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the word separator of the contracts, as a Java regex class.
WORD = r"[^\x20\x09-\x0D]+"
#: Where intermediate tables go when a session on a single machine names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or LOCAL_SHARED where it is unset and the master
    is local. On a cluster a machine's own folder would lose rows, so there the setting has to be made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


#: Paths of the written tables that are still there, the oldest first.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs no recomputation. The files go when a table made from it is `settled`, or else when the driver's JVM
    ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return kept(df.sparkSession, path, df.schema)


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at `path`, whose files go as those of `written` do."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    _TABLES.append(path)
    return spark.read.schema(schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: The setting of how many rows go to a Python worker at a time.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Has tables that are `written` within send at most so many rows to a Python worker at a time, for wide rows."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Rows of whole texts that a Python worker holds unpacked at a time.
UNPACKED = 1024


def parts(batches: Iterable[pa.RecordBatch], rows: int = UNPACKED) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of at most so many rows, so that memory doesn't follow the size of a batch."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def tidied(work: Callable) -> Callable:
    """A task's function on batches that gives freed memory back to the system when it ends: a worker process stays for
    further tasks, and what its allocators keep would count against the executor's memory meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """`df`, written as by `written`; the tables written since there were `since` of them, which it was made from, go."""
    out = written(df, name)
    spare = _TABLES[since:-1]
    del _TABLES[since:-1]
    for path in spare:
        files, at = _files(df.sparkSession, path)
        files.delete(at, True)
    return out


def tables() -> int:
    """How many tables are written and still there."""
    return len(_TABLES)


def apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """operator(docs), and the columns that give back those of `docs`, also those that are called like one of `names`,
    which the operator adds."""
    own = {c: f"__own_{c}" for c in docs.columns if c in set(names)}
    return operator(docs.withColumnsRenamed(own)), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text in hexadecimal, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


#: Marked rows up to which they go to every task.
MOST_MARKED = 1_000_000


def without(docs: DataFrame, text: Column, marks: DataFrame) -> DataFrame:
    """`docs` without the rows that `marks` (doc_id, text_sha256, once) name by doc_id and digest of `text`; where once is
    true, one of the rows stays. A row's own verdict counts, so others with its doc_id, or a null one, stay. Texts don't
    shuffle unless marks outgrow MOST_MARKED, but for those of which one is to stay; they meet map-side first."""
    marks = written(marks.select(F.col("doc_id").alias("__of"), F.col("text_sha256").alias("__sha"), F.col("once").alias("__once")), "marks")
    sent = F.broadcast(marks) if marks.count() <= MOST_MARKED else marks
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__digest": digest_of(text)})
    fits = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__digest") == F.col("__sha"))
    left = keyed.join(sent, fits, "left_anti")
    if not marks.where("__once").isEmpty():
        left = left.unionByName(keyed.join(sent.where("__once"), fits, "left_semi").dropDuplicates(["__id", "__digest"]))
    return left.select(*docs.columns)


def lowest(hash64: Column, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash is among about the 2 * wanted lowest of so many: hashes are even, so a share of their range
    holds that share of the rows. What is kept can be collected, whatever the number of tasks, and cut to size."""
    return hash64 <= F.lit(int(-(2**63) + min(1.0, (2 * wanted + 64) / max(rows, 1)) * (2**64 - 1025)))
