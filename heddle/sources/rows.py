"""Readers of JSON rows and documents, snapshots and run folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import slug


class TornFile(ValueError):
    """A malformed line elsewhere than at the end of a file."""


def json_rows(spark: SparkSession, path: str | list[str], schema: StructType, torn_end: bool = False) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped and a malformed line raises.

    With `torn_end`, each file's last line may be cut off, as a writer that was stopped leaves it; it is left out."""
    if not torn_end:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    held = StructType([*schema, StructField("__bad", StringType())])
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    # One pass looks at the lines of all files, whose faults and ends meet by file after they have been summed in tasks.
    bad, place = F.col("r.__bad").isNotNull(), F.struct("__block", "__at")
    ends = parsed.groupBy("__file").agg(F.count_if(bad).alias("n"), F.max(F.when(bad, place)).alias("bad_at"), F.max(place).alias("end_at"))
    worse = ends.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("bad_at") != F.col("end_at")))).first()
    if worse is not None:
        raise TornFile(f"malformed lines in {worse['__file']}")
    return parsed.where(F.col("r.__bad").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema])


def numbered(df: DataFrame, name: str = "source_row_index") -> DataFrame:
    """Rows of one file with their ordinal from 0 in reading order. Partitions are counted, not gathered: a row's ordinal
    is its place in its partition after the rows of those before."""
    x = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = x.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    starts, at = [], 0
    for r in counts:
        starts.append((r["__part"], at))
        at += r["n"]
    starts = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = x.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def json_files(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """JSON lines of several files in the order of `paths`, with file_order, the file's stem, the ordinal in it and an
    example_id of both."""
    out = None
    for k, path in enumerate(paths):
        stem = re.sub(r"\.[^.]*\Z", "", path.rstrip("/").rsplit("/", 1)[-1])
        one = numbered(json_rows(spark, path, schema)).withColumns({"file_order": F.lit(k), "stem": F.lit(stem)})
        out = one if out is None else out.unionByName(one)
    return out.withColumn("example_id", F.format_string("%s:%05d", F.col("stem"), F.col("source_row_index")))


def small_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, also of one that readers of tables pass over for its name; None where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def template(spark: SparkSession, path: str) -> str:
    """A small text file as a whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def line_count(spark: SparkSession, path: str) -> int:
    """Lines of text files that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def has_rows(spark: SparkSession, path: str, least: int = 1, exactly: int | None = None) -> bool:
    """Whether a text file is there with enough lines, or with exactly so many."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    n = line_count(spark, path)
    return n >= least if exactly is None else n == exactly


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A row per JSON document, with its file's path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def snapshot(spark: SparkSession, root: str, name: str, config: str | None = None, split: str | None = None, nested: bool = True, fallback=None) -> DataFrame:
    """A dataset's local Parquet snapshot: <root>/<slug>/<split>, or <root>/<slug> with a split column if not nested. Without
    one, `fallback(spark)` is read and written there, or, without that, an error raised."""
    path = f"{root}/{slug(name, config)}" + (f"/{split}" if nested and split else "")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        if fallback is None:
            raise FileNotFoundError(f"no snapshot at {path}")
        fallback(spark).write.parquet(path)
    out = spark.read.parquet(path)
    return out if nested or not split else out.where(F.col("split") == split)


def run_folders(spark: SparkSession, root: str, required: tuple[str, ...], groups: tuple[str, ...] = ()) -> DataFrame:
    """(group, run_key, folder) of each folder below `root` that holds all required files, in order of group and key. The
    group is the first folder below root if it is one of `groups`, else Unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(required) + "}").load(root).select("path")
    folders = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    whole = folders.groupBy("folder").agg(F.collect_set("file").alias("files")).where(F.size(F.array_except(F.array(*map(F.lit, required)), "files")) == 0)
    parts = F.split("folder", "/")
    group = F.coalesce(F.get(F.filter(parts, lambda p: p.isin(*groups) if groups else F.lit(False)), F.lit(0)), F.lit("Unknown"))
    return whole.select(group.alias("group"), F.element_at(parts, -1).alias("run_key"), "folder").orderBy("group", "run_key")


def few_shots(spark: SparkSession, path: str, n: int) -> list[dict]:
    """The first n worked examples of a JSON list; an error if there are fewer or one lacks a key."""
    if n <= 0:
        return []
    schema = StructType([StructField(c, StringType()) for c in ("id", "category", "question", "tools", "answer")])
    read = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__at", F.monotonically_increasing_id())
    rows = [r.asDict() for r in read.orderBy("__at").limit(n).drop("__at").collect()]
    if len(rows) < n:
        raise ValueError(f"{n} examples are wanted; {path} has {len(rows)}")
    if lacking := [k for r in rows for k in ("question", "tools", "answer") if not r[k]]:
        raise ValueError(f"an example lacks {lacking[0]}")
    return rows


def sliced(rows: DataFrame, ordinal: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows from an ordinal on, the first `most` of them."""
    out = rows.where(F.col(ordinal) >= start)
    return out if most is None else out.orderBy(ordinal).limit(most)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Stored features; old files have no layer columns, which are then those of the last layer."""
    out = spark.read.parquet(path)
    defaults = {"layer_tag": F.lit("last"), "transformer_layer": F.lit(None).cast("int"), "hidden_state_index": F.lit(-1)}
    return out.withColumns({c: F.coalesce(F.col(c), d) if c in out.columns else d for c, d in defaults.items()})
