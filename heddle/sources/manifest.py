"""Tables of committed parts: a manifest names the folders that count, and is replaced in one step, so that a writer that dies
leaves the table as it was."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .rows import small_text
from .sinks import write_text

NAME = "_MANIFEST.json"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def parts(spark: SparkSession, path: str) -> list[dict]:
    """The committed parts of a table, in order: the folder of each and the batch that it holds. None where there is no table."""
    stored = small_text(spark, f"{path}/{NAME}")
    return [] if stored is None else json.loads(stored)["parts"]


def _written(rows: DataFrame, path: str) -> str:
    folder = f"part-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{folder}")
    return folder


def _commit(spark: SparkSession, path: str, committed: list[dict]) -> None:
    write_text(spark, json.dumps({"parts": committed}) + "\n", f"{path}/{NAME}")


def replace(rows: DataFrame, path: str, batch: str = "") -> None:
    """The table at `path` made anew of `rows`. Until all of them are written readers have the old table, then the new one;
    old parts stay until `vacuum`, so `rows` may be read from the table itself."""
    folder = _written(rows, path)
    _commit(rows.sparkSession, path, [{"folder": folder, "batch": batch}])


def append(rows: DataFrame, path: str, batch: str) -> bool:
    """Adds the rows of a batch, and tells whether it did: one that is there already isn't added again, so a writer may try
    as often as it likes. One writer at a time."""
    spark = rows.sparkSession
    if any(p["batch"] == batch for p in parts(spark, path)):
        return False
    folder = _written(rows, path)
    _commit(spark, path, [*parts(spark, path), {"folder": folder, "batch": batch}])
    return True


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed parts; an error where there is no table. A malformed line raises."""
    folders = [f"{path}/{p['folder']}" for p in parts(spark, path)]
    if not folders:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folders)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders that aren't committed, what dead writers and earlier versions left, and names them. No reader or
    writer may be at work."""
    files, at = _path(spark, path)
    kept = {p["folder"] for p in parts(spark, path)}
    gone = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName() not in kept]
    for folder in gone:
        files.delete(folder, True)
    return sorted(f.getName() for f in gone)
