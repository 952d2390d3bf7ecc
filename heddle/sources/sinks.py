"""Writers of rows, summaries and previews."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.probe import Probe
from ..operators.report import latex_table


def write_rows(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; a job's output appears as a whole when it commits, or not at all."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("layer_tag").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file written under another name and then renamed over the old one in one step, so that readers have the old
    text or the new one, also where the writer dies on the way."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    at, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    over = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename(files.makeQualified(part), files.makeQualified(at), over)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    write_text(spark, json.dumps(document, ensure_ascii=False, indent=2) + "\n", path)


def write_preview(rows: DataFrame, ordinal: str, path: str, n: int = 20) -> None:
    """The first n rows in order."""
    write_rows(rows.orderBy(ordinal).limit(n), path)


def write_latex(spark: SparkSession, rows: DataFrame, columns: list[str], header: list[str], caption: str, label: str, path: str) -> None:
    """A report table, small by construction, as LaTeX; cells are escaped by the caller's columns."""
    cells = [[str(r[c]) for c in columns] for r in rows.select(*columns).collect()]
    write_text(spark, latex_table(cells, header, caption, label), path)


def write_model(model: Probe, path: str) -> None:
    """A fitted probe as a JSON document; numbers come back as they were."""
    arrays = {name: getattr(model, name).tolist() for name in ("mean", "deviation", "weights")}
    write_document(SparkSession.active(), {"labels": model.labels, **arrays}, path)


def read_model(path: str) -> Probe:
    stored = json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])
    return Probe(stored["labels"], *(np.array(stored[name]) for name in ("mean", "deviation", "weights")))
