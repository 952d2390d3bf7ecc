"""Continuous stages, and windows over event time. The latter are extensions: batch stages have no notion of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stage(spark: SparkSession, source: str, schema: StructType, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "example_id") -> StreamingQuery:
    """Records of files as they arrive in `source`, appended to `out`; what is there then is taken and the query ends. The
    checkpoint remembers the files that are done, and a batch that was written when its run failed isn't written twice."""

    def write(rows: DataFrame, batch: int) -> None:
        made = make(rows.dropDuplicates([key])).withColumn("batch_id", F.lit(batch))
        made.write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, event_type, n) of tumbling windows; events later than the watermark are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
