"""A file stream that appends versions of rows, and the newest-version view over them.

Each micro-batch is appended with its batch number as the commit sequence under a folder of its own, so a batch that is run again
after a failure replaces what it wrote before, and a read never depends on the order of files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotemill.operators.latest import newest

COMMIT = "_commit_seq"


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Starts a query that lands every new Parquet file below source in the versioned table at target, until none is left."""

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{COMMIT}={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: Sequence[str], tie: str) -> DataFrame:
    """The newest row of every key; within a batch the one of the greatest tie column."""
    rows = spark.read.option("basePath", target).parquet(target)
    version = F.struct(F.col(COMMIT).cast("long"), F.col(tie))
    return newest(rows.withColumn("_version", version), key, "_version").drop(COMMIT)


def windowed_volume(rows: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Per instrument and window the volume and the number of rows, closing a window once no row of it can be on time."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), "market", "symbol").agg(F.sum("volume").alias("volume"), F.count("*").alias("row_count"))
