"""A rank directory of a sorted table: pages at any depth, and totals, without sorting or counting again.

The table is written once in ranges of its order, each range a folder sorted within. The directory has a row for each range: how many rows it has and how many come before. A page
then reads the ranges that hold it; its rows are placed by their range's count and their place in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000


def build(rows: DataFrame, order: Sequence[Column | str], path: str, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Writes the table and its directory; returns the total. order must tell all rows apart, else equal rows have any order."""
    spark = rows.sparkSession
    total = rows.count()
    ranges = max(1, -(-total // rows_per_range))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))  # the row's place in its range
    placed.write.partitionBy("_range").parquet(f"{path}/rows")
    own = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own.select("_range", "n", before.alias("first")).coalesce(1).write.parquet(f"{path}/directory")  # one row for each range
    return total


def total(spark: SparkSession, path: str) -> int:
    """How many rows the table has, from the directory."""
    return spark.read.parquet(f"{path}/directory").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, limit: int, offset: int) -> DataFrame:
    """Rows offset to offset + limit of the order, with their rank from 0, in that order; only the ranges that hold them are read."""
    held = spark.read.parquet(f"{path}/directory").filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset)).collect()  # as many as a page meets
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("_range").isin([r["_range"] for r in held]))
    first = F.coalesce(*[F.when(F.col("_range") == r["_range"], F.lit(r["first"])) for r in held], F.lit(0))
    ranked = rows.withColumn("rank", (first + F.col("_at")).cast("long"))
    return ranked.filter((F.col("rank") >= offset) & (F.col("rank") < offset + limit)).drop("_range", "_at").orderBy("rank")
