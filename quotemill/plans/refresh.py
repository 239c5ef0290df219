"""Incremental maintenance of derived tables: what commits after the last refresh have touched is found, widened by the look-back, recomputed, and put in place of
the old rows by overwriting only the partitions concerned.

A refresh records the last commit it has taken in, after its rows are written; repeating one that was cut off writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.latest import newest
from quotemill.operators.segments import previous
from quotemill.operators.timeseries import percent_change
from quotemill.plans.derive import KEY, daily_derived
from quotemill.plans.imports import COMMIT, Dataset, read_facts

STATES = f"dataset string, {COMMIT} long"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def refreshed_to(spark: SparkSession, state_path: str, name: str) -> int:
    """The last commit that a derived table has taken in, 0 if none."""
    if not exists(spark, state_path):
        return 0
    return spark.read.schema(STATES).parquet(state_path).filter(F.col("dataset") == name).agg(F.max(COMMIT)).first()[0] or 0


def committed_after(spark: SparkSession, facts: Dataset, commit: int) -> DataFrame:
    """All rows of later commits. A file holds one commit, so the others' are left out by their statistics."""
    rows = spark.read.option("basePath", facts.path).parquet(facts.path)
    return rows.filter(F.col(COMMIT) > commit).drop("_part")


def put(spark: SparkSession, target: Dataset, fresh: DataFrame, gone: DataFrame, on: Sequence[str]) -> None:
    """Puts fresh rows in place of those whose values in the columns `on` are in gone. Only partitions that hold rows of either are written.

    gone needs the target's date column among `on`, from which the partitions follow.
    """
    fresh = fresh.withColumn("_part", target.partition)
    if exists(spark, target.path):
        parts = [r._part for r in gone.select(target.partition.alias("_part")).union(fresh.select("_part")).distinct().collect()]  # one for each year or month
        old = spark.read.option("basePath", target.path).parquet(target.path).withColumn("_part", F.col("_part").cast("string"))
        kept = old.filter(F.col("_part").isin(parts)).join(gone.select(*on).distinct(), list(on), "left_anti")
        fresh = fresh.unionByName(kept.select(*fresh.columns))
    placed = fresh.hint("rebalance", "_part").sortWithinPartitions("_part", *target.key)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(target.path)


def _taken(spark: SparkSession, state_path: str, name: str, commit: int) -> None:
    spark.createDataFrame([(name, commit)], STATES).write.mode("append").parquet(state_path)


def refresh_daily(spark: SparkSession, facts: Dataset, target: Dataset, state_path: str) -> int:
    """Brings the daily returns in target up to the last commit of facts, which it returns.

    A touched bar changes its own row and those after it up to the instrument's next bar with a close, whose look-back would pass it. Only the touched
    instruments' history is read; deletions do not occur in facts.
    """
    after = refreshed_to(spark, state_path, target.name)
    news = committed_after(spark, facts, after)
    last = news.agg(F.max(COMMIT)).first()[0]
    if last is None:
        return after
    bars = read_facts(spark, facts).select(*KEY, "trade_date", "close")
    if not after:
        everything = daily_derived(bars)
        put(spark, target, everything, everything.select("trade_date").limit(0), ["trade_date"])
        _taken(spark, state_path, target.name, last)
        return last
    touched = news.select(*KEY, "trade_date").distinct()
    own = bars.join(touched.select(*KEY).distinct(), KEY, "left_semi").join(touched.withColumn("_new", F.lit(True)), [*KEY, "trade_date"], "left")
    year = F.year("trade_date")
    seen = previous(own, F.struct("trade_date", "close"), F.col("close") > 0, KEY, ["trade_date"], year, "_valid")
    seen = previous(seen, F.col("trade_date"), F.coalesce("_new", F.lit(False)), KEY, ["trade_date"], year, "_touched")
    reached = F.col("_touched").isNotNull() & (F.col("_valid").isNull() | (F.col("_valid.trade_date") <= F.col("_touched")))
    hit = seen.filter(F.coalesce("_new", F.lit(False)) | reached)
    fresh = hit.select(*KEY, "trade_date", F.col("_valid.close").alias("prev_close"), percent_change(F.col("close"), F.col("_valid.close")).alias("pct_chg"))
    put(spark, target, fresh, fresh.select(*KEY, "trade_date"), [*KEY, "trade_date"])
    _taken(spark, state_path, target.name, last)
    return last


def refresh_days(spark: SparkSession, facts: Dataset, target: Dataset, state_path: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Brings a table of rows by day up to the last commit of facts: the touched days are computed again from their newest facts. Returns that commit."""
    after = refreshed_to(spark, state_path, target.name)
    news = committed_after(spark, facts, after)
    last = news.agg(F.max(COMMIT)).first()[0]
    if last is None:
        return after
    days = news.select(facts.date).distinct()
    rows = spark.read.option("basePath", facts.path).parquet(facts.path).withColumn("_part", F.col("_part").cast("string"))
    parts = [r._part for r in days.select(facts.partition.alias("_part")).distinct().collect()]
    own = newest(rows.filter(F.col("_part").isin(parts)).drop("_part").join(days, facts.date, "left_semi"), facts.key, COMMIT)
    put(spark, target, compute(own), days.withColumnRenamed(facts.date, target.date), [target.date])
    _taken(spark, state_path, target.name, last)
    return last
