"""Adjusted bars by validity intervals: one row of factors for each corporate action instead of each day, and bars that stay where they lie.

Bars are stored in buckets of instruments, sorted by time. An instrument's intervals, some hundreds at most, are one array; the arrays are dealt to the buckets, and
each bar looks its interval up. The bars' side of the join has no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.timeseries import BLOCKING, action_ratios
from quotemill.plans.bars import PRICES

KEY = ["market", "symbol"]
BUCKETS = 16


def factor_intervals(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """market, symbol, valid_from (null: always), valid_to (exclusive; null: for ever), qfq_factor, hfq_factor, for symbols with actions; null factors where an issue blocks them."""
    ratios, issue = action_ratios(bars, actions), F.col("issue")
    moves = ratios.groupBy(*KEY, "event_date").agg(F.coalesce(F.sum(F.when(issue.isNull(), F.log("ratio"))), F.lit(0.0)).alias("move"), F.max(F.coalesce(issue.isin(*BLOCKING), F.lit(False))).alias("blocks"))
    start = moves.select(*KEY).distinct().select(*KEY, F.lit(None).cast("date").alias("event_date"), F.lit(0.0).alias("move"), F.lit(False).alias("blocks"))
    own = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("event_date"))
    every = Window.partitionBy(*KEY)  # a symbol's actions, some hundreds
    past, whole, free = F.sum("move").over(own), F.sum("move").over(every), ~F.max("blocks").over(every)
    rows = moves.unionByName(start).select(*KEY, F.col("event_date").alias("valid_from"), F.lead("event_date").over(own).alias("valid_to"), past.alias("past"), whole.alias("whole"), free.alias("free"))
    factor = lambda exponent: F.when(F.col("free"), F.exp(exponent))
    return rows.select(*KEY, "valid_from", "valid_to", factor(F.col("whole") - F.col("past")).alias("qfq_factor"), factor(-F.col("past")).alias("hfq_factor"))


def bucketed(bars: DataFrame, path: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bars as a table in buckets of instruments, sorted within by instrument and order."""
    name = f"bars_{uuid.uuid4().hex}"
    bars.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY, *order).option("path", path).saveAsTable(name)
    return bars.sparkSession.table(name)


def adjusted(bars: DataFrame, intervals: DataFrame, adjust: str, date: str = "trade_date") -> DataFrame:
    """bars with prices scaled by the factor of their day's interval, and the factor; 1 for symbols without actions. bars in buckets of instruments are not moved."""
    own = intervals.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("at"), F.col(f"{adjust}_factor").alias("factor")))).alias("_steps"))
    joined = bars.join(own.hint("merge"), KEY, "left")
    step = F.size(F.filter("_steps", lambda s: s["at"] <= F.col(date)))
    factor = F.when(F.col("_steps").isNull(), F.lit(1.0)).otherwise(F.try_element_at("_steps", step)["factor"])
    rows = joined.withColumn("factor", factor).drop("_steps")
    return rows.select(*[(F.col(c) * F.col("factor")).alias(c) if c in PRICES else F.col(c) for c in bars.columns], "factor")
