"""Derived tables: daily returns, adjustment factors (see operators.timeseries), minute scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.segments import previous
from quotemill.operators.timeseries import percent_change
from quotemill.plans.bars import between

KEY = ["market", "symbol"]


def daily_derived(bars: DataFrame, since: str = "", until: str = "") -> DataFrame:
    """market, symbol, trade_date, prev_close, pct_chg. The range is applied after the look-back over the whole history, which goes by years."""
    rows = previous(bars.select(*KEY, "trade_date", "close"), F.col("close"), F.col("close") > 0, KEY, ["trade_date"], F.year("trade_date"), "prev_close")
    return rows.select(*KEY, "trade_date", "prev_close", percent_change(F.col("close"), F.col("prev_close")).alias("pct_chg")).filter(between("trade_date", since, until, True))


def movers(derived: DataFrame, threshold: float, trade_date: str = "") -> DataFrame:
    """Rows of one day, or of all, whose change exceeds the threshold, largest first."""
    rows = derived.filter(between("trade_date", trade_date, trade_date, True))
    return rows.filter(F.col("pct_chg") > threshold).orderBy(F.desc("pct_chg"), *KEY)


def minute_scan(bars: DataFrame, time: str, since: str, until: str) -> DataFrame:
    """Minute returns against the raw previous bar in the range, across days. The first bar in the range has none. The look-back goes by days."""
    inside = bars.filter(between("trade_date", since, until, True))
    rows = previous(inside, F.col("close"), F.lit(True), KEY, ["trade_date", time], F.col("trade_date"), "prev_close")
    return rows.select("trade_date", time, *KEY, "close", "volume", "amount", "prev_close", percent_change(F.col("close"), F.col("prev_close")).alias("minute_ret"), F.lit(None).cast("double").alias("volume_ratio"))
