"""Bars and intraday points of one instrument, raw or adjusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordering import recent_ascending
from quotemill.plans.params import BarQuery, PointQuery, iso_date, moment, until_bound

FACTOR_COLUMN = {"qfq": "qfq_factor", "hfq": "hfq_factor"}
PRICES = ("open", "high", "low", "close")


class MissingFactorError(ValueError):
    """A bar of an adjusted request has no factor; raw and adjusted prices are never mixed."""


def between(column: str, since: str, until: str, dates: bool) -> Column:
    """The time filter of a query; of date columns both bounds count, of time columns see until_bound."""
    found = F.lit(True)
    if since:
        found &= F.col(column) >= F.lit(iso_date(since) if dates else moment(since)[0])
    if until and dates:
        found &= F.col(column) <= F.lit(iso_date(until))
    elif until:
        at, how = until_bound(until)
        found &= F.col(column) < F.lit(at) if how == "<" else F.col(column) <= F.lit(at)
    return found


def bars(table: DataFrame, query: BarQuery, time: str) -> DataFrame:
    """Rows of the instrument in time order: the first ones from since, or, without bounds, the most recent ones."""
    q = query.checked()
    rows = table.filter((F.col("market") == q.market) & (F.col("symbol") == q.symbol) & between(time, q.since, q.until, q.period == "1d"))
    return rows.orderBy(time).limit(q.limit) if q.bounded else recent_ascending(rows, time, q.limit)


def adjusted(rows: DataFrame, factors: DataFrame, adjust: str) -> DataFrame:
    """rows with prices scaled by their day's factor and the factor; volume and amount stay. A day without one has null prices.

    The limit of the rows counts raw bars, so it is taken before this join. Factors are joined by instrument and day.
    """
    key = ["market", "symbol", "trade_date"]
    joined = rows.join(factors.select(*key, F.col(FACTOR_COLUMN[adjust]).alias("factor")), key, "left")
    return joined.select(*[(F.col(c) * F.col("factor")).alias(c) if c in PRICES else F.col(c) for c in rows.columns], "factor")


def checked_adjusted(rows: DataFrame, factors: DataFrame, query: BarQuery, time: str) -> DataFrame:
    """The adjusted bars of a request in time order, or an error naming the first day that has no factor."""
    found = adjusted(bars(rows, query, time), factors.filter((F.col("market") == query.market) & (F.col("symbol") == query.symbol)), query.adjust)
    gap = found.filter("factor is null").agg(F.min("trade_date")).first()[0]
    if gap is not None:
        raise MissingFactorError(f"missing {query.adjust} factor for {query.market}:{query.symbol} on {gap}")
    return found.orderBy(time)


def intraday_points(table: DataFrame, query: PointQuery) -> DataFrame:
    q = query.checked()
    own = table.filter((F.col("market") == q.market) & (F.col("symbol") == q.symbol))
    if q.date:
        return own.filter(F.col("trade_date") == F.lit(iso_date(q.date))).orderBy("trade_date", "point_index").limit(q.limit)
    return own.filter(between("point_time", q.since, q.until, False)).orderBy("point_time").limit(q.limit)
