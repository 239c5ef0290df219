"""Ordered, bounded and paged results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_ascending(df: DataFrame, order: str, n: int) -> DataFrame:
    """The most recent n rows, oldest first: two top-n steps, no full sort."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of the order, and one more: its presence says that there are further pages."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit + 1)


def part(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows of the order from offset on, at most limit of them; all of them without a limit, none if there are not so many."""
    rest = df.orderBy(*order).offset(max(offset, 0))
    return rest.limit(limit) if limit > 0 else rest


class TooManyRowsError(ValueError):
    """A result that must be complete exceeds its bound."""


def complete(df: DataFrame, bound: int) -> DataFrame:
    """df, or an error if it has more rows than the bound; each task counts its own."""
    if df.count() > bound:
        raise TooManyRowsError(f"more than {bound} rows")
    return df


def clamped(limit: int, usual: int = 20, most: int = 200) -> int:
    """A page size between 1 and most; the usual one if none is asked for."""
    return usual if limit <= 0 else min(limit, most)


def stalled_pages(pages: DataFrame, by: Sequence[str], number: str, first: str, last: str) -> DataFrame:
    """Pages of a backward read that do not end strictly before the page read before them begins."""
    earlier = F.lag(first).over(Window.partitionBy(*by).orderBy(number))
    return pages.withColumn("_earlier", earlier).filter(F.col(last) >= F.col("_earlier")).drop("_earlier")


def incomplete_catalogues(pages: DataFrame, by: Sequence[str], rows: str, total: str) -> DataFrame:
    """Catalogues whose pages disagree on the total, or do not add up to it."""
    found = pages.groupBy(*by).agg(F.sum(rows).alias("found"), F.min(total).alias("least"), F.max(total).alias("most"))
    return found.filter("least <> most or found <> most").select(*by, "found", F.col("most").alias("declared"))


def daily_history(pages: DataFrame, requested: DataFrame, by: Sequence[str], most_pages: int) -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of daily pages (by, page from 0, trade_date, ...) read backward until they reach the day asked for (by, since).

    Pages after the first that reaches the day, and beyond most_pages, are not looked at; of bars of one day that of the earliest page stays. A key without a bar
    (missing_history), or whose earliest bar is after the day (insufficient_history), is an issue and has no bars: a factor from part of a history would be wrong.
    """
    keys = list(by)
    ends = pages.filter(F.col("page") < most_pages).groupBy(*keys, "page").agg(F.min("trade_date").alias("_first"))
    reached = requested.join(ends, keys, "left").groupBy(*keys, "since").agg(F.min(F.when(F.col("_first") <= F.col("since"), F.col("page"))).alias("_stop"), F.min("_first").alias("_earliest"))
    issue = F.when(F.col("_earliest").isNull(), "missing_history").when(F.col("_stop").isNull(), "insufficient_history")
    judged = reached.select(*keys, "since", "_stop", issue.alias("issue_type"))
    kept = pages.join(judged.filter("issue_type is null").select(*keys, "_stop"), keys).filter("page <= _stop").drop("_stop")
    others = [c for c in pages.columns if c not in (*keys, "trade_date")]
    first = kept.groupBy(*keys, "trade_date").agg(F.min_by(F.struct(*others), "page").alias("_row"))
    return first.select(*keys, "trade_date", *[F.col(f"_row.{c}").alias(c) for c in others if c != "page"]), judged.filter("issue_type is not null").select(*keys, "issue_type")
