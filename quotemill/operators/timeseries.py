"""Operators along time: strict as-of joins, adjustment factors, streaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.segments import previous, running_sum


def percent_change(now: Column, before: Column) -> Column:
    """Null unless the earlier value is positive."""
    return F.when(before > 0, (now - before) / before * 100)


def asof_before(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """left with the value of right's last row strictly before its time, null if there is none.

    One sort-merge over the union of both sides by (by, time): rows of right of the same time come after those of left, so
    they do not count. No pair of rows is ever formed, so a key with many rows on both sides costs their sum, and it is spread by years.
    """
    own = left.select(*by, F.col(left_time).alias("_time"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(*by, F.col(right_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    joined = previous(own.unionByName(other), F.col("_value"), F.col("_value").isNotNull(), by, ["_time", "_side"], F.year("_time"), "_found").filter("_side = 0")
    return joined.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in left.columns], F.col("_found").alias(name))


def theoretical_ratio(close: Column, cash: Column, price: Column, bonus: Column, allotment: Column) -> Column:
    """Price after a corporate action over the close before it; amounts are per ten shares."""
    return ((close * 10 - cash + allotment * price) / (F.lit(10.0) + allotment + bonus)) / close


#: The one category of corporate actions that moves prices.
EX_RIGHTS = 1


def action_ratios(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """market, symbol, event_date, ratio, issue of every corporate action.

    Issues: future_xdxr_event and unsupported_xdxr_category leave the action out, the others block all factors of the symbol.
    bars has market, symbol, trade_date, close; actions of symbols without bars are left out.
    """
    key = ["market", "symbol"]
    last = bars.groupBy(*key).agg(F.max("trade_date").alias("last_bar"))
    valid = bars.filter("close > 0").select(*key, "trade_date", "close")
    found = asof_before(actions, valid, key, "event_date", "trade_date", "close", "prev_close").join(last, key)
    fields = ("fenhong", "peigujia", "songzhuangu", "peigu")
    parts = F.lit(10.0) + F.col("peigu") + F.col("songzhuangu")
    ratio = F.when((F.col("prev_close") > 0) & (parts > 0), theoretical_ratio(F.col("prev_close"), *map(F.col, fields)))
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in fields])
    issue = (
        F.when(F.col("event_date") > F.col("last_bar"), "future_xdxr_event")
        .when(F.col("category") != EX_RIGHTS, "unsupported_xdxr_category")
        .when(F.col("prev_close").isNull(), "missing_previous_close")
        .when(missing, "missing_xdxr_fields")
        .when(parts <= 0, "invalid_xdxr_denominator")
        .when(F.col("ratio") <= 0, "invalid_adjust_ratio")
    )
    return found.withColumn("ratio", ratio).withColumn("issue", issue).select(*key, "event_date", "prev_close", "ratio", "issue")


BLOCKING = ("missing_previous_close", "missing_xdxr_fields", "invalid_xdxr_denominator", "invalid_adjust_ratio")


def adjustment_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """market, symbol, trade_date, qfq_factor, hfq_factor of every bar, both null for a symbol with a blocking issue.

    The forward factor is the product of the ratios of all later actions, the backward one of the reciprocals of those up to
    the bar's day. Both are exponentials of sums of logarithms: a symbol's total, a row for each symbol with actions, and a running sum by years, so
    no bar meets an action in a join and no symbol is one task.
    """
    key = ["market", "symbol"]
    ratios, issue = action_ratios(bars, actions), F.col("issue")
    moved = F.sum(F.when(issue.isNull(), F.log("ratio"))).alias("move")
    moves = ratios.groupBy(*key, "event_date").agg(moved, F.max(F.coalesce(issue.isin(*BLOCKING), F.lit(False))).alias("blocks"))
    days = bars.select(*key, "trade_date", F.lit(None).cast("double").alias("move"), F.lit(True).alias("is_bar"))
    events = moves.select(*key, F.col("event_date").alias("trade_date"), "move", F.lit(False).alias("is_bar"))
    past = running_sum(days.unionByName(events), F.col("move"), key, ["trade_date"], F.year("trade_date"), "_past").filter("is_bar")
    totals = moves.groupBy(*key).agg(F.sum("move").alias("_all"), F.max("blocks").alias("_blocks"))
    summed = past.join(totals, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    factor = lambda exponent: F.when(~F.coalesce("_blocks", F.lit(False)), F.exp(exponent))
    return summed.select(*key, "trade_date", factor(zero("_all") - zero("_past")).alias("qfq_factor"), factor(-zero("_past")).alias("hfq_factor"))


def streaks(present: DataFrame, calendar: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """present with streak: how many consecutive days of the calendar up to this one the key is present. Gaps and islands."""
    days = calendar.select(date).distinct().withColumn("_day", F.row_number().over(Window.orderBy(date)))
    numbered = present.select(*by, date).distinct().join(days, date)
    window = Window.partitionBy(*by).orderBy("_day")
    island = numbered.withColumn("_island", F.col("_day") - F.row_number().over(window))
    return island.withColumn("streak", F.row_number().over(Window.partitionBy(*by, "_island").orderBy("_day"))).select(*by, date, "streak")
