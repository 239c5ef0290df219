"""Limit-up and limit-down review: events, summaries, next-day relay, themes, ladder, and the stock-by-date matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.ordering import page
from quotemill.plans.bars import between
from quotemill.plans.params import LimitQuery

EVENT_KEY = ("trade_date", "event_type", "market", "symbol")
#: The order of each dataset's rows, and the column its theme filter reads.
ORDERS = {
    "events": EVENT_KEY,
    "summary": ("trade_date",),
    "relay": ("trade_date", "sample_group", "market", "symbol"),
    "themes": ("trade_date", "strength_rank", "theme_name"),
    "indices": ("trade_date", "index_code"),
    "breadth": ("trade_date",),
}
THEME_COLUMN = {"events": "theme_primary", "relay": "prev_theme_primary", "themes": "theme_name"}


def contains_keyword(column: str, keyword: str) -> Column:
    """Whether the text contains the keyword, whatever the case; % and _ stand for themselves, an empty keyword for anything."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(keyword))) if keyword else F.lit(True)


def selected(rows: DataFrame, query: LimitQuery, kind: str) -> DataFrame:
    """rows under a checked query's filters, without order and paging."""
    q = query.checked(kind)
    found = rows.filter(between("trade_date", *q.days, True))
    for name in ("market", "symbol", "event_type", "sample_group", "index_code"):
        if getattr(q, name):
            found = found.filter(F.col(name) == getattr(q, name))
    if q.prev_trade_date:
        found = found.filter(F.col("prev_trade_date") == F.lit(q.prev_trade_date).cast("date"))
    if q.theme:
        match = F.col(THEME_COLUMN[kind]) == q.theme
        if kind == "events" and "theme_tags" in rows.columns:
            match |= F.array_contains("theme_tags", q.theme)
        found = found.filter(match)
    return found.filter(contains_keyword("reason_text", q.reason_keyword)) if kind == "events" else found


def dataset(rows: DataFrame, query: LimitQuery, kind: str) -> DataFrame:
    """One page of a dataset, and one row more if there are further ones."""
    q = query.checked(kind)
    return page(selected(rows, q, kind), ORDERS[kind], q.limit, q.offset)


def summary_counts(events: DataFrame) -> DataFrame:
    """Per day the counts and the seal rate of its events."""
    kind, boards = F.col("event_type"), F.col("board_count")
    up, sealed_off = kind == "limit_up", (kind == "open_limit") & (F.col("close_status") != "broken_reseal")
    tried = F.count_if(up) + F.count_if(sealed_off)
    return events.groupBy("trade_date").agg(
        F.count_if(up).alias("limit_up_count"),
        F.count_if(kind == "limit_down").alias("limit_down_count"),
        F.count_if(kind == "open_limit").alias("open_limit_count"),
        F.coalesce(F.max(F.when(up, boards)), F.lit(0)).alias("max_board_height"),
        F.count_if(up & (boards == 1)).alias("first_board_count"),
        F.count_if(up & (boards >= 2)).alias("continuous_board_count"),
        F.count_if(up & (boards == 2)).alias("two_board_count"),
        F.count_if(up & (boards == 3)).alias("three_board_count"),
        F.count_if(up & (boards == 4)).alias("four_board_count"),
        F.count_if(up & (boards >= 5)).alias("five_plus_board_count"),
        F.when(tried > 0, F.count_if(up) / tried).alias("seal_success_rate"),
    )


def summaries(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored days, their counts replaced by fresh ones where the day has events; a stored null rate stays null."""
    fresh = summary_counts(events)
    names = [c for c in fresh.columns if c != "trade_date"]
    joined = stored.alias("s").join(fresh.alias("f"), "trade_date", "left")
    has = F.col("f.limit_up_count").isNotNull()

    def value(c: str) -> Column:
        old = F.col(f"s.{c}") if c in stored.columns else F.lit(None)
        new = F.when(F.col("s.seal_success_rate").isNotNull(), F.col(f"f.{c}")) if c == "seal_success_rate" else F.col(f"f.{c}")
        return F.when(has, new).otherwise(old).alias(c)

    others = [F.col(f"s.{c}").alias(c) for c in stored.columns if c not in names and c != "trade_date"]
    return joined.select("trade_date", *others, *[value(c) for c in names])


#: Which of a stock's events of a day counts.
PRIORITY = {"limit_down": 3, "limit_up": 2, "open_limit": 1}


def best_events(events: DataFrame) -> DataFrame:
    """trade_date, market, symbol, event_type, board_count: the strongest event of each stock and day."""
    rank = F.when(F.col("event_type") == "limit_down", 3).when(F.col("event_type") == "limit_up", 2).when(F.col("event_type") == "open_limit", 1).otherwise(0)
    best = events.groupBy("trade_date", "market", "symbol").agg(F.max_by(F.struct("event_type", "board_count"), rank).alias("e"))
    return best.select("trade_date", "market", "symbol", "e.*")


def previous_days(summary: DataFrame, stored: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """trade_date, prev_trade_date: one that is given, else a summary's, else the stored relay rows'. More than one of a kind for a day is an error, as is one not before it."""
    of = lambda df, name: df.filter("prev_trade_date is not null").groupBy("trade_date").agg(F.min("prev_trade_date").alias(name), F.max("prev_trade_date").alias(f"{name}_most"))
    both = of(summary, "a").join(of(stored, "b"), "trade_date", "full_outer")
    both = both.withColumn("g", F.lit(None).cast("date")) if given is None else both.join(given.select("trade_date", F.col("prev_trade_date").alias("g")), "trade_date", "full_outer")
    clash = F.col("b").isNotNull() & (F.col("b") != F.col("b_most"))
    prev = F.coalesce("g", "a", "b")
    late = prev >= F.col("trade_date")
    checked = F.when(F.col("g").isNull() & clash, F.raise_error(F.concat(F.lit("conflicting previous days of "), F.col("trade_date").cast("string")))).when(late, F.raise_error(F.concat(F.lit("previous day not before "), F.col("trade_date").cast("string")))).otherwise(prev)
    return both.select("trade_date", checked.alias("prev_trade_date"))


def relay(events: DataFrame, summary: DataFrame, stored: DataFrame, returns: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """What the previous day's limit events came to on each day.

    Samples are the previous day's events by group. A sample's status is that of the stock's strongest event of the day
    (promoted for a limit-up with more boards than before), else that of the stored row of the same previous day, else
    unknown; the day's return never changes the status, but replaces a stored one. Days whose previous day has no events keep
    their stored rows.
    """
    days = previous_days(summary, stored, given)
    kind = F.col("event_type")
    groups = F.array_compact(
        F.array(
            F.when(kind == "limit_up", "prev_limit_up"),
            F.when((kind == "limit_up") & (F.col("board_count") >= 2), "prev_ladder"),
            F.when((kind == "open_limit") & (F.col("close_status") != "broken_reseal"), "prev_broken"),
            F.when(kind == "limit_down", "prev_limit_down"),
        )
    )
    samples = events.withColumnRenamed("trade_date", "prev_trade_date").join(days, "prev_trade_date")
    samples = samples.withColumn("sample_group", F.explode(groups)).select("trade_date", "prev_trade_date", "market", "symbol", "sample_group", kind.alias("prev_event_type"), F.col("board_count").alias("prev_board_count"), F.col("reason_text").alias("prev_reason_text"), F.col("theme_primary").alias("prev_theme_primary"))
    stock = ["trade_date", "market", "symbol"]
    today = best_events(events).select(*stock, F.col("event_type").alias("today_type"), F.col("board_count").alias("today_boards"))
    old_boards = F.col("today_board_count") if "today_board_count" in stored.columns else F.lit(0)
    old = stored.select(*stock, "prev_trade_date", "sample_group", F.col("today_status").alias("old_status"), F.col("today_pct_chg").alias("old_pct"), old_boards.alias("old_boards"))
    now = returns.select(*stock, "pct_chg")
    rows = samples.join(today, stock, "left").join(old, [*stock, "prev_trade_date", "sample_group"], "left").join(now, stock, "left")
    promoted = (F.col("prev_event_type") == "limit_up") & (F.col("today_boards") > F.col("prev_board_count"))
    status = F.when(F.col("today_type") == "limit_up", F.when(promoted, "promoted").otherwise("sealed")).otherwise(F.coalesce("today_type", "old_status", F.lit("unknown")))
    out = ["trade_date", "prev_trade_date", "market", "symbol", "sample_group", "prev_board_count", "prev_reason_text", "prev_theme_primary"]
    rebuilt = rows.select(*out, status.alias("today_status"), F.coalesce("today_boards", "old_boards", F.lit(0)).alias("today_board_count"), F.coalesce("pct_chg", "old_pct").alias("today_pct_chg"))
    with_events = days.join(events.select(F.col("trade_date").alias("prev_trade_date")).distinct(), "prev_trade_date", "left_semi")
    kept = stored.join(with_events.select("trade_date"), "trade_date", "left_anti")
    blank = {"prev_reason_text": F.lit(""), "prev_theme_primary": F.lit(""), "today_board_count": F.lit(0)}
    kept = kept.withColumns({k: v for k, v in blank.items() if k not in kept.columns})
    return rebuilt.unionByName(kept.select(*rebuilt.columns))


def themes(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts, leader and rank of every theme and day; stored rows only for days without events.

    The leader is the limit-up of most boards, then least symbol; the rank goes by limit-ups, ladders, then name.
    """
    kind, boards = F.col("event_type"), F.col("board_count")
    up = kind == "limit_up"
    counted = (
        events.filter("theme_primary <> ''")
        .groupBy("trade_date", F.col("theme_primary").alias("theme_name"))
        .agg(
            F.count_if(up).alias("limit_up_count"),
            F.count_if(up & (boards >= 2)).alias("ladder_count"),
            F.count_if(kind == "open_limit").alias("broken_count"),
            F.count_if(kind == "limit_down").alias("limit_down_count"),
            F.min(F.when(up, F.struct((-boards).alias("b"), "symbol", "market"))).alias("leader"),
        )
    )
    order = Window.partitionBy("trade_date").orderBy(F.desc("limit_up_count"), F.desc("ladder_count"), "theme_name")
    leader = [F.coalesce("leader.market", F.lit("")).alias("leader_market"), F.coalesce("leader.symbol", F.lit("")).alias("leader_symbol"), F.coalesce(-F.col("leader.b"), F.lit(0)).alias("leader_board_count")]
    ranked = counted.select("trade_date", "theme_name", "limit_up_count", "ladder_count", "broken_count", "limit_down_count", *leader, F.row_number().over(order).alias("strength_rank"))
    kept = stored.join(events.select("trade_date").distinct(), "trade_date", "left_anti")
    blank = {"ladder_count": F.lit(0), "broken_count": F.lit(0), "limit_down_count": F.lit(0), "leader_market": F.lit(""), "leader_symbol": F.lit(""), "leader_board_count": F.lit(0)}
    kept = kept.withColumns({k: v for k, v in blank.items() if k not in kept.columns})
    return ranked.unionByName(kept.select(*ranked.columns))


def ladder(events: DataFrame) -> DataFrame:
    """Per day and height the limit-up stocks, sorted."""
    rows = events.filter("event_type = 'limit_up'").groupBy("trade_date", F.col("board_count").alias("height"))
    return rows.agg(F.count("*").alias("stock_count"), F.sort_array(F.collect_list(F.concat_ws(":", "market", "symbol"))).alias("stocks"))


def board_histogram(events: DataFrame) -> DataFrame:
    """Per day the limit-ups of 1, 2, 3, 4 and at least 5 boards."""
    rows = events.filter("event_type = 'limit_up'")
    return rows.groupBy("trade_date", F.least("board_count", F.lit(5)).alias("boards")).agg(F.count("*").alias("stocks"))


def matrix_stocks(events: DataFrame, relayed: DataFrame, query: LimitQuery) -> DataFrame:
    """The stocks that the filters choose: by an event of the type and theme, or, without a type, by a relay sample of the theme."""
    q = query.checked("matrix")
    match = F.lit(True)
    if q.theme:
        match = F.col("theme_primary") == q.theme
        if "theme_tags" in events.columns:
            match |= F.array_contains("theme_tags", q.theme)
    if q.event_type:
        match &= F.col("event_type") == q.event_type
    stocks = events.filter(match).select("market", "symbol")
    if not q.event_type:
        stocks = stocks.union(relayed.filter(F.col("prev_theme_primary") == q.theme if q.theme else F.lit(True)).select("market", "symbol"))
    return stocks.distinct()


def _matrix_range(events: DataFrame, relayed: DataFrame, q: LimitQuery) -> tuple[DataFrame, DataFrame]:
    own = LimitQuery(trade_date=q.trade_date, since=q.since, until=q.until, market=q.market, symbol=q.symbol)
    return selected(events, own, "events"), selected(relayed, own, "relay")


def matrix_total(events: DataFrame, relayed: DataFrame, query: LimitQuery) -> DataFrame:
    """total_rows: how many stocks the filters choose on all pages; 0 without any."""
    q = query.checked("matrix")
    return matrix_stocks(*_matrix_range(events, relayed, q), q).agg(F.count("*").alias("total_rows"))


def matrix_cells(events: DataFrame, relayed: DataFrame, query: LimitQuery) -> DataFrame:
    """One row per chosen stock of the page and date it has anything on: its events and relay samples, sorted.

    The filters choose stocks, not cells: a chosen stock shows all it has in the range.
    """
    q = query.checked("matrix")
    events, relayed = _matrix_range(events, relayed, q)
    chosen = matrix_stocks(events, relayed, q).orderBy("market", "symbol").offset(q.offset).limit(q.limit)
    key = ["market", "symbol", "trade_date"]
    e = events.join(chosen, ["market", "symbol"]).select(*key, F.struct("event_type", "board_count", "close_status").alias("event"), F.lit(None).cast("struct<sample_group:string,today_status:string>").alias("sample"))
    r = relayed.join(chosen, ["market", "symbol"]).select(*key, F.lit(None).cast(e.schema["event"].dataType).alias("event"), F.struct("sample_group", "today_status").alias("sample"))
    return e.unionByName(r).groupBy(*key).agg(F.sort_array(F.collect_list("event")).alias("events"), F.sort_array(F.collect_list("sample")).alias("relay"))


def matrix_rows(events: DataFrame, relayed: DataFrame, query: LimitQuery) -> DataFrame:
    """One row per chosen stock with its cells in date order."""
    cells = matrix_cells(events, relayed, query)
    return cells.groupBy("market", "symbol").agg(F.sort_array(F.collect_list(F.struct("trade_date", "events", "relay"))).alias("cells"))


def review_days(events: DataFrame, relayed: DataFrame, summary: DataFrame, breadth: DataFrame, indices: DataFrame, theme_rows: DataFrame, query: LimitQuery) -> DataFrame:
    """One row per date that any dataset has, with counts, and warnings for what is missing or does not agree."""
    q = query.checked("matrix")
    own = LimitQuery(trade_date=q.trade_date, since=q.since, until=q.until)
    kinds = {"events": events, "relay": relayed, "summary": summary, "breadth": breadth, "indices": indices, "themes": theme_rows}
    counted = [selected(df, own, kind).groupBy("trade_date").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    every = counted[0]
    for part in counted[1:]:
        every = every.unionByName(part)
    days = every.groupBy("trade_date").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in kinds])
    missing = F.array_compact(F.array(F.when(F.col("n_breadth") == 0, "market_breadth_missing"), F.when(F.col("n_indices") == 0, "performance_indices_missing"), F.when(F.col("n_summary") == 0, "summary_missing")))
    return days.withColumn("warnings", F.array_join(missing, ","))


def day_reviews(events: DataFrame, relayed: DataFrame, summary: DataFrame, breadth: DataFrame, indices: DataFrame) -> DataFrame:
    """One row per day: sizes of the three pools, of the relay and of the ladder, and warnings for what is missing or disagrees.

    summary is the refreshed one (limit_up_count, limit_down_count, open_limit_count may be null); breadth may have limit counts.
    """
    kind = F.col("event_type")
    pools = events.groupBy("trade_date").agg(F.count_if(kind == "limit_up").alias("up"), F.count_if(kind == "limit_down").alias("down"), F.count_if(kind == "open_limit").alias("broken"), F.count_distinct(F.when(kind == "limit_up", F.col("board_count"))).alias("heights"))
    counts = lambda df, name: df.groupBy("trade_date").agg(F.count("*").alias(name))
    declared = summary.select("trade_date", F.lit(True).alias("has_summary"), "limit_up_count", "limit_down_count", "open_limit_count")
    limits = [F.col(c).alias(f"breadth_{c}") if c in breadth.columns else F.lit(None).cast("long").alias(f"breadth_{c}") for c in ("limit_up_count", "limit_down_count")]
    days = pools.join(declared, "trade_date", "full_outer").join(breadth.select("trade_date", F.lit(True).alias("has_breadth"), *limits), "trade_date", "full_outer")
    days = days.join(counts(indices, "n_indices"), "trade_date", "full_outer").join(counts(relayed, "n_relay"), "trade_date", "full_outer")
    differs = (F.col("limit_up_count") != F.col("up")) | (F.col("limit_down_count") != F.col("down")) | (F.col("open_limit_count") != F.col("broken"))
    apart = (F.col("breadth_limit_up_count") != F.col("limit_up_count")) | (F.col("breadth_limit_down_count") != F.col("limit_down_count"))
    warnings = F.array_compact(
        F.array(
            F.when(apart, "breadth_limit_count_mismatch"),
            F.when(F.col("up").isNull(), "events_missing"),
            F.when(F.col("has_breadth").isNull(), "market_breadth_missing"),
            F.when(F.col("n_indices").isNull(), "performance_indices_missing"),
            F.when(F.col("n_relay").isNull(), "relay_missing"),
            F.when(differs, "summary_event_count_mismatch"),
            F.when(F.col("has_summary").isNull(), "summary_missing"),
        )
    )
    size = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return days.select("trade_date", size("up", "limit_up_pool"), size("broken", "broken"), size("down", "limit_down"), size("heights", "ladder_heights"), size("n_relay", "relay"), F.array_join(warnings, ",").alias("warnings"))
