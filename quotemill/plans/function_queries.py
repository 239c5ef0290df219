"""Queries over the scalar functions, guards and operations frames, with their twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import dates, text
from quotemill.operators import latest, ordering
from quotemill.plans import adapters as views
from quotemill.plans import guards, imports, ops
from quotemill.plans.params import ProviderQuery
from quotemill.plans.registry import _COUNTS, query
from quotemill.session import shared_path
from quotemill.sources import packers, tables, wire

KEY = ["market", "symbol"]


# ---- texts and codes


@query(
    "select symbol, lower(regexp_replace(' ' || current_name || chr(12288) || ' X ', '[\\s　]+', '', 'g')) as name_norm, case when symbol like '920%' or substr(symbol, 1, 1) in ('8', '4') then 'bj' when substr(symbol, 1, 1) in ('6', '9') then 'sh' else 'sz' end as inferred, lower(board) || '-b-c' as slug, case when cast(symbol as int) % 2 = 0 then ['a', board] else [board] end as aliases, symbol as code_symbol, market as code_market, true as six_digits, false as five_digits from securities"
)
def fn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, inferred market, slug, alias list, and code:market of every security."""
    rows = views.securities(spark, sf_dir)
    even = F.col("symbol").cast("int") % 2 == 0
    code = text.symbol_market(F.concat(F.lit(" "), "symbol", F.lit(" : "), F.upper("market"), F.lit(" ")))
    return rows.select(
        "symbol",
        text.normalized(F.concat(F.lit(" "), "current_name", F.lit("　 X "))).alias("name_norm"),
        text.infer_market(F.col("symbol")).alias("inferred"),
        text.slug(F.concat(F.lit(" "), "board", F.lit(" B/C"))).alias("slug"),
        text.alias_list(F.when(even, F.concat(F.lit(" a |"), "board", F.lit(";; a"))).otherwise(F.concat("board", F.lit(", "), "board"))).alias("aliases"),
        code["symbol"].alias("code_symbol"),
        code["market"].alias("code_market"),
        text.is_symbol(F.col("symbol")).alias("six_digits"),
        text.is_symbol(F.substring("symbol", 1, 5)).alias("five_digits"),
    )


_KIND = "cast(symbol as int) % 7"


@query(
    f"select symbol, case {_KIND} when 0 then 30000 + cast(substr(symbol, 5, 2) as int) when 1 then 20000 + cast(substr(symbol, 5, 2) as int) when 2 then 31000 + cast(substr(symbol, 4, 3) as int) when 3 then 30000 + cast(substr(symbol, 4, 3) as int) when 4 then 32000 + cast(substr(symbol, 4, 3) as int) when 5 then 20000 + cast(substr(symbol, 3, 4) as int) % 10000 else 0 end as code, case {_KIND} when 0 then 'promoted' when 1 then 'sealed' when 2 then 'broken' when 3 then 'open_limit' when 4 then 'limit_down' when 5 then 'unknown' end as status, case {_KIND} when 0 then 'active' when 1 then 'suspended' when 2 then 'delisted' else 'odd' end as listing from securities"
)
def fn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board numbers of seven kinds of symbols, relay statuses and listing statuses in the sources' words."""
    rows = views.securities(spark, sf_dir)
    kind = F.col("symbol").cast("int") % 7
    tail = lambda n: F.substring("symbol", 7 - n, n)
    board = F.when(kind == 0, F.concat(F.lit("US"), tail(2))).when(kind == 1, F.concat(F.lit("HK"), tail(2))).when(kind == 2, F.concat(F.lit("000"), tail(3))).when(kind == 3, F.concat(F.lit("399"), tail(3))).when(kind == 4, F.concat(F.lit("899"), tail(3))).when(kind == 5, F.concat(F.lit("88"), tail(4))).otherwise("x")
    pick = lambda *names: F.try_element_at(F.array(*map(F.lit, names)), (kind + 1).cast("int"))
    listing = text.mapped(F.lower(F.coalesce(pick("上市", "停牌", "delisted"), F.lit("odd"))), tables.STATUS, F.lit("odd"))
    return rows.select("symbol", wire.board_code(board).alias("code"), text.relay_status(pick("连板", " 平板", "断板", "炸板", "跌停", "", "?")).alias("status"), listing.alias("listing"))


_NATURE = "select event_id, user_id % 4 as kind, cast(trunc(value) as int) % 7 as volume, cast(trunc(value) as int) % 13 - 6 as change from events"


@query(
    f"""select event_id, case
  when change > 0 and volume > change then case kind when 0 then '多开' when 1 then '空开' else '开仓' end
  when change <> 0 and volume = abs(change) then case when change > 0 then '双开' else '双平' end
  when change = 0 and kind < 2 then case kind when 0 then '多换' else '空换' end
  when change < 0 and kind < 2 then case kind when 0 then '空平' else '多平' end
  when change < 0 and volume > -change then '平仓'
  else '换手' end as name, case kind when 0 then 1 when 1 then -1 else 0 end as direction, case when event_id % 80 > 59 then 0 else event_id % 80 end as second from ({_NATURE})"""
)
def fn_trade_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events")
    value = F.col("value").cast("int")
    nature = (F.col("user_id") % 4) * 10_000 + F.col("event_id") % 80
    found = wire.trade_nature(F.lit(1), value % 7, value % 13 - 6, nature)
    return rows.select("event_id", found.alias("n")).select("event_id", "n.name", F.col("n.direction").cast("int").alias("direction"), "n.second")


# ---- dates


@query(
    "select o_orderkey, cast(o_orderdate as date) as of_number, null::date as of_wrong, cast(o_orderdate as date) as of_dashes, cast(o_orderdate as date) as of_digits, strftime(o_orderdate, '%Y%m') as month, year(o_orderdate) as year, len(range(cast(o_orderdate as date), cast(o_orderdate as date) + 4, interval 1 day)) as days from orders"
)
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, day = views.table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    return rows.select(
        "o_orderkey",
        dates.date_of_number(packers.date_number(day)).alias("of_number"),
        dates.date_of_number(F.year(day) * 10_000 + 1332).alias("of_wrong"),
        dates.date_of_text(day.cast("string")).alias("of_dashes"),
        dates.date_of_text(F.date_format(day, "yyyyMMdd")).alias("of_digits"),
        dates.partition_month(day).alias("month"),
        dates.partition_year(day).alias("year"),
        F.size(dates.calendar(day, F.date_add(day, 3))).cast("long").alias("days"),
    )


@query(
    "select event_id, strftime(ts, '%H:%M') as of_clock, strftime(ts, '%H:%M') as of_packed, null::varchar as of_dash, strftime(ts + interval 8 hour, '%H:%M') as of_seconds, cast(ts as date) as packed_date, hour(ts) * 60 + minute(ts) as packed_minute, case when event_id % 241 < 120 then 570 + event_id % 241 else 660 + event_id % 241 end as label, case when event_id % 242 < 121 then 570 + event_id % 242 else 659 + event_id % 242 end as tick_label, hour(ts) || ':' || lpad((minute(ts))::varchar, 2, '0') || ':30.000' as vendor from events"
)
def fn_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ts, n = views.table(spark, sf_dir, "events"), F.col("ts"), F.col("event_id")
    day, second = ts.cast("date"), F.unix_timestamp(ts.cast("timestamp"))
    packed = dates.packed_minute(packers.packed_day(day), F.hour(ts) * 60 + F.minute(ts))
    shanghai = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(second), "Asia/Shanghai"))
    return rows.select(
        "event_id",
        dates.clock_of_text(F.date_format(ts, "HH:mm:ss")).alias("of_clock"),
        dates.clock_of_text(F.date_format(ts, "HHmmss")).alias("of_packed"),
        dates.clock_of_text(F.when(n % 2 == 0, "-").otherwise("24:00")).alias("of_dash"),
        dates.clock_of_seconds(second, shanghai).alias("of_seconds"),
        packed["trade_date"].alias("packed_date"),
        packed["minute_of_day"].cast("int").alias("packed_minute"),
        dates.minute_label(n % 241).alias("label"),
        dates.minute_label(n % 242, 121).alias("tick_label"),
        dates.vendor_time(F.hour(ts) * 1_000_000 + F.minute(ts) * 10_000 + 5_000).alias("vendor"),
    )


@query("select event_id, open <= high and low <= close as ok, case when event_id % 3 <> 0 then 'hand' end as nullable from (select event_id, value as open, value + 1 as high, value - case when event_id % 2 = 0 then 0 else -2 end as low, value as close from events)")
def fn_bar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bars are consistent, and a text whose empty form is null."""
    from quotemill.sources.records import consistent

    n, value = F.col("event_id"), F.col("value")
    rows = views.table(spark, sf_dir, "events").select("event_id", value.alias("open"), (value + 1).alias("high"), (value + F.when(n % 2 == 0, 0).otherwise(2)).alias("low"), value.alias("close"))
    return rows.select("event_id", consistent(rows).alias("ok"), F.nullif(F.when(n % 3 == 0, "").otherwise("hand"), F.lit("")).alias("nullable"))


# ---- guards and operations


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.limit_events(spark, sf_dir).select("trade_date", "event_type", "market", "symbol", "close_status", "board_count", "theme_primary")


EVENT = ["trade_date", "event_type", "market", "symbol"]


@query("select trade_date, event_type, market, symbol, case when cast(symbol as int) % 5 = 0 then 'missing' else 'changed' end as reason from limit_events where cast(symbol as int) % 5 = 0 or cast(symbol as int) % 7 = 0")
def guard_changed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enrichment of events of which some are not stored and others have another board count."""
    n, current = F.col("symbol").cast("int"), _current(spark, sf_dir)
    incoming = current.withColumn("board_count", F.when(n % 7 == 0, F.col("board_count") + 1).otherwise(F.col("board_count"))).withColumn("theme_primary", F.lit("new"))
    return ops.changed_facts(current.filter(n % 5 != 0), incoming, EVENT, ["theme_primary"])


@query("select trade_date, event_type, market, symbol, close_status, board_count, case when cast(symbol as int) % 3 = 0 then 'new' else theme_primary end as theme_primary from limit_events")
def guard_kept_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of which only every third row brings a theme: the others keep theirs."""
    current = _current(spark, sf_dir)
    incoming = current.withColumn("theme_primary", F.when(F.col("symbol").cast("int") % 3 == 0, "new").otherwise(""))
    return ops.keep_enrichment(current, incoming, EVENT, ["theme_primary"])


@query("select trade_date, event_type, market, symbol, 'fresh' as note from limit_events where cast(symbol as int) % 4 = 1 union all select trade_date, event_type, market, symbol, 'old' from limit_events where cast(symbol as int) % 4 <> 1")
def guard_whole_row_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of a correction replace stored ones."""
    rows = _current(spark, sf_dir).select(*EVENT, F.lit("old").alias("note"))
    return latest.upsert(rows, rows.filter(F.col("symbol").cast("int") % 4 == 1).withColumn("note", F.lit("fresh")), EVENT)


@query("select distinct trade_date from limit_events where day(trade_date) % 2 = 0")
def guard_occupied_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _current(spark, sf_dir)
    return latest.occupied(rows.filter(F.dayofmonth("trade_date") % 2 == 0), rows, "trade_date")


@query("select distinct trade_date, event_type, market, symbol, close_status from limit_events_raw")
def guard_equal_rows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a bundle twice: equal ones collapse; rows of a key that differed would be an error before anything is written."""
    rows = views.limit_events_raw(spark, sf_dir).select(*EVENT, "close_status").distinct()
    return latest.without_conflicts(rows.unionByName(rows), [*EVENT, "close_status"])


@query("select trade_date, event_type, market, symbol, count(distinct close_status) as versions from limit_events_raw group by all having count(distinct close_status) > 1")
def guard_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.conflicts(views.limit_events_raw(spark, sf_dir).select(*EVENT, "close_status"), EVENT)


_POOLS = "pools as (select distinct trade_date, market || symbol as symbol, case event_type when 'open_limit' then 'open_limit' else case when cast(symbol as int) % 2 = 0 then 'limit_up' else 'limit_down' end end as pool from limit_events)"


@query(f"select * from (with {_POOLS} select trade_date, symbol, pool, case pool when 'limit_up' then 'sealed' when 'limit_down' then 'limit_down' else case when exists (select 1 from pools q where q.trade_date = p.trade_date and q.symbol = p.symbol and q.pool = 'limit_up') then 'broken_reseal' else 'broken' end end as close_status from pools p)")
def guard_reconciled_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    pool = F.when(kind == "open_limit", kind).otherwise(F.when(F.col("symbol").cast("int") % 2 == 0, "limit_up").otherwise("limit_down"))
    return ops.reconciled_pools(_current(spark, sf_dir).select("trade_date", F.concat("market", "symbol").alias("symbol"), pool.alias("pool")).distinct())


@query("select trade_date, case when up_count + down_count + flat_count > case when day(trade_date) % 3 = 0 then 1 else total_count end then 'counts_exceed_total' when day(trade_date) % 3 = 1 then 'up_gt_3_count_exceeds' end as issue from breadth")
def guard_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth rows of which some declare too small a total, others more strong than plain movers."""
    day, up = F.dayofmonth("trade_date") % 3, F.col("up_count")
    absent = {f"{s}_gt_{k}_count": F.lit(None).cast("long") for s in ("up", "down") for k in (3, 5, 7)} | {"unchanged_or_suspended_count": F.lit(None).cast("long")}
    rows = views.breadth(spark, sf_dir).withColumns(absent | {"total_count": F.when(day == 0, 1).otherwise(F.col("total_count")), "up_gt_3_count": F.when(day == 1, up + 1)})
    return rows.select("trade_date", ops.breadth_issue(F.struct(*rows.columns)).alias("issue"))


@query("select event_type, count(*) filter (value > 10 and event_id % 9 <> 0) as rows_written, count(*) filter (not (value > 10 and event_id % 9 <> 0)) as rows_skipped from events group by event_type")
def ops_import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(F.col("event_id") % 9 != 0, F.col("value") > 10)
    return ops.import_counters(views.table(spark, sf_dir, "events"), valid, "event_type")


@query("select user_id as run_id, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type not in ('purchase', 'error')) as skipped, sum(event_id) as row_count from events group by user_id")
def ops_sweep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("skipped")
    return ops.sweep_totals(views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("event_id").alias("row_count")))


@query("select event_type, arg_min(user_id::varchar, (value, user_id::varchar)) as server, min(value) as latency_ms from events where event_id % 4 <> 0 group by event_type")
def ops_fastest_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events")
    return ops.fastest(rows.select("event_type", F.col("user_id").cast("string").alias("server"), F.col("value").alias("latency_ms"), (F.col("event_id") % 4 != 0).alias("ok")), ["event_type"])


@query("select event_id, 'run1:' || issue_type || ':' || dataset || ':' || (event_id * 1000) as issue_id from quality_issues")
def ops_issue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.quality_issues(spark, sf_dir).select("event_id", ops.issue_id(F.lit("run1"), F.col("issue_type"), F.col("dataset"), F.col("event_id") * 1000).alias("issue_id"))


@query("select issue_id, run_id, dataset, severity, issue_type, logical_key from (select 'r7:' || issue_type || ':' || event_id || '|' || dataset as issue_id, 'r7' as run_id, 'bars' as dataset, case when issue_type = 'conflicting_logical_key' then 'error' else 'warning' end as severity, issue_type, event_id || '|' || dataset as logical_key from quality_issues)")
def ops_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = views.quality_issues(spark, sf_dir).select("event_id", "dataset", "issue_type")
    return imports.issue_rows(issues, "r7", "bars", ["event_id", "dataset"])


@query("select board, case board when 'BUILDING' then ['y'] else ['a', 'c', board, 'd'] end as symbols from (select distinct board from securities)")
def ops_edited_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of symbols after an edit: one replaced, the others with one removed and two added, of which one they had."""
    rows = views.securities(spark, sf_dir).select("board").distinct()
    members = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.col("board"))
    lit = lambda *x: F.array(*map(F.lit, x))
    done = F.when(F.col("board") == "BUILDING", ops.edited(members, lit(), lit(), lit("y", "y"))).otherwise(ops.edited(members, lit("b"), lit("c", "d")))
    return rows.select("board", done.alias("symbols"))


@query("select market, symbol, alias_type, alias_norm, arg_max(alias, (priority, -position)) as alias, max(priority) as priority from (select market, symbol, 'name' as alias_type, alias_norm, alias || (k) as alias, 50 + k % 3 as priority, k as position from security_aliases, range(0, 5) r(k)) group by all")
def best_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five aliases of one normal form each: the highest priority, the first on ties."""
    rows = views.security_aliases(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    placed = rows.select(*KEY, F.lit("name").alias("alias_type"), "alias_norm", F.concat("alias", F.col("k").cast("string")).alias("alias"), (50 + F.col("k") % 3).alias("priority"), F.col("k").alias("position"))
    return tables.best_aliases(placed).select(*KEY, "alias_type", "alias_norm", "alias", "priority")


@query("select user_id, day, first, last from (select user_id, day, first, last, lag(first) over (partition by user_id order by day desc) as earlier from (select user_id, day(ts) as day, min(event_id) - case when day(ts) % 6 = 0 then -500 else 0 end as first, max(event_id) + case when day(ts) % 5 = 0 then 2000 else 0 end as last from events group by user_id, day(ts))) where last >= earlier")
def stalled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward pages, a day each: some end after the page read before them begins."""
    day = F.dayofmonth("ts")
    pages = views.table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg((F.min("event_id") + F.when(day % 6 == 0, 500).otherwise(0)).alias("first"), (F.max("event_id") + F.when(day % 5 == 0, 2000).otherwise(0)).alias("last"))
    return ordering.stalled_pages(pages.withColumn("number", -F.col("day")), ["user_id"], "number", "first", "last").drop("number")


@query("select user_id, event_id, value from events where event_type <> 'error' order by value desc, event_id limit 80")
def ranked_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.table(spark, sf_dir, "events").withColumn("market", F.lit("sz")).withColumn("symbol", F.col("event_id"))
    return wire.ranked(quotes, "value", True, F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("select board, place, symbol, measure from (select board, symbol, measure, row_number() over (partition by board order by measure desc, market, symbol) as place from (select 'close' as board, market, symbol, close as measure from bars_1d where trade_date = (select max(trade_date) from bars_1d) union all select 'volume', market, symbol, volume::double from bars_1d where trade_date = (select max(trade_date) from bars_1d))) where place <= 10")
def top_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.bars_1d(spark, sf_dir)
    last = rows.join(rows.agg(F.max("trade_date").alias("trade_date")), "trade_date")
    return wire.top_boards(last, {"close": F.col("close"), "volume": F.col("volume")}, 10).select("board", "place", "symbol", "measure")


@query("select count(*) as row_count, sum(close) as closes from (select close from bars_1d order by trade_date, market, symbol limit 20)")
def clamped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the usual size where none is asked for, of a complete read."""
    rows = ordering.complete(views.bars_1d(spark, sf_dir), 10_000_000).orderBy("trade_date", "market", "symbol").limit(ordering.clamped(0))
    return rows.agg(F.count("*").alias("row_count"), F.sum("close").alias("closes"))


@query("select market || symbol as code, trade_date, close from bars_1d where trade_date between date '1995-06-01' and date '1998-05-31'")
def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's bars of a checked range; all rows are validated before the range is taken."""
    q = ProviderQuery("1995-06-01", "1998-05-31").checked(dt.date(2024, 1, 1))
    rows = views.bars_1d(spark, sf_dir).withColumn("code", F.concat("market", "symbol"))
    inside = F.col("trade_date").between(F.lit(q.since).cast("date"), F.lit(q.until).cast("date"))
    return tables.checked_bars(rows, ["code", "trade_date"], inside).select("code", "trade_date", "close")


@query("select board as name, count(*) as members, sum(case when cast(symbol as int) % 2 = 0 then 1 else 0 end) as quoted from securities group by board")
def provider_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of a provider's catalogue with how many of their members have quotes."""
    rows = views.securities(spark, sf_dir)
    quotes = rows.filter(F.col("symbol").cast("int") % 2 == 0).select(*KEY)
    return ops.board_members_quoted(rows.select(F.col("board").alias("name"), *KEY), quotes)


@query("select s.market, s.symbol, s.current_name as name from securities s join (select distinct symbol from bars_1d) b on b.symbol = s.symbol")
def named_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of codes with the names of quotes; codes without a quote go."""
    codes = views.bars_1d(spark, sf_dir).select("symbol").distinct()
    return ops.named_codes(codes, views.securities(spark, sf_dir).select(*KEY, F.col("current_name").alias("name")), ["symbol"])


# ---- imports


def _dataset(spark: SparkSession, name: str, key: tuple[str, ...], date: str, monthly: bool) -> imports.Dataset:
    return imports.Dataset(name, shared_path(spark, name), key, date, monthly)


@query("select market, symbol, trade_date, close + case when year(trade_date) = 1996 then 1 else 0 end as close from bars_1d where trade_date >= date '1995-12-01'")
def import_daily_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars imported as one commit and one year as another: the newest row of every key, read from the partitions of a range."""
    data = _dataset(spark, "bars_1d", ("market", "symbol", "trade_date"), "trade_date", False)
    rows = views.bars_1d(spark, sf_dir).select(*data.key, "close")
    imports.write_facts(rows, data, 1)
    imports.write_facts(rows.filter(F.year("trade_date") == 1996).withColumn("close", F.col("close") + 1), data, 2)
    return imports.read_facts(spark, data, since="1995-12-01")


@query("select market, symbol, trade_date, minute_of_day, close from ebars_1m where trade_date <= date '2024-01-20'")
def import_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _dataset(spark, "bars_1m", ("market", "symbol", "trade_date", "minute_of_day"), "trade_date", True)
    imports.write_facts(views.ebars_1m(spark, sf_dir).select(*data.key, "close"), data, 1)
    return imports.read_facts(spark, data, until="2024-01-20")


@query("select 'daily' as dataset, min(trade_date) as min_time, max(trade_date) as max_time, count(*) as row_count, 'degraded' as status, (select count(*) from bars_1d where day(trade_date) <= 3) as issue_count from bars_1d")
def import_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole life of an import: files decoded, facts, issues, watermark and run record written, and read back."""
    from quotemill.plans.source_queries import day_files_with_faults
    from quotemill.sources import records

    data = _dataset(spark, "daily", ("market", "symbol", "trade_date"), "trade_date", False)
    opsdir = shared_path(spark, "ops")
    bars, issues = records.day_bars(day_files_with_faults(views.bars_1d(spark, sf_dir)))
    imports.run_import(bars.drop("source_path", "row_offset"), issues, data, opsdir, "run-1", 1, dt.datetime(2024, 1, 1))
    runs = spark.read.parquet(f"{opsdir}/runs").select("dataset", "issue_count")
    return imports.watermarks(spark, opsdir).join(runs, "dataset").select("dataset", "min_time", "max_time", "row_count", "status", "issue_count")


def repeated_points(minutes: DataFrame) -> DataFrame:
    """Minutes as points, of which some come again: equal, of another price, or with a negative volume."""
    rest = F.col("minute_of_day") % 10
    copies = minutes.withColumn("copy", F.explode(F.when(rest < 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    again = F.col("copy") == 1
    return copies.select(
        *KEY, "trade_date", F.format_string("%02d:%02d", F.floor(F.col("minute_of_day") / 60), F.col("minute_of_day") % 60).alias("point_time"), F.col("minute_of_day").alias("point_index"),
        F.when(again & (rest == 1), F.col("close") + 1).otherwise(F.col("close")).alias("price"), F.when(again & (rest == 2), F.lit(-1)).otherwise(F.col("volume")).alias("point_volume"),
        F.concat(*KEY).alias("source_path"), (F.col("minute_of_day") * 2 + F.col("copy")).cast("long").alias("row_offset"),
    )


_TRADED = "(select m.k as market, b.* exclude (market) from bars_1d b, (values ('sh'), ('sz'), ('bj')) m(k) where day(trade_date) not in (2, 3, 4) and (day(trade_date) <> 5 or trade_date not in (select trade_date from bars_1d group by trade_date having count(*) > 1)) qualify day(trade_date) <> 6 or row_number() over (partition by trade_date, m.k order by b.market, b.symbol) > 1)"
_BAD_DAYS = "(select count(*) from (select trade_date, count(*) as n from bars_1d group by trade_date) where day(trade_date) in (2, 3, 4) or (day(trade_date) = 5 and n > 1))"


@query(f"""
select 'day_packages' as dataset, min(make_date(2000 + year(trade_date) % 100, month(trade_date), day(trade_date))) as min_time, max(make_date(2000 + year(trade_date) % 100, month(trade_date), day(trade_date))) as max_time, count(*) as rows_written, {_BAD_DAYS} as issue_count, {_BAD_DAYS} as rows_skipped from {_TRADED}
union all select 'reports', min(trade_date), max(trade_date), 4 * count(*), (select count(distinct trade_date) from ebars_1d), 0 from ebars_1d
union all select 'metrics', min(trade_date), max(trade_date), count(*), count(*) filter (day(trade_date) = 5), count(*) filter (day(trade_date) = 5) from ebars_1d
union all select 'capital_changes', min(event_date), max(event_date), count(*), 0, 0 from xdxr_events
union all select 'ex_day', min(trade_date), max(trade_date), count(*), 0, 0 from ebars_1d
union all select 'minutes', min(trade_date), max(trade_date), count(*), 0, 0 from ebars_1m
union all select 'points', min(trade_date), max(trade_date), count(*), count(*) filter (minute_of_day % 10 in (1, 2)), count(*) filter (minute_of_day % 10 in (1, 2)) from ebars_1m""")
def import_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other import commands, each through its reader and the life cycle: day packages, report files with an item their dictionary lacks, metrics, capital
    changes, extension days, minute files, intraday points."""
    from quotemill.plans import source_queries as packed
    from quotemill.sources import archives, records

    opsdir, started = shared_path(spark, "ops"), dt.datetime(2024, 1, 1)

    def run(name: str, rows: DataFrame, issues: DataFrame, key: tuple[str, ...], date: str, **how: object) -> None:
        data = _dataset(spark, name, key, date, name in ("minutes", "points"))
        imports.run_import(rows.drop("source_path", "row_offset"), issues.select("source_path", "row_offset", "issue_type"), data, opsdir, name, 1, started, **how)

    days = ("market", "symbol", "trade_date")
    bars, checks, _ = archives.packages(archives.directory(spark, packed._packages(spark, sf_dir)))
    refused = checks.filter("problem is not null").select("source_path", F.lit(0).alias("row_offset"), F.col("problem").alias("issue_type"))
    run("day_packages", bars, refused, days, "trade_date")
    items = spark.range(1, 4).select(F.col("id").cast("int").alias("item_id"))
    reported, unknown = records.report_values(packed._report_files(spark, sf_dir), items)
    unknown = unknown.withColumn("source_path", F.element_at(F.split("source_path", "/"), -1)).distinct()  # the files of a day are one report
    run("reports", reported, unknown, ("market", "symbol", "report_date", "item_id"), "report_date", skipping=("duplicate_logical_key",))
    run("metrics", *records.metric_values(packed._metric_files(spark, sf_dir)), ("market", "symbol", "metric_type", "event_date"), "event_date", skipping=guards.SKIPPING)
    run("capital_changes", *records.capital_changes(packed.capital_files(spark, sf_dir)), ("market", "symbol", "event_date", "category"), "event_date")
    run("ex_day", *records.ex_day_bars(packed.ex_day_files(spark, sf_dir)), ("ex_market", "code", "trade_date"), "trade_date")
    minutes = views.ebars_1m(spark, sf_dir)
    run("minutes", *records.minute_bars(packed._minute_files(minutes, F.lit(".lc1"), False)), (*days, "minute_of_day"), "trade_date")
    run("points", *imports.checked_points(repeated_points(minutes)), (*days, "point_time"), "trade_date")
    marks = imports.watermarks(spark, opsdir).select("dataset", "min_time", "max_time")
    return marks.join(spark.read.parquet(f"{opsdir}/runs").select("dataset", "rows_written", "issue_count", "rows_skipped"), "dataset")


# ---- refreshes


_AMENDED = "case when year(trade_date) = 1996 and month(trade_date) = 3 and cast(symbol as int) % 2 = 0 then case when day(trade_date) % 2 = 0 then 0 else close + 1 end else close end"


@query(f"select market, symbol, trade_date, p as prev_close, case when p > 0 then (close - p) / p * 100 end as pct_chg from (select *, last_value(case when close > 0 then close end ignore nulls) over (partition by market, symbol order by trade_date rows between unbounded preceding and 1 preceding) as p from (select market, symbol, trade_date, {_AMENDED} as close from bars_1d))")
def refresh_daily_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns refreshed after all bars, then after a second commit that amends a month of some instruments: only what that reaches is computed and written."""
    from quotemill.plans import refresh

    day = ("market", "symbol", "trade_date")
    facts, target, state = _dataset(spark, "bars_1d", day, "trade_date", False), _dataset(spark, "daily_derived", day, "trade_date", False), shared_path(spark, "refreshes")
    rows = views.bars_1d(spark, sf_dir).select(*day, F.col("close").cast("double").alias("close"))
    imports.write_facts(rows, facts, 1)
    refresh.refresh_daily(spark, facts, target, state)
    when = (F.date_format("trade_date", "yyyyMM") == "199603") & (F.col("symbol").cast("int") % 2 == 0)
    imports.write_facts(rows.filter(when).withColumn("close", F.when(F.dayofmonth("trade_date") % 2 == 0, 0.0).otherwise(F.col("close") + 1)), facts, 2)
    refresh.refresh_daily(spark, facts, target, state)
    return spark.read.parquet(target.path).select(*day, "prev_close", "pct_chg")


@query(f"select * from (with changed as (select * exclude (board_count), board_count + case when day(trade_date) <= 3 then 1 else 0 end as board_count from limit_events) select trade_date, {_COUNTS} from changed group by trade_date)")
def refresh_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries refreshed after all events, then after a second commit of some days."""
    from quotemill.plans import refresh, review

    facts = _dataset(spark, "limit_events", tuple(views.EVENT_KEY), "trade_date", True)
    target, state = _dataset(spark, "limit_summary", ("trade_date",), "trade_date", True), shared_path(spark, "refreshes")
    rows = views.limit_events(spark, sf_dir)
    imports.write_facts(rows, facts, 1)
    refresh.refresh_days(spark, facts, target, state, review.summary_counts)
    imports.write_facts(rows.filter(F.dayofmonth("trade_date") <= 3).withColumn("board_count", F.col("board_count") + 1), facts, 2)
    refresh.refresh_days(spark, facts, target, state, review.summary_counts)
    return spark.read.parquet(target.path).drop("_part")



@query("select market, symbol, current_name, lower(replace(current_name, ' ', '')) as current_name_norm, case cast(symbol as int) % 3 when 0 then 'active' when 1 then 'suspended' else 'delisted' end as status, 100 as lot_size, 2 as price_precision, date '2001-02-03' as listing_date from securities where cast(symbol as int) % 10 <> 0")
def src_security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of securities as a CSV; rows without a name are refused."""
    return tables.security_master(spark, _master_file(spark, sf_dir))[0].select("market", "symbol", "current_name", "current_name_norm", "status", "lot_size", "price_precision", "listing_date")


@query("select market, symbol, unnest(['A' || symbol, 'b c']) as alias, unnest(['a' || symbol, 'bc']) as alias_norm from securities where cast(symbol as int) % 10 <> 0")
def src_master_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.security_master(spark, _master_file(spark, sf_dir))[1]


@query("select market, symbol, case when cast(symbol as int) % 2 = 0 then 'locked' else current_name end as current_name, cast(symbol as int) % 2 = 0 as manual_locked from securities where cast(symbol as int) % 10 <> 0")
def refresh_security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of stored securities from the list: locked rows keep their names."""
    fresh = tables.security_master(spark, _master_file(spark, sf_dir))[0].select(*KEY, "current_name", F.lit(False).alias("manual_locked"))
    stored = views.securities(spark, sf_dir).filter((F.col("symbol").cast("int") % 2 == 0) & (F.col("symbol").cast("int") % 10 != 0))
    return latest.merge_locked(stored.select(*KEY, F.lit("locked").alias("current_name"), F.lit(True).alias("manual_locked")), fresh, KEY, "manual_locked")


def _master_file(spark: SparkSession, sf_dir: str) -> str:
    n = F.col("symbol").cast("int")
    word = lambda *names: F.element_at(F.array(*map(F.lit, names)), n % 3 + 1)
    name: Column = F.when(n % 10 == 0, " ").otherwise(F.col("current_name"))
    rows = views.securities(spark, sf_dir).select(F.upper("market").alias("market"), "symbol", name.alias("name"), word("", "停牌", "delisted").alias("status"), F.lit("20010203").alias("listing_date"), F.lit("").alias("lot_size"), F.concat(F.lit("A"), "symbol", F.lit("|b c;A"), "symbol").alias("aliases"))
    path = shared_path(spark, "master")
    rows.write.option("header", "true").csv(path)
    return path


# ---- dictionaries, archives, days


@query("select p_partkey::int as metric_type, p_name as name, p_brand as title, p_type as value1_meaning, 'u' as value2_meaning, case when p_partkey % 2 = 0 then 'verified' else 'candidate' end as status from part")
def src_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file with the exact header, unique keys and only allowed statuses."""
    path = shared_path(spark, "dictionary")
    n = F.col("p_partkey")
    rows = views.table(spark, sf_dir, "part").select(n.alias("metric_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("title"), F.col("p_type").alias("value1_meaning"), F.lit("u").alias("value2_meaning"), F.when(n % 2 == 0, "verified").otherwise("candidate").alias("status"), F.lit("s").alias("source_ref"))
    rows.write.option("header", "true").csv(path)
    return tables.dictionary(spark, path, tables.METRICS, "metric_type", {"status": ("verified", "candidate")}).drop("source_ref")


@query("select symbol, event_date, cast(cast(open as float) as double) as value1 from (select symbol, trade_date as event_date, open from ebars_1d) where cast(symbol as int) % 5 <> 0")
def src_metric_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files out of archives by the symbol's last digit, on disk, of which those go that a manifest does not vouch for."""
    from quotemill.plans.source_queries import _metric_files, landed
    from quotemill.sources import archives, records

    files = _metric_files(spark, sf_dir)
    digit = F.concat(F.regexp_extract("source_path", r"([0-9])\.dat$", 1), F.lit("/gp.zip")).alias("source_path")
    root = landed(packers.zipped(files.select(digit, F.col("source_path").alias("entry"), "content")), "metric-archives")
    entries = archives.contents(archives.directory(spark, root), (".dat",))
    symbol = F.regexp_extract("entry", "([0-9]{6})", 1).cast("int")
    listed = entries.select(F.col("entry").alias("filename"), F.when(symbol % 5 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(F.md5("content")).alias("md5"), F.octet_length("content").cast("long").alias("size"))
    bad = tables.manifest_mismatches(entries.select(F.col("entry").alias("filename"), "content"), listed)
    good = entries.join(bad.select(F.col("filename").alias("entry")), "entry", "left_anti")
    return records.metric_values(records.as_files(good))[0].select("symbol", "event_date", "value1")


@query("select distinct trade_date, event_type, market, symbol from limit_events where theme_primary = 'theme3' or board_count = 3 order by trade_date, event_type, market, symbol limit 501")
def events_of_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the events whose first theme, or one of whose tags, is the one asked for."""
    from quotemill.plans import review
    from quotemill.plans.params import LimitQuery

    tags = F.array(F.lit("x"), F.when(F.col("board_count") == 3, "theme3").otherwise("y"))
    rows = views.limit_events(spark, sf_dir).withColumn("theme_tags", tags)
    q = LimitQuery(since="2024-01-01", until="2024-12-31", theme="theme3", limit=500)
    found = review.selected(rows, q, "events").select(*EVENT)
    return ordering.page(found, EVENT, 500)


@query("select trade_date, prev_trade_date from limit_summary_stored where prev_trade_date is not null")
def previous_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous trading day of every day, checked to be before it and the same in all rows that state it."""
    from quotemill.plans import review

    return review.previous_days(views.limit_summary_stored(spark, sf_dir), views.limit_relay_stored(spark, sf_dir))


def _points_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every point and a later repeat of it, which has another price at every seventh minute."""
    from quotemill.plans.imports import checked_points

    minute = F.col("minute_of_day")
    time = F.format_string("%02d:%02d", (minute / 60).cast("int"), (minute % 60).cast("int"))
    rows = views.points(spark, sf_dir).select(*KEY, "trade_date", time.alias("point_time"), "point_index", "price", F.col("volume").alias("point_volume"), F.lit("first").alias("source_path"), minute.cast("long").alias("row_offset"))
    later = rows.withColumns({"source_path": F.lit("later"), "price": F.when(F.col("row_offset") % 7 == 0, F.col("price") + 1).otherwise(F.col("price"))})
    return checked_points(rows.unionByName(later))


@query("select market, symbol, trade_date, point_index, price from points")
def points_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday points twice: the first of a time stays, whether the later one equals it or not."""
    return _points_twice(spark, sf_dir)[0].select(*KEY, "trade_date", "point_index", "price")


@query("select 'later' as source_path, minute_of_day as row_offset, 'conflicting_logical_key' as issue_type, count(*) as n from points where minute_of_day % 7 = 0 group by minute_of_day")
def points_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later points that differ are issues; equal ones go silently."""
    return _points_twice(spark, sf_dir)[1].groupBy("source_path", "row_offset", "issue_type").agg(F.count("*").alias("n"))


@query("select count(*) as row_count, min(open) as least from (select open, row_number() over (partition by market, symbol order by trade_date desc) as n from bars_1d) where n <= 800")
def online_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent 800 bars of every instrument, as pages of an online read hold them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("trade_date")))
    rows = views.bars_1d(spark, sf_dir).withColumn("n", place).filter("n <= 800")
    return rows.agg(F.count("*").alias("row_count"), F.min("open").alias("least"))


@query("select trade_date, case when day(trade_date) % 2 = 0 then trade_date - 1 else prev_trade_date end as prev_trade_date from limit_summary_stored where day(trade_date) % 2 = 0 or prev_trade_date is not null")
def previous_trading_days_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a request states the previous day of every other day, which wins."""
    from quotemill.plans import review

    stored = views.limit_summary_stored(spark, sf_dir)
    given = stored.filter(F.dayofmonth("trade_date") % 2 == 0).select("trade_date", F.date_sub("trade_date", 1).alias("prev_trade_date"))
    return review.previous_days(stored, views.limit_relay_stored(spark, sf_dir), given)


_ASKED = "select trade_date, event_type, symbol, market from limit_events where cast(symbol as int) % 4 = 1"


@query(f"select trade_date, event_type, market, symbol, case when cast(symbol as int) % 4 = 1 and trade_date not in (select trade_date from ({_ASKED}) where day(trade_date) % 3 = 0 and event_type = 'limit_up') then 'corrected' else theme_primary end as theme_primary from limit_events")
def correction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections in batches by day: on every third day those of limit-ups try to change a fact, which refuses the day's whole batch."""
    key = list(views.EVENT_KEY)
    stored = views.limit_events(spark, sf_dir).select(*key, "board_count", "theme_primary")
    wrong = (F.dayofmonth("trade_date") % 3 == 0) & (F.col("event_type") == "limit_up")
    asked = stored.filter(F.col("symbol").cast("int") % 4 == 1).withColumns({"theme_primary": F.lit("corrected"), "board_count": F.when(wrong, F.col("board_count") + 1).otherwise(F.col("board_count"))})
    refused = ops.changed_facts(stored, asked, key, ["theme_primary"])
    merged = latest.upsert(stored, ops.whole_batches(asked, refused, ["trade_date"]), key)
    return merged.select("trade_date", "event_type", "market", "symbol", "theme_primary")


_PAGED = "paged as (select market, symbol, trade_date, close, (row_number() over (partition by market, symbol order by trade_date desc) - 1) // 100 as page from bars_1d), ends as (select market, symbol, page, min(trade_date) as first from paged where page < 4 group by all), stops as (select market, symbol, min(page) filter (first <= date '2000-01-01') as stop from ends group by all)"


@query(f"select * from (with {_PAGED} select market, symbol, count(*) as bars, min(trade_date) as first, cast(null as varchar) as issue_type from paged join stops using (market, symbol) where page <= stop group by all union all select market, symbol, 0, null, 'insufficient_history' from stops where stop is null)")
def online_daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pages of 100 bars, read backward until they reach a day, four at most; instruments that fall short have an issue and no bars."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("trade_date"))) - 1
    pages = views.bars_1d(spark, sf_dir).select(*KEY, "trade_date", "close", F.floor(place / 100).alias("page"))
    pages = pages.unionByName(pages.filter("page > 0 and close > 0").groupBy(*KEY, "page").agg(F.max("trade_date").alias("trade_date"), F.max("close").alias("close")).select(*pages.columns))  # a bar of the page comes twice
    asked = pages.select(*KEY).distinct().withColumn("since", F.lit("2000-01-01").cast("date"))
    found, issues = ordering.daily_history(pages, asked, KEY, 4)
    counted = found.groupBy(*KEY).agg(F.count("*").alias("bars"), F.min("trade_date").alias("first"), F.lit(None).cast("string").alias("issue_type"))
    return counted.unionByName(issues.select(*KEY, F.lit(0).cast("long").alias("bars"), F.lit(None).cast("date").alias("first"), "issue_type"))
