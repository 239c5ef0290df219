"""Queries over the readers: rows of the test tables are packed into the vendors' files and frames in tasks, read back, and compared with the rows.

Their twins select from the tables what the files hold; single-precision fields are cast to float there.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.text import slug
from quotemill.plans import adapters as views
from quotemill.plans import ops
from quotemill.plans.registry import query
from quotemill.session import shared_path
from quotemill.sources import archives, packers, ranges, records, review_json, store, tables, wire

PRICES = records.PRICES


def _f(column: str) -> str:
    return f"cast(cast({column} as float) as double) as {column}"


# ---- record files


def _day_files(rows: DataFrame, bad: Column | None = None) -> DataFrame:
    number = packers.date_number(F.col("trade_date"))
    placed = rows.select(
        F.concat(F.lit("/vipdoc/"), "market", F.lit("/lday/"), "market", "symbol", F.lit(".day")).alias("source_path"),
        (number if bad is None else F.when(bad, F.year("trade_date") * 10_000 + 1300).otherwise(number)).alias("date"),
        *[packers.hundredths(F.col(p)).alias(p) for p in PRICES],
        "amount",
        "volume",
        F.col("trade_date").cast("string").alias("day"),
        F.col("copy").alias("copy") if "copy" in rows.columns else F.lit(0).alias("copy"),
    )
    return packers.packed(placed, records.DAY, ["day", "copy"])


@query(f"select market, symbol, trade_date, open, high, low, close, {_f('amount')}, volume from bars_1d")
def src_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.day_bars(_day_files(views.bars_1d(spark, sf_dir)))[0].select("market", "symbol", "trade_date", *PRICES, "amount", "volume")


def day_files_with_faults(rows: DataFrame) -> DataFrame:
    """Day files in which the first days of months stand twice, the second days twice with another close, the third days also without a valid date."""
    day = F.dayofmonth("trade_date")
    twice = rows.withColumn("copy", F.explode(F.when(day <= 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    twice = twice.withColumn("close", F.when((F.col("copy") == 1) & (day == 2), F.col("close") + 1).otherwise(F.col("close")))
    return _day_files(twice, (F.dayofmonth(F.col("trade_date")) == 3) & (F.col("copy") == 1))


@query("select market, symbol, case day(trade_date) when 1 then 'duplicate_logical_key' when 2 then 'conflicting_logical_key' else 'invalid_date' end as issue_type, case when day(trade_date) = 2 then 'error' else 'warning' end as severity, count(*) as issue_count from bars_1d where day(trade_date) <= 3 group by all")
def src_day_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = records.day_bars(day_files_with_faults(views.bars_1d(spark, sf_dir)))[1]
    name = F.element_at(F.split("source_path", "/"), -1)
    keyed = issues.select(F.substring(name, 1, 2).alias("market"), F.substring(name, 3, 6).alias("symbol"), "issue_type", ops.severity(F.col("issue_type")).alias("severity"))
    return keyed.groupBy("market", "symbol", "issue_type", "severity").agg(F.count("*").alias("issue_count"))


def _minute_files(rows: DataFrame, extension: Column, integer: bool) -> DataFrame:
    price = lambda p: packers.hundredths(F.col(p)) if integer else F.col(p)
    placed = rows.select(
        F.concat(F.lit("vipdoc/"), "market", F.lit("/minline/"), "market", "symbol", extension).alias("source_path"), packers.packed_day(F.col("trade_date")).alias("date"), F.col("minute_of_day").alias("minute"), *[price(p).alias(p) for p in PRICES], "amount", "volume"
    )
    return packers.packed(placed, records.MINUTE_INT if integer else records.MINUTE_FLOAT, ["date", "minute"])


_MINUTES = "select market, symbol, trade_date, minute_of_day, {prices}, {amount}, volume from ebars_1m where {which}"
_FLOATS = ", ".join(_f(p) for p in PRICES)


@query(_MINUTES.format(prices=_FLOATS, amount=_f("amount"), which="market = 'sh'") + " union all " + _MINUTES.format(prices=", ".join(PRICES), amount=_f("amount"), which="market <> 'sh'"))
def src_minute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one market with single-precision prices, of the others with hundredths."""
    rows = views.ebars_1m(spark, sf_dir)
    files = _minute_files(rows.filter("market = 'sh'"), F.lit(".lc1"), False).unionByName(_minute_files(rows.filter("market <> 'sh'"), F.lit(".1"), True))
    return records.minute_bars(files)[0].select("market", "symbol", "trade_date", "minute_of_day", *PRICES, "amount", "volume")


@query(f"select market, symbol, trade_date, minute_of_day, {_FLOATS}, {_f('amount')}, volume from ebars_1m")
def src_minute_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in one archive for each market."""
    files = _minute_files(views.ebars_1m(spark, sf_dir), F.lit(".lc5"), False)
    archives = packers.zipped(files.select(F.concat(F.split("source_path", "/")[1], F.lit("_lc5.zip")).alias("source_path"), F.col("source_path").alias("entry"), "content"))
    bars = records.minute_bars(records.as_files(records.entries(archives, (".lc5",))))[0]
    return bars.select("market", "symbol", "trade_date", "minute_of_day", *PRICES, "amount", "volume")


@query("select market, symbol, make_date(2000 + year(trade_date) % 100, month(trade_date), day(trade_date)) as trade_date, open, high, low, close, volume, amount, (market = 'sh' and symbol like '6%') or (market = 'sz' and substr(symbol, 1, 3) in ('000', '001', '002', '003', '300', '301')) or (market = 'bj' and symbol like '920%') as share, open = 0 and high = 0 and low = 0 and volume = 0 and amount = 0 as idle from bars_1d")
def src_day_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's archive of codes and bars of every market and day, paired by position; names hold two digits of the year, of this century."""
    rows = views.bars_1d(spark, sf_dir)
    name = F.concat("market", F.date_format("trade_date", "yyMMdd"))
    placed = rows.select(F.concat(F.year("trade_date").cast("string"), F.lit("/"), name).alias("source_path"), *PRICES, "volume", "amount", "symbol")
    codes = packers.packed(placed, records.np.dtype([("symbol", f"S{records.PACK_CODE}")]), ["symbol"]).withColumn("kind", F.lit(".cod"))
    bars = packers.packed(placed, records.PACK_BAR, ["symbol"]).withColumn("kind", F.lit(".md1"))
    parts = F.split("source_path", "/")
    archives = packers.zipped(codes.unionByName(bars).select(F.concat(parts[0], F.lit(".zip")).alias("source_path"), F.concat(parts[1], "kind").alias("entry"), "content"))
    found = records.package_bars(records.entries(archives))
    return found.select("*", records.is_share(F.col("market"), F.col("symbol")).alias("share"), records.no_trade(found).alias("idle"))


_RIGHTS = ("fenhong", "peigujia", "songzhuangu", "peigu")
_SHARES = ("panqianliutong", "qianzongguben", "panhouliutong", "houzongguben")
_ROUTED = ", ".join([*(f"case when day(event_date) % 2 = 0 then cast(cast({c} as float) as double) end as {c}" for c in _RIGHTS), *(f"case when day(event_date) % 2 = 1 then cast(cast({c} as float) as double) end as {n}" for c, n in zip(_RIGHTS, _SHARES, strict=True))])


def capital_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of ex-rights and of share changes for each market and year."""
    market = F.col("market")
    placed = views.xdxr_events(spark, sf_dir).select(
        F.concat(F.lit("/gbbq/"), market, F.year("event_date").cast("string")).alias("source_path"),
        F.when(market == "sz", 0).when(market == "sh", 1).otherwise(2).alias("market"),
        F.col("symbol").alias("code"),
        packers.date_number(F.col("event_date")).alias("date"),
        F.when(F.dayofmonth("event_date") % 2 == 0, 1).otherwise(5).alias("category"),
        *[F.col(c).alias(n) for c, n in zip(_RIGHTS, "abcd", strict=True)],
    )
    return packers.packed(placed, records.CAPITAL, ["code", "date"], lambda n: struct.pack("<I", n))


@query(f"select market, symbol, event_date, case when day(event_date) % 2 = 0 then 1 else 5 end as category, {_ROUTED} from xdxr_events")
def src_capital_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records.capital_changes(capital_files(spark, sf_dir))[0]
    return events.select("market", "symbol", "event_date", F.col("category").cast("int").alias("category"), *_RIGHTS, *_SHARES)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The securities in blocks of 200."""
    n = F.col("symbol").cast("long")
    rows = views.securities(spark, sf_dir).select("market", "symbol", F.floor(n / 200).alias("block"), (n % 200).alias("member_order"))
    return rows.withColumn("block_name", F.concat(F.lit("B "), F.col("block").cast("string")))


@query("select cast(symbol as bigint) // 200 as block_no, 'b-' || (cast(symbol as bigint) // 200) as block_id, 'B ' || (cast(symbol as bigint) // 200) as block_name, 2 as block_type, cast(symbol as bigint) % 200 as member_order, symbol from securities")
def src_block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files of twenty blocks each, whose numbers go on from file to file."""
    file = F.floor(F.col("block") / 20)
    rows = _blocks(spark, sf_dir).select(F.concat(F.lit("/T0002/hq_cache/block_"), file.cast("string"), F.lit(".dat")).alias("source_path"), F.col("block").alias("block_no"), "block_name", F.lit(2).alias("block_type"), "member_order", "symbol")
    found = records.block_members(packers.block_file(rows, records.BLOCK_HEADER, records.BLOCK_NAME, records.BLOCK_AREA, records.BLOCK_CODE))
    return found.select((F.col("block_no") + 20 * F.regexp_extract("source_path", "block_([0-9]+)", 1).cast("long")).alias("block_no"), "block_id", "block_name", F.col("block_type").cast("int").alias("block_type"), "member_order", "symbol")


@query("select 'b-' || (cast(symbol as bigint) // 200) as block_id, 'B ' || (cast(symbol as bigint) // 200) as block_name, market, symbol, cast(symbol as bigint) % 200 as member_order from securities")
def snk_custom_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom blocks written as a catalogue and lists, and read back."""
    rows = _blocks(spark, sf_dir).select(slug(F.col("block_name")).alias("block_id"), "block_name", "market", "symbol", "member_order")
    found = records.custom_blocks(packers.custom_block_files(rows))
    return found.select("block_id", "block_name", "market", "symbol", F.col("member_order").cast("long").alias("member_order"))


def ex_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension-market files, whose amount is the number that reads 1.0 as a float."""
    rows = views.ebars_1d(spark, sf_dir).withColumn("market_code", F.lit("29#C"))
    placed = rows.select(F.concat(F.lit("/ds/"), "market_code", "symbol", F.lit(".day")).alias("source_path"), packers.date_number(F.col("trade_date")).alias("date"), *PRICES, F.lit(0x3F800000).alias("amount"), "volume", F.col("close").alias("settlement"))
    return packers.packed(placed, records.EX_DAY, ["date"])


@query(f"select 29 as ex_market, 'C' || symbol as code, trade_date, {_FLOATS}, 1065353216::bigint as amount, 1.0::double as price, volume as position, volume as trade, cast(cast(close as float) as double) as settlement from ebars_1d")
def src_ex_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ex_day_bars(ex_day_files(spark, sf_dir))[0].select("ex_market", "code", "trade_date", *PRICES, "amount", "price", "position", "trade", "settlement")


#: Symbols of a day in a report file, which counts its records in 16 bits.
REPORT_SYMBOLS = 20_000


def _report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files, a folder for each range of symbols, in it a file for each day."""
    number = packers.date_number(F.col("trade_date"))
    part = F.floor(F.col("symbol").cast("int") / REPORT_SYMBOLS)
    rows = views.ebars_1d(spark, sf_dir).select(F.format_string("%d/gpcw%d.dat", part, number).alias("source_path"), number.alias("date"), "symbol", F.array(*PRICES).alias("items"))
    return packers.report_file(rows)


_ITEMS = f"select trade_date as report_date, 'sz' as market, symbol, item_id::int as item_id, cast(cast(value as float) as double) as value from (select trade_date, symbol, unnest([open, high, low, close]) as value, unnest([1, 2, 3, 4]) as item_id from ebars_1d)"


@query(_ITEMS)
def src_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.report_items(_report_files(spark, sf_dir)).drop("source_path")


@query(_ITEMS + " where day(trade_date) % 2 = 0 or day(trade_date) % 3 = 0")
def src_report_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives by range of symbols and month with plain report files of even days and inner archives of every third, which plain files of their name hide; on disk, read by members."""
    files = _report_files(spark, sf_dir)
    day = F.regexp_extract("source_path", r"([0-9]{2})\.dat$", 1).cast("int")
    month = F.regexp_replace("source_path", r"/gpcw([0-9]{6})[0-9]{2}\.[a-z]+$", "/$1/reports.zip").alias("source_path")
    name = F.element_at(F.split("source_path", "/"), -1).alias("entry")
    plain = files.filter(day % 2 == 0).select(month, name, "content")
    inner = packers.zipped(files.filter(day % 3 == 0).select(F.replace(F.col("source_path"), F.lit(".dat"), F.lit(".zip")).alias("source_path"), name, "content"))
    root = landed(packers.zipped(plain.unionByName(inner.select(month, name, "content"))), "report-archives")
    found = tables.unshadowed(archives.contents(archives.directory(spark, root), (".dat",)))
    return records.report_items(records.as_files(found)).drop("source_path")


def _metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.ebars_1d(spark, sf_dir).withColumn("copy", F.explode(F.when(F.dayofmonth("trade_date") == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = rows.select(F.concat(F.lit("gp"), "market", "symbol", F.lit(".dat")).alias("source_path"), F.lit(3).alias("metric_type"), packers.date_number(F.col("trade_date")).alias("date"), (F.col("open") + F.col("copy")).alias("value1"), F.col("close").alias("value2"), "copy")
    return packers.packed(placed, records.METRIC, ["date", "copy"])


@query("select 'sz' as market, symbol, 3 as metric_type, trade_date as event_date, cast(cast(open as float) as double) as value1, cast(cast(close as float) as double) as value2 from ebars_1d")
def src_metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files with some repeated keys, of which the first counts. Their names put gp before the market, so it follows from the symbol."""
    found = records.metric_values(_metric_files(spark, sf_dir))[0]
    return found.select("market", "symbol", F.col("metric_type").cast("int").alias("metric_type"), "event_date", "value1", "value2")


@query("select 'duplicate_logical_key' as issue_type, symbol, count(*) as issue_count from ebars_1d where day(trade_date) = 5 group by all")
def src_metric_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = records.metric_values(_metric_files(spark, sf_dir))[1]
    return issues.groupBy("issue_type", F.regexp_extract("source_path", "([0-9]{6})", 1).alias("symbol")).agg(F.count("*").alias("issue_count"))


@query("select filename, reason from (select 'p' || page_id || '.html' as filename, case when page_id % 5 = 0 then 'not_listed' when page_id % 7 = 0 then 'size_mismatch' when page_id % 11 = 0 then 'md5_mismatch' end as reason from pages) where reason is not null union all select 'gone' || page_id || '.html', 'file_missing' from pages where page_id % 13 = 0")
def src_manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files against a manifest that lacks some, lists others wrongly, and some that are not there."""
    pages, n = views.table(spark, sf_dir, "pages"), F.col("page_id")
    files = pages.select(F.concat(F.lit("p"), n, F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    digest = F.when(n % 11 == 0, F.md5(F.lit("other"))).otherwise(F.upper(F.md5(F.col("html").cast("binary"))))
    size = F.octet_length("html") + F.when(n % 7 == 0, 1).otherwise(0)
    lines = pages.filter(n % 5 != 0).select(F.concat_ws(",", F.concat(F.lit("p"), n, F.lit(".html")), digest, size.cast("string")).alias("value"))
    gone = pages.filter(n % 13 == 0).select(F.concat(F.lit("gone"), n, F.lit(".html,"), F.md5(F.lit("x")), F.lit(",1")).alias("value"))
    return tables.manifest_mismatches(files, tables.manifest_lines(lines.unionByName(gone)))


# ---- review files


def _stock(amount: Column) -> Column:
    odd = F.col("board_count") % 2 == 1
    return F.struct(
        F.col("symbol").alias("code"),
        "board_count",
        F.concat(F.lit(" "), "reason_text", F.lit(" ")).alias("reason_type"),
        "theme_primary",
        F.array(F.col("theme_primary"), F.lit(" a "), F.lit("a")).alias("theme_tags"),
        amount.alias("amount"),
        F.when(odd, F.lit("093105")).otherwise("10:00").alias("first_limit_up_time"),
        F.when(odd, F.lit("-")).otherwise("14:59:30").alias("last_limit_up_time"),
        F.col("close_status").alias("status"),
        F.lit(0.0).alias("turnover_rate"),
        F.lit(0).alias("open_num"),
    )


def _snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of every day: its pools, a summary that counts one limit-up too many on every third day, and a relay."""
    events = views.limit_events(spark, sf_dir)
    amount = F.when(F.col("board_count") == 3, 0.0).otherwise(F.col("board_count") * 1.5)
    pool = lambda kind: F.collect_list(F.when(F.col("event_type") == kind, _stock(amount)))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    days = events.groupBy("trade_date").agg(
        pool("limit_up").alias("limit_up_pool"), pool("open_limit").alias("broken"), pool("limit_down").alias("limit_down"), F.struct((count("limit_up") + F.when(F.dayofmonth("trade_date") % 3 == 0, 1).otherwise(0)).alias("limit_up_count"), count("limit_down").alias("limit_down_count"), count("open_limit").alias("open_limit_count"), F.lit(0.5).alias("seal_success_rate"), F.max("board_count").alias("max_board_height")).alias("summary")
    )
    day = F.col("trade_date").cast("string")
    text = F.to_json(F.struct(F.array().cast("array<string>").alias("warnings"), day.alias("trade_date"), F.date_sub("trade_date", 1).cast("string").alias("prev_trade_date"), "summary", "limit_up_pool", "broken", "limit_down"))
    return days.select(F.concat(F.lit("/review/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit(".json")).alias("source_path"), text.alias("value"))


_TIMES = "case when board_count % 2 = 1 then '09:31' else '10:00' end as first_limit_minute, case when board_count % 2 = 0 then '14:59' end as last_limit_minute"


@query(f"select trade_date, 'sz' as market, symbol, event_type, close_status, board_count, trim(reason_text) as reason_text, theme_primary, case when theme_primary = '' then ['a'] else [theme_primary, 'a'] end as theme_tags, {_TIMES}, case when board_count <> 3 then board_count * 1.5::double end as amount, case when event_type = 'limit_up' then 0.0::double end as turnover_rate, case when close_status <> 'limit_down' then 0 end as open_count, null::varchar as issue from limit_events")
def src_snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of snapshots, with the zeros that one writer puts for unknown numbers as nulls."""
    rows = review_json.events(review_json.parsed_snapshots(_snapshot_files(spark, sf_dir)), "ths")
    kept = rows.withColumn("turnover_rate", F.when(F.col("event_type") == "limit_up", F.col("turnover_rate")))
    return kept.select("trade_date", "market", "symbol", "event_type", "close_status", "board_count", "reason_text", "theme_primary", "theme_tags", "first_limit_minute", "last_limit_minute", "amount", "turnover_rate", "open_count", "issue")


@query("select trade_date, 'limit_up' as event_type, count(*) filter (event_type = 'limit_up') + 1 as declared, count(*) filter (event_type = 'limit_up') as found from limit_events group by trade_date having day(trade_date) % 3 = 0")
def src_snapshot_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_json.parsed_snapshots(_snapshot_files(spark, sf_dir))
    return ops.count_mismatches(review_json.events(rows), review_json.declared_counts(rows))


@query("select trade_date, trade_date - 1 as prev_trade_date, count(*) filter (event_type = 'limit_up') + case when day(trade_date) % 3 = 0 then 1 else 0 end as limit_up_count, 0.5::double as seal_success_rate, max(board_count) as max_board_height, count(*) filter (event_type = 'limit_up' and board_count = 2) as two_board_count, count(*) filter (event_type = 'limit_up' and board_count >= 5) as five_plus_board_count from limit_events group by trade_date")
def src_snapshot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_json.parsed_snapshots(_snapshot_files(spark, sf_dir))
    found = review_json.summaries(rows, review_json.events(rows))
    return found.select("trade_date", "prev_trade_date", "limit_up_count", "seal_success_rate", "max_board_height", "two_board_count", "five_plus_board_count")


@query("select trade_date, sample_group, 'sz' as market, symbol, board_count as prev_board_count, case board_count when 1 then 'promoted' when 2 then 'sealed' when 3 then 'broken' when 4 then 'open_limit' when 5 then 'limit_down' end as today_status, case when board_count < 6 then board_count::double end as today_pct_chg, case when board_count = 6 then 'unsupported_status' end as issue from (select *, unnest(case when board_count >= 2 then ['prev_limit_up', 'prev_ladder'] else ['prev_limit_up'] end) as sample_group from limit_events where event_type = 'limit_up')")
def src_snapshot_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay samples, their statuses in the sources' words, their changes written as ratios."""
    height = F.col("board_count")
    word = F.element_at(F.array(*map(F.lit, ("连板", "平板", "断板", "炸板", "跌停", "?"))), height)
    stock = F.struct(F.col("symbol").alias("code"), height.alias("prev_board_count"), word.alias("today_status"), F.when(height < 6, height / 100).alias("today_pct_chg"))
    days = views.limit_events(spark, sf_dir).groupBy("trade_date").agg(F.collect_list(F.when(F.col("event_type") == "limit_up", stock)).alias("stocks"))
    day = F.col("trade_date").cast("string")
    none = F.array().cast("array<struct<code:string>>")
    text = F.to_json(F.struct(day.alias("trade_date"), F.date_sub("trade_date", 1).cast("string").alias("prev_trade_date"), F.struct(F.lit(0).alias("limit_up_count")).alias("summary"), none.alias("limit_up_pool"), none.alias("broken"), none.alias("limit_down"), F.struct(F.array(F.struct(F.lit(1).alias("height"), "stocks")).alias("height_groups")).alias("relay")))
    files = days.select(F.concat(F.lit("/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit(".json")).alias("source_path"), text.alias("value"))
    found = review_json.relay(review_json.parsed_snapshots(files), 100.0)
    return found.select("trade_date", "sample_group", "market", "symbol", "prev_board_count", "today_status", F.round("today_pct_chg", 6).alias("today_pct_chg"), "issue")


def line_no() -> Column:
    """A day's events go to a line for every hundred symbols, however many symbols there are."""
    return F.floor(F.col("symbol").cast("int") / 100).alias("line_no")


@query("select trade_date, 'sz' as market, symbol, event_type, board_count, 'n' as reason, case when day(trade_date) % 4 = 1 then 'unknown_field' when day(trade_date) % 4 = 2 then 'mode_not_allowed' when day(trade_date) % 4 = 3 then 'reason_and_audit_ref_required' end as issue from limit_events")
def src_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of corrected events for every day; some with a field too many, a mode that is not allowed, or no audit reference."""
    event = F.struct(F.col("symbol").alias("code"), "event_type", "close_status", "board_count", "theme_primary")
    day = F.dayofmonth("trade_date") % 4
    lines = views.limit_events(spark, sf_dir).groupBy("trade_date", line_no()).agg(F.collect_list(event).alias("events"))
    fields = [F.col("trade_date").cast("string").alias("trade_date"), F.when(day == 2, "upsert").otherwise("enrich_existing").alias("mode"), F.lit("n").alias("reason"), F.when(day == 3, "").otherwise("ref").alias("audit_ref"), F.col("events")]
    value = F.when(day == 1, F.to_json(F.struct(*fields, F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(*fields)))
    return review_json.corrections(lines.select(value.alias("value"))).select("trade_date", "market", "symbol", "event_type", "board_count", "reason", "issue")


@query("select index_code, trade_date, close, null::varchar as issue from index_bars union all select null, null, null, 'invalid_file' from (select distinct index_code from index_bars)")
def src_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars in files that hold an array, or an object around one; a broken file for each is an issue."""
    rows = views.index_bars(spark, sf_dir).groupBy("index_code").agg(F.collect_list(F.struct("index_code", F.col("trade_date").cast("string").alias("trade_date"), "close")).alias("bars"))
    plain, wrapped = F.to_json("bars"), F.to_json(F.struct("bars"))
    files = rows.select(F.explode(F.array(F.when(F.col("index_code") == "prev_ladder_perf", plain).otherwise(wrapped), F.lit("{}"))).alias("value"))
    found = review_json.normalized_rows(files, "bars", "index_code string, trade_date string, close double")
    return found.select("index_code", F.col("trade_date").cast("date").alias("trade_date"), "close", "issue")


# ---- provider payloads and pages


_PROVIDER = "select market || symbol as code, trade_date, open, close, high, low, volume::double as volume, amount from bars_1d"


@query(_PROVIDER)
def src_kline_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of every instrument's bars, each bar a comma-joined text, twice; equal bars count once."""
    rows = views.bars_1d(spark, sf_dir).withColumn("code", F.concat("market", "symbol"))
    line = F.concat_ws(",", F.col("trade_date").cast("string"), *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume", "amount")])
    bars = rows.groupBy("code").agg(F.collect_list(line).alias("klines"))
    payloads = bars.select(F.to_json(F.struct(F.struct("code", "klines").alias("data"))).alias("value"))
    return tables.checked_bars(tables.kline_payloads(payloads.unionByName(payloads)), ["code", "trade_date"], F.lit(True))


@query("select trade_date, open, high, low, close, volume::double as volume, amount from bars_1d")
def src_jsonp_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every instrument and year, its days joined by semicolons."""
    day = F.concat_ws(",", F.date_format("trade_date", "yyyyMMdd"), *[F.col(c).cast("string") for c in (*PRICES, "volume", "amount")])
    years = views.bars_1d(spark, sf_dir).groupBy("market", "symbol", F.year("trade_date").alias("year")).agg(F.array_join(F.collect_list(day), ";").alias("data"))
    return tables.jsonp_years(years.select(F.concat(F.lit("quotes_"), F.col("year").cast("string"), F.lit("("), F.to_json(F.struct("data")), F.lit(");")).alias("value")))


@query("select 'ths' as provider, trade_date, close, volume::double as volume, 'provider_native' as volume_unit, amount, 'CNY' as amount_unit, 'Asia/Shanghai' as timezone from bars_1d")
def src_labelled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of yearly payloads with their provider's units."""
    return tables.labelled_bars(src_jsonp_years(spark, sf_dir), "ths").select("provider", "trade_date", "close", "volume", "volume_unit", "amount", "amount_unit", "timezone")


@query("select page_id, k - 1 as position, regexp_extract(link, '^<a href=\"([^\"]*)\"', 1) as href, regexp_extract(link, '>([^<]*)<', 1) as name from (select page_id, unnest(links) as link, unnest(range(1, len(links) + 1)) as k from (select page_id, regexp_extract_all(regexp_extract(html, '<ul>.*?</ul>', 0, 's'), '<a href=\"[^\"]*\">[^<]*</a>') as links from pages))")
def src_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the menu of every page, its list put into a div of a class."""
    html = F.regexp_replace(F.regexp_replace("html", "(?s)<ul>", "<div class=\"cate x\"><ul>"), "(?s)</ul>", "</ul></div>")
    found = tables.page_links(views.table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "cate")
    return found.select("page_id", "position", "href", "name")


@query("select board, count(*) as found, count(*) + 1 as declared from securities where board in ('BUILDING', 'MACHINERY') group by board")
def src_catalogue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages of 50 members: two boards declare one member more than their pages hold."""
    from quotemill.operators.ordering import incomplete_catalogues

    rows = views.securities(spark, sf_dir).withColumn("page", F.floor(F.col("symbol").cast("int") / 50))
    pages = rows.groupBy("board", "page").agg(F.count("*").alias("rows"))
    totals = rows.groupBy("board").agg((F.count("*") + F.when(F.col("board").isin("BUILDING", "MACHINERY"), 1).otherwise(0)).alias("total"))
    return incomplete_catalogues(pages.join(totals, "board"), ["board"], "rows", "total")


# ---- protocol frames


def _cents(c: str, unit: int = 1000) -> Column:
    return F.round(F.col(c) * unit).cast("long")


@query("select market, symbol, trade_date, open, high, low, close, 2097152.0::double as volume, up_count, down_count from (select *, volume % 100 as up_count, day(trade_date) as down_count from ebars_1d)")
def wire_index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed frames of daily index bars, prices as differences, volumes in the vendor's floating format."""
    from pyspark.sql import Window

    rows = views.ebars_1d(spark, sf_dir)
    before = Window.partitionBy("symbol").orderBy("trade_date")
    placed = rows.select(
        F.col("symbol").cast("long").alias("frame_id"), "market", packers.date_number(F.col("trade_date")).alias("day"), (_cents("open") - F.coalesce(F.lag(_cents("close")).over(before), F.lit(0))).alias("o"), *[(_cents(c) - _cents("open")).alias(c[0]) for c in ("close", "high", "low")], (F.col("volume") % 100).alias("up"), F.dayofmonth("trade_date").alias("down")
    )

    def record(r: dict) -> bytes:
        return struct.pack("<I", r["day"]) + b"".join(packers.varint(int(r[k])) for k in "ochl") + struct.pack("<IIHH", 0x4A000000, 0x4A000000, r["up"], r["down"])

    frames = wire.unpacked(packers.framed(placed, ["day"], record, lambda n: struct.pack("<H", n)))
    found = wire.bars(frames, 9, index=True).withColumn("symbol", F.lpad(F.col("frame_id").cast("string"), 6, "0"))
    return found.select(views.market_of(F.col("frame_id")).alias("market"), "symbol", "trade_date", *PRICES, "volume", F.col("up_count").cast("long").alias("up_count"), F.col("down_count").cast("long").alias("down_count"))


@query("select symbol, trade_date, row_number() over (partition by symbol, trade_date order by minute_of_day) - 1 as point_index, close as price, volume, case when row_number() over (partition by symbol, trade_date order by minute_of_day) - 1 < 120 then 569 + row_number() over (partition by symbol, trade_date order by minute_of_day) else 659 + row_number() over (partition by symbol, trade_date order by minute_of_day) end as minute_of_day from ebars_1m")
def wire_minute_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = views.ebars_1m(spark, sf_dir)
    before = Window.partitionBy("symbol", "trade_date").orderBy("minute_of_day")
    frame = F.col("symbol").cast("long") * 100_000_000 + packers.date_number(F.col("trade_date"))
    placed = rows.select(frame.alias("frame_id"), "minute_of_day", (_cents("close", 100) - F.coalesce(F.lag(_cents("close", 100)).over(before), F.lit(0))).alias("d"), "volume")
    frames = wire.unpacked(packers.framed(placed, ["minute_of_day"], lambda r: packers.varint(int(r["d"])) + packers.varint(0) + packers.varint(int(r["volume"])), lambda n: struct.pack("<HH", n, 0)))
    found = wire.minute_points(frames)
    return found.select(F.lpad(F.floor(F.col("frame_id") / 100_000_000).cast("string"), 6, "0").alias("symbol"), F.to_date((F.col("frame_id") % 100_000_000).cast("string"), "yyyyMMdd").alias("trade_date"), "point_index", "price", "volume", F.col("minute_of_day").cast("long").alias("minute_of_day"))


@query("select symbol, trade_date, minute_of_day, close as price, volume, volume + 1 as num, case when close >= open then 0 else 1 end as side from ebars_1m")
def wire_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = views.ebars_1m(spark, sf_dir)
    before = Window.partitionBy("symbol", "trade_date").orderBy("minute_of_day")
    frame = F.col("symbol").cast("long") * 100_000_000 + packers.date_number(F.col("trade_date"))
    placed = rows.select(frame.alias("frame_id"), "minute_of_day", (_cents("close", 100) - F.coalesce(F.lag(_cents("close", 100)).over(before), F.lit(0))).alias("d"), "volume", F.when(F.col("close") >= F.col("open"), 0).otherwise(1).alias("side"))

    def record(r: dict) -> bytes:
        return struct.pack("<H", r["minute_of_day"]) + b"".join(map(packers.varint, (int(r["d"]), int(r["volume"]), int(r["volume"]) + 1, int(r["side"]), 0)))

    found = wire.transactions(wire.unpacked(packers.framed(placed, ["minute_of_day"], record, lambda n: struct.pack("<H", n))))
    return found.select(F.lpad(F.floor(F.col("frame_id") / 100_000_000).cast("string"), 6, "0").alias("symbol"), F.to_date((F.col("frame_id") % 100_000_000).cast("string"), "yyyyMMdd").alias("trade_date"), F.col("minute_of_day").cast("long").alias("minute_of_day"), "price", "volume", "num", "side")


def _action_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of every instrument's corporate actions of a year; those of the third day of a month have no valid date."""
    market = F.col("market")
    day = F.when(F.dayofmonth("event_date") == 3, 20_241_399).otherwise(packers.date_number(F.col("event_date")))
    placed = views.xdxr_events(spark, sf_dir).select(F.when(market == "sz", 0).when(market == "sh", 1).otherwise(2).alias("market_no"), (F.col("symbol").cast("long") * 30_000 + F.year("event_date") * 3 + F.when(market == "sz", 0).when(market == "sh", 1).otherwise(2)).alias("frame_id"), "symbol", day.alias("day"), (F.dayofmonth("event_date") % 14 + 1).alias("category"), "event_date", *_RIGHTS)

    def record(r: dict) -> bytes:
        return struct.pack("<B6sBIB4f", r["market_no"], r["symbol"].encode(), 0, r["day"], r["category"], *(r[c] for c in _RIGHTS))

    return wire.unpacked(packers.framed(placed, ["symbol", "event_date"], record, lambda n: b"\0" * 9 + struct.pack("<H", n)))


_NAMES = "case category " + " ".join(f"when {k} then '{v}'" for k, v in wire.CATEGORY_NAMES.items()) + " end"


@query(f"select market, symbol, event_date, category, {_NAMES} as category_name, case when category = 1 then cast(cast(fenhong as float) as double) end as fenhong, case when category = 1 then cast(cast(songzhuangu as float) as double) end as songzhuangu from (select * replace (day(event_date) % 14 + 1 as category) from xdxr_events) where day(event_date) <> 3")
def wire_corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wire.corporate_actions(_action_frames(spark, sf_dir))[0]
    return found.select("market", "symbol", "event_date", "category", "category_name", "fenhong", "songzhuangu")


@query("select 'invalid_xdxr_date' as issue_type, count(*) as issue_count from xdxr_events where day(event_date) = 3")
def wire_action_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.corporate_actions(_action_frames(spark, sf_dir))[1].groupBy("issue_type").agg(F.count("*").alias("issue_count"))


def frame_of(number: Column, order: list[str], records: int = 100) -> Column:
    """Frames of so many rows at most: rows by number, and where several rows have one number, by their order."""
    block = F.floor(number / records)
    place = F.row_number().over(Window.partitionBy(block).orderBy(*order)) - 1
    return (block * 1_000_000 + F.floor(place / records)).alias("frame_id")


@query("select case market when 'sz' then 0 when 'sh' then 1 else 2 end as market_code, symbol, 'N ' || (cast(symbol as int) % 7) as name, 9.5::double as pre_close, (cast(symbol as bigint) * 3)::double as volume, (-(cast(symbol as bigint) % 5))::double as consecutive_up from securities")
def wire_board_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 100 members with three fields of the bitmap: a float, an unsigned and a signed number."""
    n, market = F.col("symbol").cast("long"), F.col("market")
    placed = views.securities(spark, sf_dir).select(frame_of(n, ["symbol", "market"]), F.when(market == "sz", 0).when(market == "sh", 1).otherwise(2).alias("code"), "symbol", F.concat(F.lit("N "), (n % 7).cast("string")).alias("name"), n.alias("n"))
    bitmap = bytearray(20)
    bitmap[0], bitmap[11] = 0b100001, 0b10000
    head = bytes(bitmap) + b"\0" * 4

    def record(r: dict) -> bytes:
        return struct.pack("<H22s44sfIi", r["code"], r["symbol"].encode(), r["name"].encode("gb18030"), 9.5, r["n"] * 3, -(r["n"] % 5))

    found = wire.board_members(wire.unpacked(packers.framed(placed, ["symbol"], record, lambda n: head + struct.pack("<H", n))))
    return found.select(F.col("market_code").cast("int").alias("market_code"), "symbol", "name", *[F.col("fields")[k].alias(k) for k in ("pre_close", "volume", "consecutive_up")])




# ---- record files by ranges, archives by members


def landed(files: DataFrame, label: str) -> str:
    """Files (source_path, content) written by tasks into a new folder of the shared one; its place. A repeated task writes the same files again."""
    spark = files.sparkSession
    root = shared_path(spark, label)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["source_path"], batch["content"], strict=True):
                store.put(f"{root}/{path.lstrip('/')}", content)
            yield batch[["source_path"]]

    files.mapInPandas(run, "source_path string").write.format("noop").mode("overwrite").save()
    return root


def _cut_day_files(spark: SparkSession, sf_dir: str) -> str:
    """Day files on disk, those of Shenzhen with five bytes of one more record behind them."""
    files = _day_files(views.bars_1d(spark, sf_dir))
    return landed(files.withColumn("content", F.when(F.col("source_path").contains("/sz"), F.concat("content", F.lit(b"12345"))).otherwise(F.col("content"))), "day-files")


@query(f"select market, symbol, trade_date, open, high, low, close, {_f('amount')}, volume from bars_1d where market in ('sh', 'sz') and trade_date >= date '1995-01-01' and trade_date < date '1997-01-01'")
def src_day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two markets and two years of day files, some of them cut, read by ranges of 300 records: markets prune files, days are searched for."""
    rows, _ = ranges.checked_rows(spark, _cut_day_files(spark, sf_dir), "day", glob="*.day", records_per_task=300, ordered=True)
    day = F.col("trade_date")
    return rows.filter(F.col("market").isin("sh", "sz") & (day >= F.lit("1995-01-01").cast("date")) & (day < F.lit("1997-01-01").cast("date"))).select("market", "symbol", "trade_date", *PRICES, "amount", "volume")


@query("select market, symbol, 'incomplete_trailing_bytes' as issue_type, count(*) as row_offset from bars_1d where market = 'sz' group by all")
def src_day_range_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue of each cut file, at the place after its whole records."""
    _, issues = ranges.checked_rows(spark, _cut_day_files(spark, sf_dir), "day", glob="*.day")
    name = F.element_at(F.split("source_path", "/"), -1)
    return issues.select(F.substring(name, 1, 2).alias("market"), F.substring(name, 3, 6).alias("symbol"), "issue_type", "row_offset")


@query(f"select market, symbol, trade_date, minute_of_day, {_FLOATS}, {_f('amount')}, volume from ebars_1m")
def src_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute files in an archive for each instrument's last digit, on disk: the archives' directories are read, then each member by a task."""
    files = _minute_files(views.ebars_1m(spark, sf_dir), F.lit(".lc5"), False)
    digit = F.regexp_extract("source_path", r"([0-9])\.lc5$", 1)
    root = landed(packers.zipped(files.select(F.concat(digit, F.lit("/lc5.zip")).alias("source_path"), F.col("source_path").alias("entry"), "content")), "minute-archives")
    bars, _ = archives.checked_rows(archives.directory(spark, root), "minute", (".lc5",))
    return bars.select("market", "symbol", "trade_date", F.col("minute_of_day").cast("long").alias("minute_of_day"), *PRICES, "amount", "volume")


def _packages(spark: SparkSession, sf_dir: str) -> str:
    """A package of each day: a share of every market and an index for each bar of the day, by its place. Of the days of a month the second's package lacks a
    market's bars, the third's has an entry of another day, the fourth's fewer codes than bars, the fifth's a symbol twice, the sixth's an idle share."""
    day = F.dayofmonth("trade_date")
    rows = views.bars_1d(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("trade_date").orderBy("market", "symbol")))
    markets = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p")) for m, p in (("sh", "60"), ("sz", "00"), ("bj", "92"), ("sz", "39"))]))
    named = rows.select("trade_date", day.alias("d"), "n", markets.alias("k"), *PRICES, "volume", "amount").select("*", F.col("k.m").alias("m"), F.concat("k.p", F.lpad(F.when((F.col("d") == 5) & (F.col("n") == 2), 1).otherwise(F.col("n")).cast("string"), 4, "0")).alias("symbol"))
    idle = (F.col("d") == 6) & (F.col("n") == 1)
    placed = named.select(
        F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit("/"), "m", F.date_format(F.when((F.col("d") == 3) & (F.col("m") == "bj"), F.date_add("trade_date", 1)).otherwise(F.col("trade_date")), "yyMMdd")).alias("source_path"),
        *[F.when(idle & F.lit(c != "close"), 0).otherwise(F.col(c)).alias(c) for c in (*PRICES, "volume", "amount")], "symbol", "n", "d", "m",
    )
    codes = packers.packed(placed.filter("not (d = 4 and m = 'sz' and n = 1)"), records.np.dtype([("symbol", f"S{records.PACK_CODE}")]), ["symbol", "n"]).withColumn("kind", F.lit(".cod"))
    bars = packers.packed(placed.filter("not (d = 2 and m = 'bj')"), records.PACK_BAR, ["symbol", "n"]).withColumn("kind", F.lit(".md1"))
    parts = F.split("source_path", "/")
    return landed(packers.zipped(codes.unionByName(bars).select(F.concat(parts[0], F.lit(".zip")).alias("source_path"), F.concat(parts[1], "kind").alias("entry"), "content")), "packages")


_PROBLEM = "case when day(trade_date) = 2 then 'missing_pair' when day(trade_date) = 3 then 'mixed_dates' when day(trade_date) = 4 then 'record_count_mismatch' when day(trade_date) = 5 and count(*) > 1 then 'duplicate_symbol' end"


@query(f"select cast(trade_date as varchar) as package, {_PROBLEM} as problem from bars_1d group by trade_date")
def src_package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each package: all but repeated symbols from the archives' directories alone."""
    _, checks, _ = archives.packages(archives.directory(spark, _packages(spark, sf_dir)))
    return checks.select(F.regexp_extract("source_path", r"([0-9-]{10})\.zip$", 1).alias("package"), "problem")


@query(f"""
select cast(trade_date as varchar) as package, market, class, sum(n) as records
from (
  select trade_date, day(trade_date) as d, count(*) as c from bars_1d group by trade_date having {_PROBLEM} is null),
  lateral (select market, class, n from (values ('sh', 'share', case when d = 6 then c - 1 else c end), ('sz', 'share', case when d = 6 then c - 1 else c end), ('bj', 'share', case when d = 6 then c - 1 else c end), ('sz', 'other', c),
    ('sh', 'idle', case when d = 6 then 1 else 0 end), ('sz', 'idle', case when d = 6 then 1 else 0 end), ('bj', 'idle', case when d = 6 then 1 else 0 end)) v(market, class, n))
where n > 0 group by all""")
def src_package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the packages taken, by market and class."""
    _, _, counts = archives.packages(archives.directory(spark, _packages(spark, sf_dir)))
    return counts.select(F.regexp_extract("source_path", r"([0-9-]{10})\.zip$", 1).alias("package"), "market", "class", "records")
