"""The driver's test tables seen as market data: bars, corporate actions, limit events, securities and the others.

Each view is a function of (spark, sf_dir); SQL has the same views in DuckDB's dialect, written apart, for the queries' twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_of(number: Column) -> Column:
    return F.when(number % 3 == 0, "sh").when(number % 3 == 1, "sz").otherwise("bj")


def symbol_of(number: Column) -> Column:
    """Six digits; of a longer number the first six, so that a symbol is no key of the numbers."""
    return F.lpad(number.cast("string"), 6, "0")


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.col("o_custkey") % 25
    rows = table(spark, sf_dir, "orders").select(sid.alias("sid"), F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))
    bars = rows.groupBy("sid", "trade_date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").alias("volume"), _money("p").alias("amount"))
    return bars.select(market_of(F.col("sid")).alias("market"), symbol_of(F.col("sid")).alias("symbol"), "trade_date", "open", "high", "low", "close", "volume", "amount")


def xdxr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7 and l_orderkey % 100 = 0")
    rows = rows.groupBy((F.col("l_partkey") % 25).alias("sid"), F.col("l_shipdate").cast("date").alias("event_date")).agg(F.max("l_tax").alias("tax"), F.max("l_discount").alias("discount"))
    return rows.select(market_of(F.col("sid")).alias("market"), symbol_of(F.col("sid")).alias("symbol"), "event_date", F.lit(1).alias("category"), (F.col("tax") * 100).cast("double").alias("fenhong"), F.lit(0.0).alias("peigujia"), (F.col("discount") * 10).cast("double").alias("songzhuangu"), F.lit(0.0).alias("peigu"))


def _minute(c: str = "ts") -> Column:
    return F.hour(c) * 60 + F.minute(c)


def ebars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("trade_date"), _minute().alias("minute_of_day"))
    bars = rows.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume"), _money("value").alias("amount"))
    return bars.select(market_of(F.col("user_id")).alias("market"), symbol_of(F.col("user_id")).alias("symbol"), "trade_date", "minute_of_day", "open", "high", "low", "close", "volume", "amount")


def ebars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ebars_1m(spark, sf_dir).groupBy("market", "symbol", "trade_date")
    return days.agg(F.min_by("open", "minute_of_day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute_of_day").alias("close"), F.sum("volume").alias("volume"))


def exdxr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = (F.col("trade_date") > F.lit("2024-01-10").cast("date")) | (F.col("symbol").cast("int") % 10 == 0)
    rows = ebars_1m(spark, sf_dir).filter(some & (F.col("minute_of_day") % 37 == 0)).groupBy("market", "symbol", F.col("trade_date").alias("event_date"))
    bonus = rows.agg((1 + F.max("minute_of_day") % 5).cast("double").alias("songzhuangu"))
    return bonus.select("market", "symbol", "event_date", F.lit(1).alias("category"), F.lit(0.0).alias("fenhong"), F.lit(0.0).alias("peigujia"), "songzhuangu", F.lit(0.0).alias("peigu"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("market", "symbol", "trade_date").orderBy("minute_of_day")) - 1
    return ebars_1m(spark, sf_dir).select("market", "symbol", "trade_date", "minute_of_day", index.alias("point_index"), F.col("close").alias("price"), "volume")


def limit_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").filter(kind.isin("purchase", "error", "signup"))
    resealed = F.when(F.col("event_id") % 2 == 0, "broken_reseal").otherwise("broken")
    return rows.select(
        F.col("event_id").alias("commit_seq"),
        F.col("ts").cast("date").alias("trade_date"),
        market_of(F.col("user_id")).alias("market"),
        symbol_of(F.col("user_id")).alias("symbol"),
        F.when(kind == "purchase", "limit_up").when(kind == "error", "limit_down").otherwise("open_limit").alias("event_type"),
        F.when(kind == "purchase", "sealed").when(kind == "error", "limit_down").otherwise(resealed).alias("close_status"),
        (1 + F.col("event_id") % 6).cast("int").alias("board_count"),
        F.concat(F.lit("Reason "), F.when(F.col("event_id") % 3 == 0, "AI+50%_x").otherwise(F.col("props"))).alias("reason_text"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("theme"), (F.col("event_id") % 7).cast("string"))).alias("theme_primary"),
    )


EVENT_KEY = ("trade_date", "event_type", "market", "symbol")


def limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotemill.operators.latest import newest

    return newest(limit_events_raw(spark, sf_dir), EVENT_KEY, "commit_seq")


def limit_summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = limit_events(spark, sf_dir).select("trade_date").distinct()
    days = days.withColumn("prev_trade_date", F.lag("trade_date").over(Window.orderBy("trade_date")))
    rate = F.when(F.dayofmonth("trade_date") % 5 != 0, F.lit(0.5))
    return days.select("trade_date", "prev_trade_date", F.lit(99).cast("long").alias("limit_up_count"), rate.alias("seal_success_rate")).filter(F.dayofmonth("trade_date") % 7 != 0)


def limit_relay_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = limit_summary_stored(spark, sf_dir).filter("prev_trade_date is not null").select("trade_date", "prev_trade_date")
    rows = ebars_1d(spark, sf_dir).filter(F.col("symbol").cast("int") % 4 == 0).join(days, "trade_date")
    return rows.select("trade_date", "prev_trade_date", "market", "symbol", F.lit("prev_limit_up").alias("sample_group"), F.lit(1).alias("prev_board_count"), F.lit("broken").alias("today_status"), F.lit(1.5).alias("today_pct_chg"))


def themes_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = limit_events(spark, sf_dir).filter("theme_primary <> ''").groupBy("theme_primary").agg(F.count("*").alias("limit_up_count"))
    rows = counted.select(F.lit("2024-02-05").cast("date").alias("trade_date"), F.col("theme_primary").alias("theme_name"), "limit_up_count", F.lit(1).alias("strength_rank"))
    stale = spark.range(1).select(F.lit("2024-01-02").cast("date").alias("trade_date"), F.lit("stale").alias("theme_name"), F.lit(99).cast("long").alias("limit_up_count"), F.lit(1).alias("strength_rank"))
    return rows.unionByName(stale)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    code = F.when(kind == "click", "prev_limit_up_perf").when(kind == "view", "prev_ladder_perf").when(kind == "purchase", "prev_limit_down_perf").otherwise("prev_non_st_limit_up_perf")
    rows = table(spark, sf_dir, "events").filter(kind != "error").groupBy(code.alias("index_code"), F.col("ts").cast("date").alias("trade_date"))
    return rows.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))


def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of symbols whose bar closed above, below or at its open."""
    days = ebars_1d(spark, sf_dir).groupBy("trade_date")
    return days.agg(F.count_if(F.col("close") > F.col("open")).alias("up_count"), F.count_if(F.col("close") < F.col("open")).alias("down_count"), F.count_if(F.col("close") == F.col("open")).alias("flat_count"), F.count("*").alias("total_count"))


def _plain(c: str) -> Column:
    return F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(market_of(F.col("c_nationkey")).alias("market"), symbol_of(F.col("c_custkey")).alias("symbol"), F.col("c_name").alias("current_name"), _plain("c_name").alias("current_name_norm"), F.col("c_mktsegment").alias("board"))


def security_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("both", F.concat("p_brand", "p_name"))
    rows = securities(spark, sf_dir).select("market", "symbol").join(part, F.col("symbol").cast("int") == F.col("p_partkey"))
    return rows.select("market", "symbol", F.concat_ws(" ", "p_brand", "p_name").alias("alias"), _plain("both").alias("alias_norm"), F.lit(50).alias("priority"))


def security_name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    rows = securities(spark, sf_dir).select("market", "symbol").join(supplier, F.col("symbol").cast("int") == F.col("s_suppkey"))
    return rows.select("market", "symbol", F.col("s_name").alias("name"), _plain("s_name").alias("name_norm"), F.lit("2000-01-01").cast("date").alias("valid_from"))


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "conflicting_logical_key").when(n % 3 == 0, "invalid_date").otherwise("duplicate_logical_key")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.when(n % 5 == 0, "error").otherwise("warning").alias("severity"), kind.alias("issue_type"), F.col("ts").alias("observed_at"), n.alias("event_id"))


_MARKET = "case {0} % 3 when 0 then 'sh' when 1 then 'sz' else 'bj' end"
_SYMBOL = "lpad(cast({0} as varchar), 6, '0')"

#: The same views for DuckDB, in the order of their dependence.
SQL: dict[str, str] = {
    "bars_1d": f"select {_MARKET.format('sid')} as market, {_SYMBOL.format('sid')} as symbol, trade_date, min_by(p,k) as open, max(p) as high, min(p) as low, max_by(p,k) as close, count(*) as volume, cast(sum(cast(p as decimal(18,2))) as double) as amount from (select o_custkey%25 as sid, cast(o_orderdate as date) as trade_date, o_totalprice as p, o_orderkey as k from orders) x group by sid, trade_date",
    "xdxr_events": f"select {_MARKET.format('sid')} as market, {_SYMBOL.format('sid')} as symbol, event_date, 1 as category, max(l_tax)*100 as fenhong, 0.0::double as peigujia, max(l_discount)*10 as songzhuangu, 0.0::double as peigu from (select l_partkey%25 as sid, cast(l_shipdate as date) as event_date, l_tax, l_discount from lineitem where l_linenumber=7 and l_orderkey%100=0) x group by sid, event_date",
    "ebars_1m": f"select {_MARKET.format('user_id')} as market, {_SYMBOL.format('user_id')} as symbol, cast(ts as date) as trade_date, hour(ts)*60+minute(ts) as minute_of_day, min_by(value,event_id) as open, max(value) as high, min(value) as low, max_by(value,event_id) as close, count(*) as volume, cast(sum(cast(value as decimal(18,2))) as double) as amount from events group by user_id, cast(ts as date), hour(ts)*60+minute(ts)",
    "ebars_1d": "select market, symbol, trade_date, min_by(open,minute_of_day) as open, max(high) as high, min(low) as low, max_by(close,minute_of_day) as close, sum(volume) as volume from ebars_1m group by market, symbol, trade_date",
    "exdxr_events": "select market, symbol, trade_date as event_date, 1 as category, 0.0::double as fenhong, 0.0::double as peigujia, cast(1+max(minute_of_day)%5 as double) as songzhuangu, 0.0::double as peigu from ebars_1m where (trade_date > date '2024-01-10' or cast(symbol as int)%10=0) and minute_of_day%37=0 group by market, symbol, trade_date",
    "points": "select market, symbol, trade_date, minute_of_day, row_number() over (partition by market,symbol,trade_date order by minute_of_day)-1 as point_index, close as price, volume from ebars_1m",
    "limit_events_raw": f"select event_id as commit_seq, cast(ts as date) as trade_date, {_MARKET.format('user_id')} as market, {_SYMBOL.format('user_id')} as symbol, case event_type when 'purchase' then 'limit_up' when 'error' then 'limit_down' when 'signup' then 'open_limit' end as event_type, case event_type when 'purchase' then 'sealed' when 'error' then 'limit_down' else (case when event_id%2=0 then 'broken_reseal' else 'broken' end) end as close_status, cast(1+event_id%6 as int) as board_count, concat('Reason ', case when event_id%3=0 then 'AI+50%_x' else props end) as reason_text, case when event_id%11=0 then '' else concat('theme', cast(event_id%7 as varchar)) end as theme_primary from events where event_type in ('purchase','error','signup')",
    "limit_events": "select trade_date, event_type, market, symbol, max_by(close_status,commit_seq) as close_status, max_by(board_count,commit_seq) as board_count, max_by(reason_text,commit_seq) as reason_text, max_by(theme_primary,commit_seq) as theme_primary from limit_events_raw group by trade_date, event_type, market, symbol",
    "limit_summary_stored": "select trade_date, prev_trade_date, 99::bigint as limit_up_count, case when day(trade_date)%5=0 then cast(null as double) else 0.5 end as seal_success_rate from (select trade_date, lag(trade_date) over (order by trade_date) as prev_trade_date from (select distinct trade_date from limit_events) d) x where day(trade_date)%7<>0",
    "limit_relay_stored": "select e.trade_date, s.prev_trade_date, e.market, e.symbol, 'prev_limit_up' as sample_group, 1 as prev_board_count, 'broken' as today_status, 1.5::double as today_pct_chg from ebars_1d e join limit_summary_stored s on e.trade_date=s.trade_date where s.prev_trade_date is not null and cast(e.symbol as int)%4=0",
    "themes_stored": "select date '2024-02-05' as trade_date, theme_primary as theme_name, count(*) as limit_up_count, 1 as strength_rank from limit_events where theme_primary<>'' group by theme_primary union all select date '2024-01-02', 'stale', 99, 1",
    "index_bars": "select case event_type when 'click' then 'prev_limit_up_perf' when 'view' then 'prev_ladder_perf' when 'purchase' then 'prev_limit_down_perf' else 'prev_non_st_limit_up_perf' end as index_code, cast(ts as date) as trade_date, min_by(value,event_id) as open, max(value) as high, min(value) as low, max_by(value,event_id) as close from events where event_type<>'error' group by 1, 2",
    "breadth": "select trade_date, count(*) filter (close > open) as up_count, count(*) filter (close < open) as down_count, count(*) filter (close = open) as flat_count, count(*) as total_count from ebars_1d group by trade_date",
    "securities": f"select {_MARKET.format('c_nationkey')} as market, {_SYMBOL.format('c_custkey')} as symbol, c_name as current_name, lower(replace(c_name,' ','')) as current_name_norm, c_mktsegment as board from customer",
    "security_aliases": "select market, symbol, concat(p_brand,' ',p_name) as alias, lower(replace(concat(p_brand,p_name),' ','')) as alias_norm, 50 as priority from securities join part on cast(symbol as int)=p_partkey",
    "security_name_history": "select market, symbol, s_name as name, lower(replace(s_name,' ','')) as name_norm, date '2000-01-01' as valid_from from securities join supplier on cast(symbol as int)=s_suppkey",
    "quality_issues": "select event_type as dataset, case when event_id%5=0 then 'error' else 'warning' end as severity, case when event_id%5=0 then 'conflicting_logical_key' when event_id%3=0 then 'invalid_date' else 'duplicate_logical_key' end as issue_type, ts as observed_at, event_id from events",
}


def with_views(select: str) -> str:
    """A select for DuckDB, preceded by all views; those it does not name cost nothing."""
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in SQL.items()) + "\n" + select
