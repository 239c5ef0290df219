"""All queries of the library proper over the driver's tables, by name, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import dates, text
from quotemill.operators import latest, ordering, timeseries
from quotemill.plans import adapters as views
from quotemill.plans import bars, derive, imports, ops, review, securities
from quotemill.plans.params import BarQuery, LimitQuery, PointQuery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its twin over the adapter views."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = views.with_views(sql)
        return function

    return register


def same_as(name: str) -> Callable[[Query], Query]:
    """Registers a query that must give what another gives, under its twin."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, ORACLE_SQL[name]
        return function

    return register


JANUARY = LimitQuery(since="2024-01-01", until="2024-01-31")
ONE = {"market": "sz", "symbol": "000001"}
_RETURNS = """derived as (select market, symbol, trade_date, close, last_value(case when close > 0 then close end ignore nulls) over (partition by market, symbol order by trade_date rows between unbounded preceding and 1 preceding) as prev_close from {bars})"""
_DERIVED = "market, symbol, trade_date, prev_close, case when prev_close > 0 then (close - prev_close) / prev_close * 100 end as pct_chg"


def _chain(*parts: str, select: str) -> str:
    return "select * from (with " + ", ".join(parts) + " " + select + ")"


_DAILY = _RETURNS.format(bars="bars_1d")


@query(_chain(_DAILY, select=f"select {_DERIVED} from derived"))
def daily_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.daily_derived(views.bars_1d(spark, sf_dir))


@query(_chain(_DAILY, select=f"select {_DERIVED} from derived where trade_date between date '1996-03-01' and date '1996-03-31'"))
def daily_derived_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.daily_derived(views.bars_1d(spark, sf_dir), "1996-03-01", "1996-03-31")


@query(_chain(_DAILY, select=f"select * from (select {_DERIVED} from derived) where pct_chg > 20"))
def pct_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.movers(derive.daily_derived(views.bars_1d(spark, sf_dir)), 20.0)


@query(_chain(_DAILY, select=f"select * from (select {_DERIVED} from derived where trade_date = date '1996-03-05') where pct_chg > 0"))
def pct_scan_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.movers(derive.daily_derived(views.bars_1d(spark, sf_dir)), 0.0, "1996-03-05")


@query("select * from bars_1d where market = 'sz' and symbol = '000001' and trade_date >= date '1996-01-01' and trade_date <= date '1996-12-31' order by trade_date limit 1000")
def bars_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(views.bars_1d(spark, sf_dir), BarQuery(**ONE, since="1996-01-01", until="1996-12-31"), "trade_date")


@query("select * from (select * from bars_1d where market = 'sz' and symbol = '000001' order by trade_date desc limit 120) order by trade_date")
def bars_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bars(views.bars_1d(spark, sf_dir), BarQuery(**ONE, limit=120), "trade_date")


def _minute_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars with bar_time."""
    rows = views.ebars_1m(spark, sf_dir)
    return rows.withColumn("bar_time", F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute_of_day")))


@query("select market, symbol, cast(trade_date as varchar) as trade_date, minute_of_day, open, high, low, close, volume, amount from ebars_1m where market = 'sz' and symbol = '000001' and trade_date >= date '2024-01-03' and trade_date < date '2024-01-21' order by trade_date, minute_of_day limit 1000")
def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars.bars(_minute_times(spark, sf_dir), BarQuery(**ONE, period="1m", since="2024-01-03", until="2024-01-20"), "bar_time").drop("bar_time")
    return rows.withColumn("trade_date", F.col("trade_date").cast("string"))


@query("select * from points where market = 'sz' and symbol = '000001' and trade_date between date '2024-01-05' and date '2024-01-09'")
def points_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.points(spark, sf_dir)
    timed = rows.withColumn("point_time", F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute_of_day")))
    return bars.intraday_points(timed, PointQuery(**ONE, since="2024-01-05", until="2024-01-09", limit=10_000)).drop("point_time")


_FACTORS = (
    "hit as (select e.market, e.symbol, e.event_date, e.fenhong, e.peigujia, e.songzhuangu, e.peigu, max_by(b.close, b.trade_date) as prev_close from {x} e left join {b} b on b.market = e.market and b.symbol = e.symbol and b.trade_date < e.event_date and b.close > 0 where e.event_date <= (select max(trade_date) from {b} m where m.market = e.market and m.symbol = e.symbol) group by all)",
    "ratios as (select market, symbol, event_date, prev_close, ((prev_close * 10 - fenhong + peigu * peigujia) / (10 + peigu + songzhuangu)) / prev_close as ratio from hit)",
    "blocked as (select distinct market, symbol from ratios where ratio is null)",
    "factors as (select b.market, b.symbol, b.trade_date, case when k.symbol is null then exp(coalesce(sum(ln(r.ratio)) filter (r.event_date > b.trade_date), 0)) end as qfq_factor, case when k.symbol is null then exp(-coalesce(sum(ln(r.ratio)) filter (r.event_date <= b.trade_date), 0)) end as hfq_factor from {b} b left join ratios r on r.market = b.market and r.symbol = b.symbol left join blocked k on k.market = b.market and k.symbol = b.symbol group by b.market, b.symbol, b.trade_date, k.symbol)",
)
_DAY_FACTORS = [p.format(x="xdxr_events", b="bars_1d") for p in _FACTORS]
_MINUTE_FACTORS = [p.format(x="exdxr_events", b="ebars_1d") for p in _FACTORS]


@query(_chain(*_DAY_FACTORS[:2], select="select market, symbol, event_date, prev_close, round(ratio, 8) as ratio from ratios"))
def xdxr_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.action_ratios(views.bars_1d(spark, sf_dir), views.xdxr_events(spark, sf_dir)).filter("issue is null or issue <> 'future_xdxr_event'")
    return rows.select("market", "symbol", "event_date", "prev_close", F.round("ratio", 8).alias("ratio"))


_ROUNDED = "select market, symbol, trade_date, round(qfq_factor, 8) as qfq_factor, round(hfq_factor, 8) as hfq_factor from factors"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("market", "symbol", "trade_date", F.round("qfq_factor", 8).alias("qfq_factor"), F.round("hfq_factor", 8).alias("hfq_factor"))


@query(_chain(*_DAY_FACTORS, select=_ROUNDED))
def adjust_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeseries.adjustment_factors(views.bars_1d(spark, sf_dir), views.xdxr_events(spark, sf_dir)))


@query(_chain(*_MINUTE_FACTORS, select=_ROUNDED))
def adjust_factors_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeseries.adjustment_factors(views.ebars_1d(spark, sf_dir), views.exdxr_events(spark, sf_dir)))


_PRICES = ", ".join(f"round(b.{c} * f.{{f}}, 6) as {c}" for c in bars.PRICES)


def _adjusted_sql(kind: str) -> str:
    column = bars.FACTOR_COLUMN[kind]
    return _chain(*_DAY_FACTORS, select=f"select b.market, b.symbol, b.trade_date, {_PRICES.format(f=column)}, b.volume, b.amount, round(f.{column}, 8) as factor from (select * from bars_1d where market = 'sz' and symbol = '000001' order by trade_date desc limit 500) b left join factors f on f.market = b.market and f.symbol = b.symbol and f.trade_date = b.trade_date")


def _adjusted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = views.bars_1d(spark, sf_dir)
    own = (F.col("market") == ONE["market"]) & (F.col("symbol") == ONE["symbol"])
    factors = timeseries.adjustment_factors(rows.filter(own), views.xdxr_events(spark, sf_dir).filter(own))
    found = bars.checked_adjusted(rows, factors, BarQuery(**ONE, adjust=kind, limit=500), "trade_date")
    return found.withColumns({c: F.round(c, 6) for c in bars.PRICES} | {"factor": F.round("factor", 8)})


@query(_adjusted_sql("qfq"))
def bars_qfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir, "qfq")


@query(_adjusted_sql("hfq"))
def bars_hfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir, "hfq")


@query(_chain(*_MINUTE_FACTORS, select=f"select b.market, b.symbol, b.trade_date, b.minute_of_day, {_PRICES.format(f='qfq_factor')}, b.volume, b.amount, round(f.qfq_factor, 8) as factor from ebars_1m b left join factors f on f.market = b.market and f.symbol = b.symbol and f.trade_date = b.trade_date"))
def bars_1m_qfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All minute bars with their day's factor; null where a symbol's factors are blocked."""
    factors = timeseries.adjustment_factors(views.ebars_1d(spark, sf_dir), views.exdxr_events(spark, sf_dir))
    found = bars.adjusted(views.ebars_1m(spark, sf_dir), factors, "qfq")
    return found.withColumns({c: F.round(c, 6) for c in bars.PRICES} | {"factor": F.round("factor", 8)})


@query("select * from limit_events")
def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.limit_events(spark, sf_dir)


@query("select trade_date, count(*) as row_count from limit_events where trade_date between date '2024-01-05' and date '2024-01-20' group by trade_date")
def final_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.selected(views.limit_events(spark, sf_dir), LimitQuery(since="2024-01-05", until="2024-01-20"), "events").groupBy("trade_date").agg(F.count("*").alias("row_count"))


@query("select distinct market, symbol from bars_1d")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars_1d(spark, sf_dir).select("market", "symbol").distinct().orderBy("market", "symbol")


@query("select market, symbol from (select distinct market, symbol from bars_1d) order by market, symbol limit 20 offset 7")
def symbols_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.part(symbols(spark, sf_dir), ["market", "symbol"], 7, 20)


@query("select * from limit_events where trade_date between date '2024-01-01' and date '2024-01-31' and market = 'sz' and event_type = 'limit_up' and theme_primary = 'theme3' order by trade_date, event_type, market, symbol limit 201 offset 10")
def limit_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = LimitQuery(since="2024-01-01", until="2024-01-31", market="sz", event_type="limit_up", theme="theme3", limit=200, offset=10)
    return review.dataset(views.limit_events(spark, sf_dir), q, "events")


@query("select * from limit_events where contains(lower(reason_text), lower('ai+50%_')) and trade_date between date '2024-01-01' and date '2024-01-31'")
def keyword_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.selected(views.limit_events(spark, sf_dir), LimitQuery(since="2024-01-01", until="2024-01-31", reason_keyword="ai+50%_"), "events")


_COUNTS = """count(*) filter (event_type = 'limit_up') as limit_up_count, count(*) filter (event_type = 'limit_down') as limit_down_count, count(*) filter (event_type = 'open_limit') as open_limit_count,
 coalesce(max(board_count) filter (event_type = 'limit_up'), 0) as max_board_height, count(*) filter (event_type = 'limit_up' and board_count = 1) as first_board_count, count(*) filter (event_type = 'limit_up' and board_count >= 2) as continuous_board_count,
 count(*) filter (event_type = 'limit_up' and board_count = 2) as two_board_count, count(*) filter (event_type = 'limit_up' and board_count = 3) as three_board_count, count(*) filter (event_type = 'limit_up' and board_count = 4) as four_board_count, count(*) filter (event_type = 'limit_up' and board_count >= 5) as five_plus_board_count,
 count(*) filter (event_type = 'limit_up') / nullif(count(*) filter (event_type = 'limit_up' or (event_type = 'open_limit' and close_status <> 'broken_reseal')), 0) as seal_success_rate"""
_FRESH = f"fresh as (select trade_date, {_COUNTS} from limit_events group by trade_date)"


@query(_chain(_FRESH, select="select * from fresh"))
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary_counts(views.limit_events(spark, sf_dir))


@query(_chain(_FRESH, select="select s.trade_date, s.prev_trade_date, coalesce(f.limit_up_count, s.limit_up_count) as limit_up_count, f.limit_down_count, f.open_limit_count, f.max_board_height, f.first_board_count, f.continuous_board_count, f.two_board_count, f.three_board_count, f.four_board_count, f.five_plus_board_count, case when f.trade_date is null then s.seal_success_rate when s.seal_success_rate is not null then f.seal_success_rate end as seal_success_rate from limit_summary_stored s left join fresh f on f.trade_date = s.trade_date"))
def limit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summaries(views.limit_summary_stored(spark, sf_dir), views.limit_events(spark, sf_dir))


_RELAY = (
    "best as (select trade_date, market, symbol, max_by(event_type, p) as event_type, max_by(board_count, p) as board_count from (select *, case event_type when 'limit_down' then 3 when 'limit_up' then 2 else 1 end as p from limit_events) group by trade_date, market, symbol)",
    "days as (select coalesce(a.trade_date, b.trade_date) as trade_date, coalesce(a.p, b.p) as prev_trade_date from (select trade_date, prev_trade_date as p from limit_summary_stored where prev_trade_date is not null) a full join (select trade_date, min(prev_trade_date) as p from limit_relay_stored group by trade_date) b on a.trade_date = b.trade_date)",
    "samples as (select d.trade_date, d.prev_trade_date, e.market, e.symbol, g.sample_group, e.event_type as prev_event_type, e.board_count as prev_board_count, e.reason_text as prev_reason_text, e.theme_primary as prev_theme_primary from limit_events e join days d on d.prev_trade_date = e.trade_date, (values ('prev_limit_up'), ('prev_ladder'), ('prev_broken'), ('prev_limit_down')) g(sample_group) where (g.sample_group = 'prev_limit_up' and e.event_type = 'limit_up') or (g.sample_group = 'prev_ladder' and e.event_type = 'limit_up' and e.board_count >= 2) or (g.sample_group = 'prev_broken' and e.event_type = 'open_limit' and e.close_status <> 'broken_reseal') or (g.sample_group = 'prev_limit_down' and e.event_type = 'limit_down'))",
    _RETURNS.format(bars="ebars_1d"),
    f"returns as (select {_DERIVED} from derived)",
    "relay as (select s.trade_date, s.prev_trade_date, s.market, s.symbol, s.sample_group, s.prev_board_count, s.prev_reason_text, s.prev_theme_primary, case when t.event_type = 'limit_up' and s.prev_event_type = 'limit_up' and t.board_count > s.prev_board_count then 'promoted' when t.event_type = 'limit_up' then 'sealed' else coalesce(t.event_type, o.today_status, 'unknown') end as today_status, coalesce(t.board_count, 0) as today_board_count, coalesce(r.pct_chg, o.today_pct_chg) as today_pct_chg from samples s left join best t on t.trade_date = s.trade_date and t.market = s.market and t.symbol = s.symbol left join limit_relay_stored o on o.trade_date = s.trade_date and o.prev_trade_date = s.prev_trade_date and o.market = s.market and o.symbol = s.symbol and o.sample_group = s.sample_group left join returns r on r.trade_date = s.trade_date and r.market = s.market and r.symbol = s.symbol union all select trade_date, prev_trade_date, market, symbol, sample_group, prev_board_count, '', '', today_status, 0, today_pct_chg from limit_relay_stored where trade_date not in (select trade_date from days where prev_trade_date in (select trade_date from limit_events)))",
)


def _relayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = derive.daily_derived(views.ebars_1d(spark, sf_dir))
    return review.relay(views.limit_events(spark, sf_dir), views.limit_summary_stored(spark, sf_dir), views.limit_relay_stored(spark, sf_dir), returns)


@query(_chain(*_RELAY, select="select * from relay"))
def limit_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relayed(spark, sf_dir)


@query(_chain(*_RELAY, select="select * from relay where trade_date between date '2024-01-10' and date '2024-01-20' and prev_theme_primary = 'theme2' and sample_group = 'prev_ladder' order by trade_date, sample_group, market, symbol limit 101"))
def limit_relay_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = LimitQuery(since="2024-01-10", until="2024-01-20", theme="theme2", sample_group="prev_ladder", limit=100)
    return review.dataset(_relayed(spark, sf_dir), q, "relay")


_THEMES = (
    "led as (select trade_date, theme_primary, market, symbol, board_count, row_number() over (partition by trade_date, theme_primary order by board_count desc, symbol, market) as n from limit_events where event_type = 'limit_up' and theme_primary <> '')",
    "counted as (select trade_date, theme_primary as theme_name, count(*) filter (event_type = 'limit_up') as limit_up_count, count(*) filter (event_type = 'limit_up' and board_count >= 2) as ladder_count, count(*) filter (event_type = 'open_limit') as broken_count, count(*) filter (event_type = 'limit_down') as limit_down_count from limit_events where theme_primary <> '' group by all)",
    "themes as (select c.*, coalesce(l.market, '') as leader_market, coalesce(l.symbol, '') as leader_symbol, coalesce(l.board_count, 0) as leader_board_count, row_number() over (partition by c.trade_date order by limit_up_count desc, ladder_count desc, theme_name) as strength_rank from counted c left join led l on l.n = 1 and l.trade_date = c.trade_date and l.theme_primary = c.theme_name union all select trade_date, theme_name, limit_up_count, 0, 0, 0, '', '', 0, strength_rank from themes_stored where trade_date not in (select trade_date from limit_events))",
)


def _themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.themes(views.limit_events(spark, sf_dir), views.themes_stored(spark, sf_dir))


@query(_chain(*_THEMES, select="select * from themes"))
def limit_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _themed(spark, sf_dir)


@query(_chain(*_THEMES, select="select * from themes where theme_name = 'theme3' and trade_date between date '2024-01-01' and date '2024-02-29'"))
def limit_theme_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One theme's rows; its rank is among all themes of the day."""
    return review.selected(_themed(spark, sf_dir), LimitQuery(since="2024-01-01", until="2024-02-29", theme="theme3"), "themes")


@query("select * from index_bars where index_code = 'prev_ladder_perf' and trade_date between date '2024-01-01' and date '2024-01-31'")
def limit_performance_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.selected(views.index_bars(spark, sf_dir), LimitQuery(since="2024-01-01", until="2024-01-31", index_code="prev_ladder_perf"), "indices")


@query("select * from breadth where trade_date between date '2024-01-01' and date '2024-01-31'")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.selected(views.breadth(spark, sf_dir), JANUARY, "breadth")


@query("select trade_date, board_count as height, count(*) as stock_count, string_agg(market || ':' || symbol, ',' order by market || ':' || symbol) as stocks from limit_events where event_type = 'limit_up' group by trade_date, board_count")
def limit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ladder(views.limit_events(spark, sf_dir)).withColumn("stocks", F.array_join("stocks", ","))


@query("select trade_date, least(board_count, 5) as boards, count(*) as stocks from limit_events where event_type = 'limit_up' group by all")
def board_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.board_histogram(views.limit_events(spark, sf_dir))


MATRIX = LimitQuery(since="2024-01-10", until="2024-01-14", theme="theme3", limit=50, offset=5)
_MATRIX = (
    *_RELAY,
    "ev as (select * from limit_events where trade_date between date '2024-01-10' and date '2024-01-14')",
    "re as (select * from relay where trade_date between date '2024-01-10' and date '2024-01-14')",
    "chosen as (select market, symbol from (select market, symbol from ev where theme_primary = 'theme3' union select market, symbol from re where prev_theme_primary = 'theme3') order by market, symbol limit 50 offset 5)",
    "cells as (select market, symbol, trade_date, coalesce(string_agg(e, '|' order by e), '') as events, coalesce(string_agg(s, '|' order by s), '') as relay from (select market, symbol, trade_date, event_type || ':' || board_count || ':' || close_status as e, null as s from ev union all select market, symbol, trade_date, null, sample_group || ':' || today_status from re) x join chosen using (market, symbol) group by market, symbol, trade_date)",
)


def _cell_texts(c: str, fields: list[str]) -> F.Column:
    return F.array_join(F.sort_array(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))), "|")


@query(_chain(*_MATRIX, select="select * from cells"))
def review_matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = review.matrix_cells(views.limit_events(spark, sf_dir), _relayed(spark, sf_dir), MATRIX)
    return cells.select("market", "symbol", "trade_date", _cell_texts("events", ["event_type", "board_count", "close_status"]).alias("events"), _cell_texts("relay", ["sample_group", "today_status"]).alias("relay"))


@query(_chain(*_MATRIX[:-2], select="select count(*) as total_rows from (select market, symbol from ev where theme_primary = 'theme3' union select market, symbol from re where prev_theme_primary = 'theme3')"))
def review_matrix_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.matrix_total(views.limit_events(spark, sf_dir), _relayed(spark, sf_dir), MATRIX)


@query(_chain(*_MATRIX, select="select market, symbol, count(*) as cell_count, min(trade_date) as first_date, max(trade_date) as last_date from cells group by market, symbol"))
def review_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.matrix_rows(views.limit_events(spark, sf_dir), _relayed(spark, sf_dir), MATRIX)
    dates_of = F.transform("cells", lambda c: c["trade_date"])
    return rows.select("market", "symbol", F.size("cells").cast("long").alias("cell_count"), F.array_min(dates_of).alias("first_date"), F.array_max(dates_of).alias("last_date"))


_DAYS_KINDS = {"events": "limit_events", "relay": "relay", "summary": "limit_summary_stored", "breadth": "breadth", "indices": "index_bars", "themes": "themes"}
_DAYS = "every as (" + " union all ".join(f"select trade_date, '{k}' as kind from {t} where trade_date between date '2024-01-01' and date '2024-02-29'" for k, t in _DAYS_KINDS.items()) + ")"


@query(_chain(*_RELAY, *_THEMES, _DAYS, select="select trade_date, " + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in _DAYS_KINDS) + ", concat_ws(',', case when count(*) filter (kind = 'breadth') = 0 then 'market_breadth_missing' end, case when count(*) filter (kind = 'indices') = 0 then 'performance_indices_missing' end, case when count(*) filter (kind = 'summary') = 0 then 'summary_missing' end) as warnings from every group by trade_date"))
def review_matrix_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = LimitQuery(since="2024-01-01", until="2024-02-29")
    return review.review_days(views.limit_events(spark, sf_dir), _relayed(spark, sf_dir), views.limit_summary_stored(spark, sf_dir), views.breadth(spark, sf_dir), views.index_bars(spark, sf_dir), _themed(spark, sf_dir), q)


@query("select trade_date, minute_of_day, market, symbol, close, volume, amount, prev_close, case when prev_close > 0 then (close - prev_close) / prev_close * 100 end as minute_ret, null::double as volume_ratio from (select *, lag(close) over (partition by market, symbol order by trade_date, minute_of_day) as prev_close from ebars_1m where trade_date between date '2024-01-08' and date '2024-01-19')")
def minute_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.minute_scan(views.ebars_1m(spark, sf_dir), "minute_of_day", "2024-01-08", "2024-01-19")


@query("select * from securities where market = 'bj' and symbol = '000007'")
def security_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return securities.lookup(views.securities(spark, sf_dir), "bj", "000007")


def _resolve_sql(text_: str, limit: int) -> str:
    norm = "".join(text_.split()).lower()
    order = f"({{c}} = '{norm}') desc, {{o}} limit {limit}"
    parts = [
        f"(select market, symbol, current_name, 'current_name' as matched_by, current_name as matched, 90 as score from securities where contains(current_name_norm, '{norm}') order by {order.format(c='current_name_norm', o='current_name, market, symbol')})",
        f"(select market, symbol, current_name, 'history_name', name, 80 from security_name_history join securities using (market, symbol) where contains(name_norm, '{norm}') order by {order.format(c='name_norm', o='valid_from desc, name, market, symbol')})",
        f"(select market, symbol, current_name, 'alias', alias, 70 from security_aliases join securities using (market, symbol) where contains(alias_norm, '{norm}') order by {order.format(c='alias_norm', o='priority desc, alias, market, symbol')})",
        f"(select market, symbol, current_name, 'symbol', '{text_}', 100 from securities where symbol = '{text_}' order by market limit {limit})",
    ]
    return f"select market, symbol, current_name, matched_by, matched, score from (select *, row_number() over (partition by market, symbol order by score desc, matched) as n from ({' union all '.join(parts)})) where n = 1 order by score desc, market, symbol limit {limit}"


@query(_resolve_sql("Customer 0", 20).replace("customer0", "customer#0000"))
def security_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return securities.resolve(views.securities(spark, sf_dir), views.security_name_history(spark, sf_dir), views.security_aliases(spark, sf_dir), "Customer #0000", 20)


@query(_resolve_sql("000012", 20))
def security_resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return securities.resolve(views.securities(spark, sf_dir), views.security_name_history(spark, sf_dir), views.security_aliases(spark, sf_dir), "000012", 20)


@query("select distinct symbol, case when symbol like '920%' or left(symbol, 1) in ('8', '4') then 'bj' when left(symbol, 1) in ('6', '9') then 'sh' else 'sz' end as market from (select lpad(cast(l_orderkey * 7919 % 1000000 as varchar), 6, '0') as symbol from lineitem)")
def resolve_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(F.lpad((F.col("l_orderkey") * 7919 % 1_000_000).cast("string"), 6, "0").alias("symbol"))
    return rows.select("symbol", text.infer_market(F.col("symbol")).alias("market")).distinct()


@query("select dataset, severity, issue_type, count(*) as issue_count from quality_issues group by all order by issue_count desc, dataset, severity, issue_type limit 5")
def issue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.issue_stats(views.quality_issues(spark, sf_dir), 5)


@query("select dataset, strftime(observed_at, '%Y-%m-%d %H:%M:%S') as observed_at, event_id, issue_type from quality_issues order by observed_at desc, event_id desc limit 20")
def latest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.quality_issues(spark, sf_dir).orderBy(F.desc("observed_at"), F.desc("event_id")).limit(20)
    return rows.select("dataset", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "event_id", "issue_type")


_RAW_KEYED = "keyed as (select trade_date, event_type, market, symbol, commit_seq, row_number() over w as n, struct_pack(a := close_status, b := board_count, c := reason_text, d := theme_primary) as v, first_value(struct_pack(a := close_status, b := board_count, c := reason_text, d := theme_primary)) over w as f from limit_events_raw window w as (partition by trade_date, event_type, market, symbol order by commit_seq))"


@query(_chain(_RAW_KEYED, select="select trade_date, event_type, market, symbol, commit_seq, case when v = f then 'duplicate_logical_key' else 'conflicting_logical_key' end as issue_type from keyed where n > 1"))
def dedup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.first_with_issues(views.limit_events_raw(spark, sf_dir), review.EVENT_KEY, "commit_seq")[1]


@query(_chain(_RAW_KEYED, select="select trade_date, event_type, market, symbol, commit_seq, v.a as close_status, v.b as board_count from keyed where n = 1"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest.first_with_issues(views.limit_events_raw(spark, sf_dir), review.EVENT_KEY, "commit_seq")[0]
    return rows.select(*review.EVENT_KEY, "commit_seq", "close_status", "board_count")


@query("select market, symbol, min(trade_date) as min_time, max(trade_date) as max_time, count(*) as row_count from bars_1d group by market, symbol")
def watermark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bounds(views.bars_1d(spark, sf_dir), "trade_date", ["market", "symbol"])


@query("select dataset, count(*) filter (severity = 'error') as errors, count(*) as issues, case when count(*) filter (severity = 'error') > 100 then 'failed' else 'degraded' end as status from quality_issues group by dataset")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = views.quality_issues(spark, sf_dir).groupBy("dataset").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("issues"))
    state = ops.run_status(F.struct((F.col("errors") - 100).alias("errors"), "issues"), failing=True)
    return counted.withColumn("status", state)


@query("select market, batch_no, string_agg(symbol, ',' order by symbol) as symbols from (select market, symbol, cast((row_number() over (partition by market order by symbol) - 1) // 80 as bigint) + 1 as batch_no from (select distinct market, symbol from securities)) group by market, batch_no")
def sweep_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sweep_batches(views.securities(spark, sf_dir), 80).withColumn("symbols", F.array_join("symbols", ","))


@query("select market, batch_no from (select distinct market, cast((row_number() over (partition by market order by symbol) - 1) // 80 as bigint) + 1 as batch_no from (select distinct market, symbol from securities)) where batch_no % 2 = 0")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = ops.sweep_batches(views.securities(spark, sf_dir), 80).select("market", "batch_no")
    states = batches.select("market", "batch_no", F.when(F.col("batch_no") % 2 == 1, "succeeded").otherwise("failed").alias("status"))
    return ops.resume_pending(batches, states)


@query("select market, symbol, 'added' as change from (select distinct market, symbol from securities where cast(symbol as int) % 2 = 0 except select distinct market, symbol from securities where cast(symbol as int) % 3 = 0) union all select market, symbol, 'removed' from (select distinct market, symbol from securities where cast(symbol as int) % 3 = 0 except select distinct market, symbol from securities where cast(symbol as int) % 2 = 0)")
def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.securities(spark, sf_dir).select("market", "symbol").distinct()
    n = F.col("symbol").cast("int")
    return ops.block_diff(rows.filter(n % 3 == 0), rows.filter(n % 2 == 0), ["market", "symbol"])


@query("select board, sha256(string_agg(sha256(market || ':' || symbol), chr(10) order by sha256(market || ':' || symbol))) as content_id from securities group by board")
def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.content_address(views.securities(spark, sf_dir), ["board"], F.concat_ws(":", "market", "symbol"))


_STREAKS = (
    "cal as (select trade_date, row_number() over (order by trade_date) as d from (select distinct trade_date from limit_events))",
    "held as (select distinct market, symbol, d, trade_date from limit_events join cal using (trade_date) where event_type = 'limit_up')",
    "isles as (select *, d - row_number() over (partition by market, symbol order by d) as g from held)",
)


@query(_chain(*_STREAKS, select="select market, symbol, trade_date, row_number() over (partition by market, symbol, g order by d) as streak from isles"))
def limit_up_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.limit_events(spark, sf_dir)
    return timeseries.streaks(events.filter("event_type = 'limit_up'"), events, ["market", "symbol"], "trade_date")


@query("select e.market, e.symbol, e.event_date, max_by(b.close, b.trade_date) as prev_close from exdxr_events e left join ebars_1d b on b.market = e.market and b.symbol = e.symbol and b.trade_date < e.event_date and b.close > 0 group by e.market, e.symbol, e.event_date")
def previous_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars_ = views.ebars_1d(spark, sf_dir).filter("close > 0")
    events = views.exdxr_events(spark, sf_dir).select("market", "symbol", "event_date")
    return timeseries.asof_before(events, bars_, ["market", "symbol"], "event_date", "trade_date", "close", "prev_close")


_LOCKED = "old as (select market, symbol, current_name, board, cast(symbol as int) % 5 = 0 as manual_locked from securities where cast(symbol as int) % 4 <> 0), new as (select market, symbol, current_name || ' new' as current_name, lower(board) as board, false as manual_locked from securities where cast(symbol as int) % 4 <> 1)"


@query(_chain(_LOCKED, select="select coalesce(o.market, n.market) as market, coalesce(o.symbol, n.symbol) as symbol, case when n.symbol is null or (o.symbol is not null and o.manual_locked) then o.current_name else n.current_name end as current_name, case when n.symbol is null or (o.symbol is not null and o.manual_locked) then o.board else n.board end as board, case when o.symbol is not null then o.manual_locked else n.manual_locked end as manual_locked from old o full join new n on o.market = n.market and o.symbol = n.symbol"))
def security_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = views.securities(spark, sf_dir), F.col("symbol").cast("int")
    stored = rows.filter(n % 4 != 0).select("market", "symbol", "current_name", "board", (n % 5 == 0).alias("manual_locked"))
    incoming = rows.filter(n % 4 != 1).select("market", "symbol", F.concat("current_name", F.lit(" new")).alias("current_name"), F.lower("board").alias("board"), F.lit(False).alias("manual_locked"))
    return latest.merge_locked(stored, incoming, ["market", "symbol"], "manual_locked")


@query("select trade_date, strftime(trade_date, '%Y%m') as month, year(trade_date) as year, count(*) as row_count from bars_1d group by all")
def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("trade_date")
    return views.bars_1d(spark, sf_dir).groupBy("trade_date", dates.partition_month(day).alias("month"), dates.partition_year(day).alias("year")).agg(F.count("*").alias("row_count"))


@query(_chain(*_RELAY, _FRESH, "ups as (select trade_date, count(*) filter (event_type = 'limit_up') as up, count(*) filter (event_type = 'limit_down') as down, count(*) filter (event_type = 'open_limit') as broken, count(distinct board_count) filter (event_type = 'limit_up') as heights from limit_events group by trade_date)", "summ as (select s.trade_date, coalesce(f.limit_up_count, s.limit_up_count) as u, f.limit_down_count as d, f.open_limit_count as o from limit_summary_stored s left join fresh f on f.trade_date = s.trade_date)", "br as (select trade_date from breadth)", "ix as (select trade_date, count(*) as n from index_bars group by trade_date)", "rl as (select trade_date, count(*) as n from relay group by trade_date)", "alld as (select trade_date from ups union select trade_date from summ union select trade_date from br union select trade_date from ix union select trade_date from rl)", select="select a.trade_date, coalesce(ups.up, 0) as limit_up_pool, coalesce(ups.broken, 0) as broken, coalesce(ups.down, 0) as limit_down, coalesce(ups.heights, 0) as ladder_heights, coalesce(rl.n, 0) as relay, concat_ws(',', case when ups.up is null then 'events_missing' end, case when br.trade_date is null then 'market_breadth_missing' end, case when ix.n is null then 'performance_indices_missing' end, case when rl.n is null then 'relay_missing' end, case when summ.u <> ups.up or summ.d <> ups.down or summ.o <> ups.broken then 'summary_event_count_mismatch' end, case when summ.trade_date is null then 'summary_missing' end) as warnings from alld a left join ups using (trade_date) left join summ using (trade_date) left join br using (trade_date) left join ix using (trade_date) left join rl using (trade_date)"))
def limit_review_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.limit_events(spark, sf_dir)
    fresh = review.summaries(views.limit_summary_stored(spark, sf_dir), events)
    return review.day_reviews(events, _relayed(spark, sf_dir), fresh, views.breadth(spark, sf_dir), views.index_bars(spark, sf_dir))


@query("select count(*) filter (trade_date between date '1996-01-01' and date '1997-06-30') as rows_read, count(*) filter (trade_date not between date '1996-01-01' and date '1997-06-30') as rows_skipped from bars_1d")
def import_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.in_range(views.bars_1d(spark, sf_dir), "trade_date", "1996-01-01", "1997-06-30")[1]


@query("select board as scope, market, symbol, snapshot_id from (select board, market, symbol, cast(symbol as int) % 7 as snapshot_id from securities) where snapshot_id = 6")
def latest_block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("symbol").cast("int")
    members = views.securities(spark, sf_dir).select(F.col("board").alias("scope"), "market", "symbol", (n % 7).alias("snapshot_id"))
    snapshots = members.select("scope", "snapshot_id", F.col("snapshot_id").alias("snapshot_time")).distinct()
    return ops.latest_members(snapshots, members)
