"""The rules of bars, factors, review, securities and operations on small vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.functions import dates, text
from quotemill.operators import latest, ordering, timeseries
from quotemill.plans import bars, derive, ops, params, review, securities
from quotemill.sources import tables

D = dt.date
KEY = ("sz", "000001")


def day_bars(spark, closes, start=1):
    rows = [(*KEY, D(2024, 6, start + k), float(c), float(c), float(c), float(c), 1, 1.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "market string, symbol string, trade_date date, open double, high double, low double, close double, volume long, amount double")


def actions(spark, rows):
    full = [(*KEY, day, category, cash, price, bonus, allot) for day, category, cash, price, bonus, allot in rows]
    return spark.createDataFrame(full, "market string, symbol string, event_date date, category int, fenhong double, peigujia double, songzhuangu double, peigu double")


def test_previous_valid_close(spark):
    rows = derive.daily_derived(day_bars(spark, [10, 0, 12])).orderBy("trade_date").collect()
    assert [r.prev_close for r in rows] == [None, 10, 10] and [r.pct_chg for r in rows] == [None, -100, 20]
    middle = derive.daily_derived(day_bars(spark, [10, 11, 12]), "2024-06-02", "2024-06-02").collect()
    assert [(r.prev_close, round(r.pct_chg, 6)) for r in middle] == [(10, 10)]


@pytest.mark.parametrize(
    ("closes", "events", "qfq", "hfq"),
    [
        ([10, 5, 6], [(D(2024, 6, 2), 1, 0.0, 0.0, 10.0, 0.0)], [0.5, 1, 1], [1, 2, 2]),
        ([10, 5, 2.5], [(D(2024, 6, 2), 1, 0.0, 0.0, 10.0, 0.0), (D(2024, 6, 3), 1, 0.0, 0.0, 10.0, 0.0)], [0.25, 0.5, 1], [1, 2, 4]),
        ([10, 5], [(D(2024, 6, 9), 1, 0.0, 0.0, 10.0, 0.0)], [1, 1], [1, 1]),
        ([10, 5], [(D(2024, 6, 1), 1, 0.0, 0.0, 10.0, 0.0)], [None, None], [None, None]),
        ([10, 5], [(D(2024, 6, 2), 99, 0.0, 0.0, 10.0, 0.0)], [1, 1], [1, 1]),
        ([10, 5], [(D(2024, 6, 2), 1, None, 0.0, 10.0, 0.0)], [None, None], [None, None]),
        ([10, 5], [(D(2024, 6, 2), 1, 0.0, 0.0, -10.0, 0.0)], [None, None], [None, None]),
        ([10, 5], [(D(2024, 6, 2), 1, 200.0, 0.0, 0.0, 0.0)], [None, None], [None, None]),
    ],
)
def test_factors(spark, closes, events, qfq, hfq):
    rows = timeseries.adjustment_factors(day_bars(spark, closes), actions(spark, events)).orderBy("trade_date").collect()
    assert [r.qfq_factor for r in rows] == (qfq if None in qfq else pytest.approx(qfq)) and [r.hfq_factor for r in rows] == (hfq if None in hfq else pytest.approx(hfq))


def test_action_issues(spark):
    events = [(D(2024, 6, 9), 99, 0.0, 0.0, 0.0, 0.0), (D(2024, 6, 2), 5, 0.0, 0.0, 0.0, 0.0), (D(2024, 6, 1), 1, 0.0, 0.0, 0.0, 0.0)]
    rows = timeseries.action_ratios(day_bars(spark, [10, 5]), actions(spark, events)).orderBy("event_date").collect()
    assert [r.issue for r in rows] == ["missing_previous_close", "unsupported_xdxr_category", "future_xdxr_event"]


def test_adjusted_bars_refuse_gaps(spark):
    rows = day_bars(spark, [10, 5])
    factors = timeseries.adjustment_factors(rows.limit(1), actions(spark, []))
    with pytest.raises(bars.MissingFactorError):
        bars.checked_adjusted(rows, factors, params.BarQuery(*KEY, adjust="qfq"), "trade_date")
    full = timeseries.adjustment_factors(rows, actions(spark, [(D(2024, 6, 2), 1, 0.0, 0.0, 10.0, 0.0)]))
    assert [r.close for r in bars.checked_adjusted(rows, full, params.BarQuery(*KEY, adjust="qfq"), "trade_date").collect()] == pytest.approx([5, 5])


def test_bars_bounds(spark):
    rows = day_bars(spark, range(1, 10))
    close = lambda **k: [r.close for r in bars.bars(rows, params.BarQuery(*KEY, **k), "trade_date").collect()]
    assert close(limit=2) == [8, 9] and close(since="2024-06-03", limit=2) == [3, 4] and close(until="2024-06-02") == [1, 2]
    assert params.until_bound("2024-06-02") == (dt.datetime(2024, 6, 3), "<") and params.until_bound("2024-06-02 09:31:00")[1] == "<="


@pytest.mark.parametrize(
    "query",
    [
        params.BarQuery("xx", "000001"),
        params.BarQuery("sh", "1"),
        params.BarQuery("sh", "000001", period="1w"),
        params.BarQuery("sh", "000001", adjust="x"),
        params.BarQuery("sh", "000001", limit=10_001),
        params.PointQuery("sh", "000001"),
        params.PointQuery("sh", "000001", date="2024-01-01", since="2024-01-01"),
        params.PointQuery("sh", "000001", since="2024-01-03", until="2024-01-01"),
    ],
)
def test_wrong_bar_queries(query):
    with pytest.raises(params.InvalidQueryError):
        query.checked()


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("events", {}),
        ("events", {"trade_date": "2024-1"}),
        ("events", {"trade_date": "2024-01-01", "since": "2024-01-01"}),
        ("events", {"since": "2024-01-02", "until": "2024-01-01"}),
        ("themes", {"since": "2024-01-01", "until": "2024-04-04"}),
        ("events", {"trade_date": "2024-01-01", "prev_trade_date": "2023-12-29"}),
        ("relay", {"trade_date": "2024-01-01", "prev_trade_date": "2024-01-01"}),
        ("events", {"trade_date": "2024-01-01", "limit": 20_001}),
        ("matrix", {"trade_date": "2024-01-01", "limit": 501}),
        ("events", {"trade_date": "2024-01-01", "offset": -1}),
        ("events", {"trade_date": "2024-01-01", "symbol": "000001"}),
        ("events", {"trade_date": "2024-01-01", "sample_group": "prev_ladder"}),
        ("summary", {"trade_date": "2024-01-01", "theme": "x"}),
        ("relay", {"trade_date": "2024-01-01", "reason_keyword": "x"}),
        ("indices", {"trade_date": "2024-01-01", "index_code": "x"}),
    ],
)
def test_wrong_limit_queries(kind, values):
    with pytest.raises(params.InvalidQueryError):
        params.LimitQuery(**values).checked(kind)


EVENTS = "trade_date date, event_type string, market string, symbol string, close_status string, board_count int, reason_text string, theme_primary string"


def event(day, kind, symbol, boards=1, status=None, theme="t", reason=""):
    return (D(2024, 1, day), kind, "sz", symbol, status or {"limit_up": "sealed", "open_limit": "broken", "limit_down": "limit_down"}[kind], boards, reason, theme)


def relayed(spark, events, stored=(), returns=(), prev=1):
    summary = spark.createDataFrame([(D(2024, 1, 2), D(2024, 1, prev) if prev else None)], "trade_date date, prev_trade_date date")
    old = spark.createDataFrame(list(stored), "trade_date date, prev_trade_date date, market string, symbol string, sample_group string, prev_board_count int, today_status string, today_pct_chg double")
    now = spark.createDataFrame(list(returns), "trade_date date, market string, symbol string, pct_chg double")
    rows = review.relay(spark.createDataFrame(events, EVENTS), summary, old, now).collect()
    return {(r.symbol, r.sample_group): r for r in rows}


def test_relay_status(spark):
    first = [event(1, "limit_up", "000001", 2), event(1, "limit_up", "000002"), event(1, "open_limit", "000003"), event(1, "open_limit", "000004", status="broken_reseal"), event(1, "limit_down", "000005"), event(1, "limit_up", "000006")]
    then = [event(2, "limit_up", "000001", 3), event(2, "limit_up", "000002", 1), event(2, "open_limit", "000005"), event(2, "limit_down", "000005")]
    day = (D(2024, 1, 2), D(2024, 1, 1), "sz")
    stored = [(*day, "000006", "prev_limit_up", 1, "broken", 1.5), (D(2024, 1, 2), D(2024, 1, 1), "sz", "000003", "prev_limit_up", 1, "broken", 2.5)]
    out = relayed(spark, first + then, stored, [(D(2024, 1, 2), "sz", "000003", 7.0), (D(2024, 1, 2), "sz", "000006", None)])
    assert {k: r.today_status for k, r in out.items()} == {
        ("000001", "prev_limit_up"): "promoted",
        ("000001", "prev_ladder"): "promoted",
        ("000002", "prev_limit_up"): "sealed",
        ("000003", "prev_broken"): "unknown",
        ("000005", "prev_limit_down"): "limit_down",
        ("000006", "prev_limit_up"): "broken",
    }
    assert out["000003", "prev_broken"].today_pct_chg == 7.0 and out["000006", "prev_limit_up"].today_pct_chg == 1.5


def test_relay_keeps_stored_rows_of_days_without_events(spark):
    stored = [(D(2024, 1, 2), D(2024, 1, 1), "sz", "000009", "prev_limit_up", 1, "sealed", 3.0)]
    assert set(relayed(spark, [event(2, "limit_up", "000001")], stored)) == {("000009", "prev_limit_up")}


def test_relay_refuses_conflicting_previous_days(spark):
    stored = [(D(2024, 1, 2), D(2024, 1, k), "sz", "000009", "prev_limit_up", 1, "sealed", 3.0) for k in (1, 2)]
    with pytest.raises(Exception, match="conflicting"):
        relayed(spark, [event(1, "limit_up", "000001")], stored)


def test_themes(spark):
    rows = [event(1, "limit_up", "000002", 3), event(1, "limit_up", "000001", 3), event(1, "open_limit", "000003"), event(1, "limit_up", "000004", theme="u"), event(2, "limit_down", "000005", theme="u"), event(1, "limit_up", "000009", theme="")]
    stored = spark.createDataFrame([(D(2024, 1, 1), "old", 9, 1), (D(2024, 1, 5), "old", 9, 1)], "trade_date date, theme_name string, limit_up_count long, strength_rank int")
    out = {(r.trade_date.day, r.theme_name): r for r in review.themes(spark.createDataFrame(rows, EVENTS), stored).collect()}
    assert set(out) == {(1, "t"), (1, "u"), (2, "u"), (5, "old")}
    t = out[1, "t"]
    assert (t.limit_up_count, t.ladder_count, t.broken_count, t.leader_symbol, t.leader_board_count, t.strength_rank) == (2, 2, 1, "000001", 3, 1)
    assert out[1, "u"].strength_rank == 2 and out[2, "u"].strength_rank == 1 and out[2, "u"].leader_symbol == ""


def test_summary_rate_stays_null(spark):
    rows = spark.createDataFrame([event(1, "limit_up", "000001"), event(1, "open_limit", "000002"), event(2, "open_limit", "000002", status="broken_reseal")], EVENTS)
    stored = spark.createDataFrame([(D(2024, 1, 1), None, 7, None), (D(2024, 1, 2), None, 7, 0.1), (D(2024, 1, 3), None, 7, 0.2)], "trade_date date, prev_trade_date date, limit_up_count long, seal_success_rate double")
    out = {r.trade_date.day: r for r in review.summaries(stored, rows).collect()}
    assert [(out[k].limit_up_count, out[k].seal_success_rate) for k in (1, 2, 3)] == [(1, None), (0, None), (7, 0.2)]
    assert review.summary_counts(rows).filter("trade_date = '2024-01-01'").first().seal_success_rate == 0.5


@pytest.mark.parametrize(("keyword", "found"), [("ai+50%_", True), ("50%", True), ("5_0", False), ("%", True), ("", True), ("ÉCOLE", True), ("x\\", False), ("'", False), ("AI 50", False), ("école ai", True)])
def test_keywords(spark, keyword, found):
    rows = spark.createDataFrame([("école AI+50%_x",)], "reason_text string")
    assert bool(rows.filter(review.contains_keyword("reason_text", keyword)).count()) is found


def test_matrix_filters_choose_stocks(spark):
    rows = spark.createDataFrame([event(1, "limit_up", "000001", theme="t"), event(2, "limit_down", "000001", theme="u"), event(1, "limit_up", "000002", theme="u")], EVENTS)
    relay = spark.createDataFrame([], "trade_date date, prev_trade_date date, market string, symbol string, sample_group string, prev_theme_primary string, today_status string")
    out = review.matrix_rows(rows, relay, params.LimitQuery(since="2024-01-01", until="2024-01-05", theme="t")).collect()
    assert [(r.symbol, [c.trade_date.day for c in r.cells]) for r in out] == [("000001", [1, 2])]


def test_resolve_scores(spark):
    names = spark.createDataFrame([("sz", "000001", "Ping An", "pingan"), ("sh", "600000", "Pu Fa", "pufa"), ("sh", "000001", "Index", "index")], "market string, symbol string, current_name string, current_name_norm string")
    history = spark.createDataFrame([("sh", "600000", "Old Ping", "oldping", D(2000, 1, 1))], "market string, symbol string, name string, name_norm string, valid_from date")
    alias = spark.createDataFrame([("sz", "000001", "ping bank", "pingbank", 50)], "market string, symbol string, alias string, alias_norm string, priority int")
    out = lambda q: [(r.market, r.symbol, r.score) for r in securities.resolve(names, history, alias, q).collect()]
    assert out(" PING ") == [("sz", "000001", 90), ("sh", "600000", 80)] and out("000001") == [("sh", "000001", 100), ("sz", "000001", 100)] and out("bank") == [("sz", "000001", 70)] and out("%") == []
    with pytest.raises(ValueError):
        out(" ")


def test_first_with_issues(spark):
    rows = spark.createDataFrame([("a", 1, 5, None), ("a", 2, 5, None), ("a", 3, 6, 1), ("b", 1, 1, 1)], "k string, at long, v int, w int")
    first, issues = latest.first_with_issues(rows, ["k"], "at")
    assert sorted((r.k, r.at) for r in first.collect()) == [("a", 1), ("b", 1)]
    assert sorted((r.at, r.issue_type) for r in issues.collect()) == [(2, "duplicate_logical_key"), (3, "conflicting_logical_key")]
    assert {r.issue_type for r in latest.first_with_issues(rows, ["k"], "at", compare=False)[1].collect()} == {"duplicate_logical_key"}
    with pytest.raises(Exception, match="conflicting rows for a"):
        latest.without_conflicts(rows.drop("at"), ["k"]).collect()
    assert latest.without_conflicts(rows.filter("at < 3").drop("at"), ["k"]).count() == 2


def test_newest_keeps_nulls_of_the_newest_row(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, v long, w string")
    assert latest.newest(rows, ["k"], "v").collect() == [("a", None)]


def test_locked_merge(spark):
    schema = "k int, name string, locked boolean, updated_at int"
    old = spark.createDataFrame([(1, "a", True, 1), (2, "b", False, 1), (3, "c", False, 1)], schema)
    new = spark.createDataFrame([(1, "A", False, 2), (2, "B", True, 2), (4, "D", True, 2)], schema)
    out = sorted(tuple(r) for r in latest.merge_locked(old, new, ["k"], "locked", ["updated_at"]).collect())
    assert out == [(1, "a", True, 2), (2, "B", False, 2), (3, "c", False, 1), (4, "D", True, 2)]


def test_streaks_follow_the_trading_calendar(spark):
    held = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 2, 5, 9)], "s string, d date")
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 5, 8, 9)], "d date")
    assert [r.streak for r in timeseries.streaks(held, days, ["s"], "d").orderBy("d").collect()] == [1, 2, 3, 1]


def test_pages_and_bounds(spark):
    rows = spark.range(10)
    assert [r.id for r in ordering.page(rows, ["id"], 3, 4).collect()] == [4, 5, 6, 7]
    with pytest.raises(ordering.TooManyRowsError):
        ordering.complete(rows, 9)
    assert ordering.complete(rows, 10) is rows


def test_sweeps(spark):
    rows = spark.createDataFrame([("sz", f"{k:06d}") for k in range(7)] + [("sh", "600000")], "market string, symbol string")
    batches = ops.sweep_batches(rows, 3)
    assert sorted((r.market, r.batch_no, len(r.symbols)) for r in batches.collect()) == [("sh", 1, 1), ("sz", 1, 3), ("sz", 2, 3), ("sz", 3, 1)]
    states = spark.createDataFrame([("sz", 2, "succeeded"), ("sz", 1, "failed")], "market string, batch_no long, status string")
    assert sorted((r.market, r.batch_no) for r in ops.resume_pending(batches, states).collect()) == [("sh", 1), ("sz", 1), ("sz", 3)]


def test_enrichment_guards(spark):
    schema = "k int, fact int, note string"
    now = spark.createDataFrame([(1, 5, "a"), (2, None, "")], schema)
    new = spark.createDataFrame([(1, 5, ""), (2, 1, "n"), (3, 1, "n")], schema)
    assert sorted(tuple(r) for r in ops.changed_facts(now, new, ["k"], ["note"]).collect()) == [(2, "changed"), (3, "missing")]
    assert sorted(tuple(r) for r in ops.keep_enrichment(now, new, ["k"], ["note"]).collect()) == [(1, 5, "a"), (2, 1, "n"), (3, 1, "n")]


def test_pools(spark):
    rows = spark.createDataFrame([(1, "a", "open_limit"), (1, "a", "limit_up"), (1, "b", "open_limit"), (1, "c", "limit_down")], "trade_date int, symbol string, pool string")
    assert sorted((r.symbol, r.pool, r.close_status) for r in ops.reconciled_pools(rows).collect()) == [("a", "limit_up", "sealed"), ("a", "open_limit", "broken_reseal"), ("b", "open_limit", "broken"), ("c", "limit_down", "limit_down")]
    both = spark.createDataFrame([(1, "a", "limit_up"), (1, "a", "limit_down")], rows.schema)
    with pytest.raises(Exception, match="contradictory"):
        ops.reconciled_pools(both).collect()


def test_content_address_ignores_order(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1)], "g string, v int")
    assert len({r.content_id for r in ops.content_address(rows, ["g"], F.col("v").cast("string")).collect()}) == 1


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.normalized(F.col("a")), a=" A　b\tÇ ") == "abç"
    assert [one(spark, text.infer_market(F.col("a")), a=s) for s in ("920001", "830001", "430001", "600000", "900901", "000001")] == ["bj", "bj", "bj", "sh", "sh", "sz"]
    assert tuple(one(spark, text.market_and_symbol(F.col("a")), a="/x/vipdoc/SZ000001.day")) == ("sz", "000001")
    assert tuple(one(spark, text.market_and_symbol(F.col("a"), "bj"), a="/x/600000.day")) == ("bj", "600000")
    assert one(spark, text.alias_list(F.col("a")), a=" a|b; a,,c ") == ["a", "b", "c"]
    assert [one(spark, text.relay_status(F.col("a")), a=s) for s in (" 连板", "", "x")] == ["promoted", "unknown", None]


def test_date_functions(spark):
    assert [one(spark, dates.date_of_number(F.col("a")), a=n) for n in (20240229, 20230229, 18991231, 0)] == [D(2024, 2, 29), None, None, None]
    assert tuple(one(spark, dates.packed_minute(F.col("a"), F.col("b")), a=(2024 - 2004) * 2048 + 105, b=571)) == (D(2024, 1, 5), 571)
    assert tuple(one(spark, dates.packed_minute(F.col("a"), F.col("b")), a=(2024 - 2004) * 2048 + 1305, b=1500)) == (None, None)
    assert [one(spark, dates.clock_of_text(F.col("a")), a=s) for s in ("09:31", "9:31:05", "093105", "-", "", "25:00")] == ["09:31", "09:31", "09:31", None, None, None]
    assert [one(spark, dates.minute_label(F.col("a")), a=n) for n in (0, 119, 120, 239)] == [570, 689, 780, 899]
    assert one(spark, dates.minute_label(F.col("a"), 121), a=120) == 690
    assert [one(spark, dates.vendor_time(F.col("a")), a=n) for n in (9305000, 14990000, 930)] == ["9:30:30.000", "14:59:24.000", "0:00:05.580"]
    assert one(spark, dates.clock_of_seconds(F.col("a"), F.lit("2024-01-05").cast("date")), a=1704418260) == "09:31"


def test_filters_reach_the_scan_below_newest_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("sz", "1", D(2024, 1, 2), 1, 2.0)], "market string, symbol string, trade_date date, v long, close double").write.parquet(path)
    rows = latest.newest(spark.read.parquet(path), ["market", "symbol", "trade_date"], "v")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = rows.filter((F.col("market") == "sz") & (F.col("trade_date") >= F.lit("2024-01-01").cast("date")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(market,sz)" in plan and "GreaterThanOrEqual(trade_date,2024-01-01)" in plan, plan


def test_as_of_and_factors_form_no_pairs(spark):
    """One window over the union of both sides: no join of bars with actions."""
    rows = timeseries.asof_before(actions(spark, []), day_bars(spark, [1.0]), ["market", "symbol"], "event_date", "trade_date", "close", "prev")
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_recent_rows_need_no_full_sort(spark):
    plan = ordering.recent_ascending(spark.range(1000), "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_null_keys_and_versions_lose_nothing(spark):
    schema = "market string, symbol string, name string, locked boolean"
    stored = spark.createDataFrame([(None, "1", "old", False), ("sz", "1", "kept", True)], schema)
    incoming = spark.createDataFrame([(None, "1", "new", False), (None, "2", "new", False), ("sz", "1", "new", False)], schema)
    rows = sorted(((r.market or "", r.symbol, r.name) for r in latest.merge_locked(stored, incoming, ["market", "symbol"], "locked").collect()))
    assert rows == [("", "1", "new"), ("", "2", "new"), ("sz", "1", "kept")]
    assert sorted((r.market or "", r.symbol, r.name) for r in latest.upsert(stored, incoming, ["market", "symbol"]).collect()) == [("", "1", "new"), ("", "2", "new"), ("sz", "1", "new")]
    versions = spark.createDataFrame([("k", None, "x"), ("m", None, "y"), ("m", 1, "z"), (None, 2, "n")], "k string, v int, t string")
    assert sorted((r.k or "", r.t) for r in latest.newest(versions, ["k"], "v").collect()) == [("", "n"), ("k", "x"), ("m", "z")]
    twice = versions.unionByName(versions)
    assert latest.without_conflicts(twice, ["k", "v"]).count() == 4
    with pytest.raises(Exception, match="conflicting rows for m"):
        latest.without_conflicts(twice, ["k"]).collect()


def test_parts_of_an_order(spark):
    rows = spark.range(5).withColumnRenamed("id", "n")
    ids = lambda *a: [r.n for r in ordering.part(rows, ["n"], *a).collect()]
    assert ids() == ids(0, 0) == ids(-1, 9) == [0, 1, 2, 3, 4]
    assert ids(3) == ids(3, -1) == [3, 4] and ids(1, 2) == [1, 2] and ids(5) == ids(9, 2) == []
    assert ordering.part(rows.limit(0), ["n"], 0, 3).count() == 0


def test_matrix_total_counts_stocks_of_all_pages(spark):
    schema = "trade_date date, market string, symbol string, event_type string, board_count int, close_status string, theme_primary string"
    events = spark.createDataFrame([(D(2024, 1, 10), "sz", str(n % 7), "limit_up", n, "sealed", "t") for n in range(20)], schema)
    relayed = spark.createDataFrame([(D(2024, 1, 10), "sz", s, "t", "g", "x") for s in ("6", "8")], "trade_date date, market string, symbol string, prev_theme_primary string, sample_group string, today_status string")
    query = params.LimitQuery(trade_date="2024-01-10", limit=3, offset=2)
    assert review.matrix_total(events, relayed, query).first().total_rows == 8
    assert review.matrix_rows(events, relayed, query).count() == 3
    assert review.matrix_total(events.limit(0), relayed.limit(0), query).first().total_rows == 0


def test_bars_carry_their_providers_units(spark):
    bars = spark.createDataFrame([(D(2024, 1, 5), 7.0)], "trade_date date, volume double")
    row = tables.labelled_bars(bars, "tdx").first()
    assert (row.provider, row.volume_unit, row.amount_unit, row.volume) == ("tdx", "hand", "CNY", 7.0)
    with pytest.raises(ValueError):
        tables.labelled_bars(bars, "unknown")
