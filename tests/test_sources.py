"""Readers on files built here: record layouts, archives, JSON, tables, frames, and the upsert stream."""

import datetime as dt
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.sources import records, review_json, tables, wire
from quotemill.streaming import upserts

D = dt.date


def contents(spark, **files):
    return spark.createDataFrame([(f"/data/{k.replace('__', '.')}", bytearray(v)) for k, v in files.items()], "source_path string, content binary")


def day_record(date, close, volume=7):
    return struct.pack("<IIIIIfII", date, 100, 300, 50, close, 5.5, volume, 0)


def test_day_files(spark, tmp_path):
    folder = tmp_path / "vipdoc" / "sh" / "lday"
    folder.mkdir(parents=True)
    (folder / "sh600000.day").write_bytes(day_record(20240105, 200) + day_record(20240105, 200) + day_record(20240105, 201) + day_record(20241301, 9) + day_record(20240108, 210, 4_000_000_000))
    (folder / "other.txt").write_bytes(b"x")
    bars, issues = records.day_bars(records.files(spark, str(tmp_path), "*.day"))
    rows = bars.orderBy("trade_date").collect()
    assert [(r.market, r.symbol, r.trade_date, r.open, r.close, r.volume) for r in rows] == [("sh", "600000", D(2024, 1, 5), 1.0, 2.0, 7), ("sh", "600000", D(2024, 1, 8), 1.0, 2.1, 4_000_000_000)]
    assert sorted((r.row_offset, r.issue_type) for r in issues.collect()) == [(1, "duplicate_logical_key"), (2, "conflicting_logical_key"), (3, "invalid_date")]
    bars, issues = records.day_bars(contents(spark, sz000001__day=b"123", sz000002__day=day_record(20240105, 200) + b"12", sz000003__day=struct.pack("<IIIIIfII", 20240105, 1, 1, 2, 1, 0, 0, 0)))
    assert [(r.symbol, r.row_offset) for r in bars.collect()] == [("000002", 0)]
    found = sorted((r.source_path[-10:-4], r.issue_type, r.row_offset) for r in issues.collect())
    assert found == [("000001", "incomplete_trailing_bytes", 0), ("000001", "zero_valid_rows", None), ("000002", "incomplete_trailing_bytes", 1), ("000003", "high_less_than_low", 0), ("000003", "zero_valid_rows", None)]


def test_minute_files(spark):
    date = (2024 - 2004) * 2048 + 105
    floats = struct.pack("<HHfffffII", date, 571, 1.5, 2.0, 1.0, 1.25, 9.0, 3, 0)
    ints = struct.pack("<HHIIIIfII", date, 900, 150, 200, 100, 125, 9.0, 3, 0) + struct.pack("<HHIIIIfII", date, 1500, 1, 1, 1, 1, 0, 0, 0)
    bars, issues = records.minute_bars(contents(spark, sz000001__lc1=floats, bj920001__5=ints))
    assert sorted((r.market, r.minute_of_day, r.open, r.close) for r in bars.collect()) == [("bj", 900, 1.5, 1.25), ("sz", 571, 1.5, 1.25)]
    assert [r.issue_type for r in issues.collect()] == ["invalid_time"]


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", ".").replace("_S_", "/"), data)
    return out.getvalue()


def test_archives_and_the_shadow_rule(spark):
    inner = archive(gpcw20240331__dat=b"inner", other__dat=b"o")
    rows = records.entries(contents(spark, a__zip=archive(gpcw20240331__dat=b"direct", gpcw20240331__zip=inner, gpcw20231231__zip=inner, note__txt=b"n")), (".dat",))
    assert rows.count() == 5
    kept = sorted(r.entry for r in tables.unshadowed(rows).collect())
    assert kept == ["gpcw20231231.zip!gpcw20240331.dat", "gpcw20231231.zip!other.dat", "gpcw20240331.dat"]


def test_day_packages(spark):
    bar = np.zeros(2, records.PACK_BAR)
    bar["close"], bar["volume"] = [1.5, 2.5], [7, 2**63]
    codes = b"".join(c.encode().ljust(150, b"\0") for c in ("600000", "600001"))
    rows = records.entries(contents(spark, g__zip=archive(sh240105__cod=codes, sh240105__md1=bar.tobytes())))
    out = records.package_bars(rows).orderBy("symbol").collect()
    assert [(r.market, r.symbol, r.trade_date, r.close, r.volume) for r in out] == [("sh", "600000", D(2024, 1, 5), 1.5, 7), ("sh", "600001", D(2024, 1, 5), 2.5, None)]
    bad = records.entries(contents(spark, g__zip=archive(sh240105__cod=codes[:150], sh240105__md1=bar.tobytes())))
    with pytest.raises(Exception, match="1 codes and 2 bars"):
        records.package_bars(bad).collect()


def test_other_records(spark):
    ex = struct.pack("<IffffIIf", 20240105, 1, 2, 0.5, 1.5, struct.unpack("<I", struct.pack("<f", 8.5))[0], 12, 1.25)
    row = records.ex_day_bars(contents(spark, **{"29#IFL0__day": ex}))[0].collect()[0]
    assert (row.ex_market, row.code, row.price, row.position, row.trade, row.settlement) == (29, "IFL0", 8.5, 12, 12, 1.25)
    capital = struct.pack("<I", 2) + struct.pack("<B7sIB4f", 1, b"600000", 20240105, 1, 1, 2, 3, 4) + struct.pack("<B7sIB4f", 0, b"000001", 20240105, 5, 1, 2, 3, 4)
    out = {r.symbol: r for r in records.capital_changes(contents(spark, gbbq=capital))[0].collect()}
    assert (out["600000"].market, out["600000"].fenhong, out["600000"].peigu, out["600000"].panqianliutong) == ("sh", 1, 4, None)
    assert (out["000001"].fenhong, out["000001"].panqianliutong, out["000001"].qianzongguben, out["000001"].houzongguben) == (None, 1, 2, 4)
    metric = struct.pack("<BIff", 3, 20240105, 1.5, 2.5) + struct.pack("<BIff", 3, 20240105, 9, 9)
    values, issues = records.metric_values(contents(spark, gpsh600000__dat=metric))
    assert [(r.symbol, r.metric_type, r.value1) for r in values.collect()] == [("600000", 3, 1.5)] and [r.issue_type for r in issues.collect()] == ["duplicate_logical_key"]


def test_report_and_block_files(spark):
    head = struct.pack("<HIHIII", 1, 20240331, 2, 0, 8, 0)
    index = b"".join(struct.pack("<6s1sI", c, b"1", 20 + 22 + 8 * k) for k, c in enumerate((b"600000", b"000001")))
    rows = records.report_items(contents(spark, gpcw20240331__dat=head + index + struct.pack("<4f", 1, 2, 3, 4))).orderBy("symbol", "item_id").collect()
    assert [(r.report_date, r.market, r.symbol, r.item_id, r.value) for r in rows] == [(D(2024, 3, 31), "sz", "000001", 1, 3), (D(2024, 3, 31), "sz", "000001", 2, 4), (D(2024, 3, 31), "sh", "600000", 1, 1), (D(2024, 3, 31), "sh", "600000", 2, 2)]
    block = b"\0" * 384 + struct.pack("<H", 1) + "银行".encode("gb18030").ljust(9, b"\0") + struct.pack("<HH", 2, 2) + b"600000\x00000001\0".ljust(2800, b"\0")
    out = records.block_members(contents(spark, block_zs__dat=block)).orderBy("member_order").collect()
    assert [(r.block_name, r.symbol) for r in out] == [("银行", "600000"), ("银行", "000001")] and records.vendor_text(b"\xff\xff") == ""


def test_bar_checks(spark):
    bars = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 0, 0.0), (1.0, 0.9, 0.5, 1.5, 0, 0.0), (float("nan"), 2.0, 0.5, 1.5, 0, 0.0), (0.0, 0.0, 0.0, 1.5, 0, 0.0)], "open double, high double, low double, close double, volume long, amount double")
    assert [r.ok for r in bars.select(records.consistent(bars).alias("ok")).collect()] == [True, False, False, False]
    assert [r.ok for r in bars.select(records.no_trade(bars).alias("ok")).collect()] == [False, False, False, True]
    shares = spark.createDataFrame([("sh", "600000"), ("sh", "510000"), ("sz", "301000"), ("sz", "200001"), ("bj", "920001"), ("bj", "430001")], "m string, s string")
    assert [r.x for r in shares.select(records.is_share(F.col("m"), F.col("s")).alias("x")).collect()] == [True, False, True, False, True, False]


STOCK = {"code": "600000", "board_count": 2, "reason_type": " r ", "theme_primary": "t", "theme_tags": [" a", "a", ""], "first_limit_up_time": "093105", "last_limit_up_time": "10:00", "turnover_rate": 0, "open_num": 0, "order_amount": 5.0}
SUMMARY = {"limit_up_count": 2, "limit_down_count": 0, "open_limit_count": 1, "max_board_height": 2, "first_board_count": 1, "continuous_board_count": 1}


def snapshot(day, **more):
    return {"trade_date": day, "prev_trade_date": "2024-01-04", "summary": SUMMARY, "limit_up_pool": [STOCK], "broken": [{**STOCK, "code": "1"}, {**STOCK, "status": "odd"}], "limit_down": [{**STOCK, "first_limit_up_time": "11:00"}], "theme_overview": [{"theme_name": "t", "leader_code": "x"}, {"theme_name": " "}]} | more


def test_snapshots(spark, tmp_path):
    relay = {"height_groups": [{"height": 2, "stocks": [{"code": "600000", "prev_board_count": 2, "today_status": "连板", "today_pct_chg": 0.05}, {"code": "600001", "prev_board_count": 1, "today_status": "??"}]}]}
    for path, content in {"2024/01/05.json": snapshot("2024-01-05", relay=relay), "2024/01/08.json": snapshot("2024-01-09"), "2024/01/10.json": {"trade_date": "2024-01-10"}, "2024/01/11.json": snapshot("2024-01-11", prev_trade_date="2024-01-11"), "evidence/2024/01/05.json": {}}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(content))
    rows = review_json.snapshots(spark, str(tmp_path)).cache()
    assert sorted((r.trade_date, r.file_issue) for r in rows.collect()) == [("2024-01-05", None), ("2024-01-09", "trade_date_mismatch"), ("2024-01-10", "missing_required_field"), ("2024-01-11", "prev_trade_date_not_before")]
    events = review_json.events(rows, "historical-replay")
    out = {(r.event_type, r.issue): r for r in events.collect()}
    assert set(out) == {("limit_up", None), ("open_limit", "invalid_symbol"), ("open_limit", "unsupported_status"), ("limit_down", "first_after_last")}
    good = out["limit_up", None]
    assert (good.market, good.close_status, good.reason_text, good.theme_tags, good.first_limit_minute, good.turnover_rate, good.open_count, good.seal_order_amount) == ("sh", "sealed", "r", ["a"], "09:31", None, None, 5.0)
    assert review_json.events(rows).filter("issue is null").first().turnover_rate == 0
    summary = review_json.summaries(rows, events).collect()
    assert [(r.limit_up_count, r.two_board_count, r.three_board_count) for r in summary] == [(2, 1, 0)]
    assert sorted((r.event_type, r.declared) for r in review_json.declared_counts(rows).collect()) == [("limit_down", 0), ("limit_up", 2), ("open_limit", 1)]
    samples = review_json.relay(rows, 100.0).collect()
    assert sorted((r.sample_group, r.today_status, r.today_pct_chg, r.issue) for r in samples if r.issue is None) == [("prev_ladder", "promoted", 5.0, None), ("prev_limit_up", "promoted", 5.0, None)]
    assert [r.issue for r in samples if r.issue] == ["unsupported_status"]
    assert sorted((r.theme_name, r.leader_symbol, r.issue) for r in review_json.themes(rows).collect()) == [("", "", "missing_theme_name"), ("t", "", None)]


def test_a_line_is_checked_once_for_all_its_events(spark):
    lines = spark.range(1).select(F.col("id").cast("string").alias("value"))
    above, explode, _ = review_json.corrections(lines)._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert explode and "jsonObjectKeys" not in above


def test_corrections(spark):
    event = {"code": "600000", "event_type": "limit_up", "close_status": "sealed", "board_count": 1, "reason_type": "why"}
    line = {"trade_date": "2024-01-05", "mode": "enrich_existing", "reason": "r", "audit_ref": "a", "events": [event]}
    texts = [json.dumps(x) for x in (line, {**line, "extra": 1}, {**line, "events": [{**event, "odd": 1}]}, {**line, "mode": "upsert"}, {**line, "audit_ref": ""}, {**line, "events": []}, {**line, "events": [{**event, "code": "x"}]})] + ["", "{"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    issues = [r.issue for r in review_json.corrections(rows).collect()]
    assert sorted(map(str, issues)) == sorted(["None", "unknown_field", "unknown_field", "mode_not_allowed", "reason_and_audit_ref_required", "no_events", "invalid_symbol", "invalid_json"])
    assert review_json.corrections(rows, True).filter("issue is null").count() == 2
    good = review_json.corrections(rows).filter("issue is null").first()
    assert (good.trade_date, good.market, good.reason_text) == (D(2024, 1, 5), "sh", "why")
    both = spark.createDataFrame([('[{"a": 1}]',), ('{"rows": [{"a": 2}]}',)], "value string")
    assert sorted(r.a for r in review_json.normalized_rows(both, "rows", "a long").collect()) == [1, 2]


def test_dictionaries_and_manifests(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_text("metric_type,name,title,value1_meaning,value2_meaning,status,source_ref\n1,a,A,x,y,verified,r\n2,b,B,x,y,unknown,r\n")
    allowed = {"status": ("verified", "unknown")}
    assert tables.dictionary(spark, str(good), tables.METRICS, "metric_type", allowed).count() == 2
    for text in ("metric_type,name\n1,a\n", good.read_text() + "2,c,C,x,y,verified,r\n", good.read_text() + "3,c,C,x,y,odd,r\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(tables.DictionaryError):
            tables.dictionary(spark, str(bad), tables.METRICS, "metric_type", allowed)
    (tmp_path / "list.txt").write_text("a.dat,900150983cd24fb0d6963f7d28e17f72,3\nb.dat,00,3\nc.dat,00,9\ne.dat,00,1\n")
    files = spark.createDataFrame([(n, bytearray(b"abc")) for n in ("a.dat", "b.dat", "c.dat", "d.dat")], "filename string, content binary")
    out = tables.manifest_mismatches(files, tables.manifest(spark, str(tmp_path / "list.txt")))
    assert sorted(tuple(r) for r in out.collect()) == [("b.dat", "md5_mismatch"), ("c.dat", "size_mismatch"), ("d.dat", "not_listed"), ("e.dat", "file_missing")]


def test_security_master(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("market,symbol,name,status,listing_date,aliases\nSH,600000,Pu Fa,上市,19991110,pf|bank; pf\nxx,1,bad,,,\n")
    good, aliases, bad = tables.security_master(spark, str(path))
    row = good.collect()[0]
    assert (row.market, row.current_name_norm, row.status, row.listing_date, row.lot_size) == ("sh", "pufa", "active", D(1999, 11, 10), 100)
    assert sorted(r.alias for r in aliases.collect()) == ["bank", "pf"] and bad.count() == 1
    many = spark.createDataFrame([("sh", "1", "x", "n", "A", 5, 2), ("sh", "1", "x", "n", "B", 9, 3), ("sh", "1", "x", "n", "C", 9, 1)], "market string, symbol string, alias_type string, alias_norm string, alias string, priority int, position int")
    assert [r.alias for r in tables.best_aliases(many).collect()] == ["C"]


def test_provider_payloads(spark):
    kline = json.dumps({"data": {"code": "BK1", "klines": ["2024-01-05,1,1.5,2,0.5,10,20.5", "2024-01-08,1,1,1,1,1,1"]}})
    rows = tables.kline_payloads(spark.createDataFrame([(kline,), ("{}",)], "value string"))
    assert [(r.code, r.open, r.close, r.high, r.low) for r in rows.orderBy("trade_date").collect()][0] == ("BK1", 1, 1.5, 2, 0.5)
    year = 'quotebridge_v6({"data":"20240105,1,2,0.5,1.5,10,20;20240108,1,1,1,1,1,1;"})'
    assert [(r.trade_date, r.high, r.low, r.close) for r in tables.jsonp_years(spark.createDataFrame([(year,)], "value string")).orderBy("trade_date").collect()][0] == (D(2024, 1, 5), 2, 0.5, 1.5)
    keep = F.col("trade_date") > F.lit("2024-01-06").cast("date")
    assert tables.checked_bars(rows.unionByName(rows), ["code", "trade_date"], keep).count() == 1
    with pytest.raises(Exception, match="conflicting rows|invalid bar"):
        tables.checked_bars(rows.unionByName(rows.withColumn("close", F.col("close") - 0.1)), ["code", "trade_date"], keep).collect()
    with pytest.raises(Exception, match="invalid bar"):
        tables.checked_bars(rows.withColumn("high", F.lit(0.1)), ["code", "trade_date"], keep).collect()


def test_page_links(spark):
    html = '<div class="x"><a href="/no">No</a></div><div class="cate group"><div><a href="/1">A &amp;\n b</a></div><a href="/2">C</a></div><a href="/3">D</a>'
    rows = tables.page_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), "cate").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "/1", "A & b"), (1, 1, "/2", "C")]


def encode(value):
    first, rest = abs(value) & 0x3F, abs(value) >> 6
    out = [first | (0x40 if value < 0 else 0) | (0x80 if rest else 0)]
    while rest:
        out.append(rest & 0x7F | (0x80 if rest >> 7 else 0))
        rest >>= 7
    return bytes(out)


def frames(spark, *bodies):
    return spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bodies)], "frame_id long, body binary")


def test_numbers_and_frames():
    for value in (0, 1, -1, 63, 64, -64, 8191, 8192, -1_000_000):
        assert wire.varint(encode(value) + b"\x7f", 0) == (value, len(encode(value)))
    with pytest.raises(wire.FrameError):
        wire.varint(b"\x80", 0)
    body = b"abc" * 50
    packed = zlib.compress(body)
    assert wire.inflated(b"\0" * 12 + struct.pack("<HH", len(packed), len(body)) + packed) == body
    assert wire.inflated(b"\0" * 12 + struct.pack("<HH", 3, 3) + b"abc") == b"abc"
    assert wire.vendor_float(0x4A000000) == 2.0**21


def test_bar_frames(spark):
    body = struct.pack("<H", 2)
    for day, diffs in ((20240105, (1000, 50, 80, -20)), (20240108, (10, -30, 5, -40))):
        body += struct.pack("<I", day) + b"".join(map(encode, diffs)) + struct.pack("<II", 0x4A000000, 0x4A000000)
    rows = wire.bars(frames(spark, body, struct.pack("<H", 0)), 9).orderBy("record_no").collect()
    assert [(r.trade_date, r.open, r.close, r.high, r.low, r.volume) for r in rows] == [(D(2024, 1, 5), 1.0, 1.05, 1.08, 0.98, 2.0**21), (D(2024, 1, 8), 1.06, 1.03, 1.065, 1.02, 2.0**21)]


def test_point_trade_and_action_frames(spark):
    points = struct.pack("<HH", 2, 0) + b"".join(map(encode, (1000, 0, 5, -10, 0, 7)))
    assert [(r.minute_of_day, r.price, r.volume) for r in wire.minute_points(frames(spark, points)).orderBy("point_index").collect()] == [(570, 10.0, 5), (571, 9.9, 7)]
    trades = struct.pack("<H", 2) + struct.pack("<H", 571) + b"".join(map(encode, (1000, 5, 1, 0, 0))) + struct.pack("<H", 572) + b"".join(map(encode, (5, 6, 2, 1, 0)))
    assert [(r.minute_of_day, r.price, r.volume, r.num, r.side) for r in wire.transactions(frames(spark, trades)).orderBy("record_no").collect()] == [(571, 10.0, 5, 1, 0), (572, 10.05, 6, 2, 1)]
    one = lambda day, kind: struct.pack("<B6sBIB4f", 1, b"600000", 0, day, kind, 1, 2, 3, 4)
    events, issues = wire.corporate_actions(frames(spark, b"\0" * 9 + struct.pack("<H", 3) + one(20240105, 1) + one(20240106, 5) + one(20241306, 1)))
    assert [(r.event_date, r.category_name, r.fenhong, r.peigu) for r in events.orderBy("record_no").collect()] == [(D(2024, 1, 5), "除权除息", 1, 4), (D(2024, 1, 6), "股本变化", None, None)]
    assert issues.count() == 1


def test_members_codes_and_natures(spark):
    bitmap = bytearray(20)
    bitmap[0], bitmap[11] = 0b100001, 0b10000
    body = bytes(bitmap) + b"\0" * 4 + struct.pack("<H", 5) + struct.pack("<H22s44sfIi", 1, b"600000", "浦发".encode("gb18030"), 9.5, 7, -3)
    row = wire.board_members(frames(spark, body)).collect()[0]
    assert (row.symbol, row.name, row.fields) == ("600000", "浦发", {"pre_close": 9.5, "volume": 7.0, "consecutive_up": -3.0})
    codes = spark.createDataFrame([(s,) for s in ("US0401", "HK0283", "000300", "399001", "899050", "880001", "12", "x")], "s string")
    assert [r.x for r in codes.select(wire.board_code(F.col("s")).alias("x")).collect()] == [30401, 20283, 31300, 30001, 32050, 20001, 12, 0]
    cases = [(1, 5, 3, 0), (1, 3, 3, 10005), (1, 5, 0, 10070), (1, 4, -4, 0), (1, 4, -5, 10000), (1, 5, -3, 20000), (1, 1, 0, 20000), (31, 1, 0, 256), (48, 1, 0, 7), (1, 2, 5, 0)]
    rows = spark.createDataFrame(cases, "m int, v int, c int, n int").select(wire.trade_nature(F.col("m"), F.col("v"), F.col("c"), F.col("n")).alias("x")).collect()
    assert [tuple(r.x) for r in rows] == [("多开", 1, 0), ("双开", -1, 5), ("空换", -1, 0), ("双平", 1, 0), ("多平", -1, 0), ("平仓", 0, 0), ("换手", 0, 0), ("S", -1, 0), ("", 0, 7), ("换手", 1, 0)]


def test_rankings(spark):
    quotes = spark.createDataFrame([("sz", "1", 5.0, 1.0), ("sz", "2", 5.0, None), ("sh", "3", 1.0, 9.0)], "market string, symbol string, pct double, amount double")
    assert [r.symbol for r in wire.ranked(quotes, "pct", True, F.col("symbol") == "1", 2).collect()] == ["2", "3"]
    out = wire.top_boards(quotes, {"gain": F.col("pct"), "amount": F.col("amount")}, 1)
    assert sorted((r.board, r.place, r.symbol) for r in out.collect()) == [("amount", 1, "3"), ("gain", 1, "1")]


def test_upsert_stream(spark, tmp_path):
    schema = "k int, seq int, v string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).coalesce(1).write.parquet(source)
    upserts.upsert_stream(spark, source, schema, target, str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(1, 1, "new")], schema).coalesce(1).write.mode("append").parquet(source)
    upserts.upsert_stream(spark, source, schema, target, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.k, r.v) for r in upserts.current(spark, target, ["k"], "seq").collect()) == [(1, "new"), (2, "c")]
