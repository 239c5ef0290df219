"""Fixed frames, quotes, seat texts, checked reads and runs on small inputs, with what they must refuse."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from quotemill.plans import guards
from quotemill.sources import frames, packers, wire

D = dt.date


def bodies(spark, *found):
    return spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(found)], "frame_id long, body binary")


def test_fixed_frames_refuse_what_is_cut_off(spark):
    bar = struct.pack("<HHffffIIf", 20240105 % 65536, 20240105 // 65536, 1, 2, 0.5, 1.5, 0x3FC00000, 7, 9)
    row = frames.ex_bars(bodies(spark, b"\0" * 18 + struct.pack("<H", 1) + bar), 9).collect()[0]
    assert (row.trade_date, row.high, row.position, row.trade, row.price, row.amount) == (D(2024, 1, 5), 2, 0x3FC00000, 7, 9, 1.5)
    minute = struct.pack("<HH", 20 * 2048 + 105, 571) + bar[4:]
    row = frames.ex_bars(bodies(spark, b"\0" * 18 + struct.pack("<H", 1) + minute), 7).collect()[0]
    assert (row.trade_date, row.minute_of_day) == (D(2024, 1, 5), 571)
    assert frames.ex_bars(bodies(spark, b"\0" * 20), 9).count() == 0
    for body in (b"\0" * 19, b"\0" * 18 + struct.pack("<H", 2) + bar):
        with pytest.raises(Exception, match="FrameError"):
            frames.ex_bars(bodies(spark, body), 9).collect()
    with pytest.raises(Exception, match="FrameError"):
        frames.finance(bodies(spark, b"\0" * 144)).collect()
    with pytest.raises(Exception, match="FrameError"):
        frames.quotes(bodies(spark, struct.pack("<HH", 0, 1) + b"\0" * 12)).collect()


def test_float_of_bits(spark):
    values = [0.0, 1.0, -2.5, 1e-40, 3.4e38, 1.17549435e-38]
    rows = spark.createDataFrame([(struct.unpack("<I", struct.pack("<f", v))[0],) for v in values] + [(0x7F800000,)], "b long")
    assert [r.x for r in rows.select(frames.float_of_bits(F.col("b")).alias("x")).collect()] == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values] + [None]


def test_packed_frames_read_back(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("frame_id"), F.col("id"))
    out = wire.unpacked(packers.framed(rows, ["id"], lambda r: packers.varint(int(r["id"]) - 2000), lambda n: struct.pack("<H", n))).collect()
    assert len(out) == 7
    for r in out:
        at, found = 2, []
        while at < len(r.body):
            value, at = wire.varint(r.body, at)
            found.append(value + 2000)
        assert found == list(range(r.frame_id, 5000, 7)) and struct.unpack("<H", r.body[:2])[0] == len(found)


SEATS = """intro │ x│ 1│ 2│
●交易日期:2024-01-05  信息类型:kind a
涨跌幅(%):-9.5  成交量(万股):12.0  成交额(万元):30.25
│before any side│ 1│ 2│
买入前五名
┌──────┐
│营业部名称│买入金额│卖出金额│
│ First seat │ 10.5│ 0│
│ Long name │ 0│ 0│
│   │ 7│ 1│
│ Nothing │ 0│ 0│
│ Next │ 3│ 0│
│   │ 9│ 9│
卖出前五名
│ Out │ 0│ 5│
●交易日期:2024-01-08  信息类型:kind b
买入前五名
│ Again │ 1│ 0│
"""


def test_seat_texts(spark):
    texts = spark.createDataFrame([(1, SEATS.replace("\n", "\r\n")), (2, None), (3, "")], "text_id long, value string")
    rows = frames.seat_records(texts).orderBy("record_no", "side", "seat_no").collect()
    assert [(r.record_no, r.trade_date, r.side, r.seat_no, r.name, r.buy, r.sell) for r in rows] == [
        (1, D(2024, 1, 5), "buy", 1, "First seat", 10.5, 0), (1, D(2024, 1, 5), "buy", 2, "Long name", 7, 1), (1, D(2024, 1, 5), "buy", 3, "Next", 3, 0), (1, D(2024, 1, 5), "sell", 1, "Out", 0, 5), (2, D(2024, 1, 8), "buy", 1, "Again", 1, 0),
    ]
    assert (rows[0].info_type, rows[0].change_pct, rows[0].volume, rows[0].amount, rows[-1].change_pct) == ("kind a", -9.5, 12.0, 30.25, None)


def test_current_events_are_whole_and_unique(spark, monkeypatch):
    rows = spark.createDataFrame([(D(2024, 1, 5), "sz", "1", "limit_up"), (D(2024, 1, 5), "sz", "1", "open_limit"), (D(2024, 1, 8), "sz", "1", "limit_up")], "trade_date date, market string, symbol string, event_type string")
    assert guards.current_events(rows, "2024-01-05").count() == 2
    with pytest.raises(Exception, match="repeated current event sz:1:limit_up"):
        guards.current_events(rows.unionByName(rows), "2024-01-05").collect()
    monkeypatch.setattr(guards, "MOST_EVENTS", 1)
    with pytest.raises(ValueError):
        guards.current_events(rows, "2024-01-05")


def test_index_history_that_starts_late(spark):
    rows = spark.createDataFrame([("i", 0, D(2024, 1, 8), 1.0, 2.0, 0.5, 1.5, 7.0, 1.0), ("i", 1, D(2024, 1, 5), 1.0, 2.0, 0.5, 1.5, 7.6, 1.0)], "index_code string, page_no int, trade_date date, open double, high double, low double, close double, volume double, amount double")
    bars, issues = guards.index_bars(rows, "2024-01-01", "2024-01-08", dt.datetime(2024, 1, 8, 15, 5))
    assert [r.volume for r in bars.orderBy("trade_date").collect()] == [8, 7]
    assert [(r.trade_date, r.issue_type) for r in issues.collect()] == [(D(2024, 1, 5), "index_history_starts_late")]


def test_failures_and_runs(spark):
    texts = {None: "", "": "", "Decode: x": "decode", "context canceled": "cancelled", "i/o timeout": "timeout", "pool exhausted": "server_select", "reset": "transport", "rate limit hit": "rate_limit"}
    rows = spark.createDataFrame([(k,) for k in texts], "e string")
    assert [r.x for r in rows.select(guards.failure_kind(F.col("e")).alias("x")).collect()] == list(texts.values())
    outcomes = spark.createDataFrame([("sh", 1, "", 5), ("sh", 2, "context canceled", 5)], "market string, batch_no long, error string, row_count long")
    planned = spark.createDataFrame([("r", 2)], "run_id string, planned long")
    assert tuple(guards.sweep_run(guards.sweep_states(outcomes, "r", 1), planned).first()) == ("r", 2, 1, 0, 1, 5, "interrupted")
    assert guards.sweep_run(guards.sweep_states(outcomes.limit(1), "r", 1), planned).first().status == "interrupted"
