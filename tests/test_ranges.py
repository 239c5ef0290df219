"""Record files read by ranges: splits, pruning, pushed filters and cut files, against files read whole."""

import datetime
import io
import re
import struct
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from quotemill.sources import ranges, records, store
from tests.test_sources import day_record

D = datetime.date
DAYS = [D(2024, 1, 1) + datetime.timedelta(k) for k in range(200)]


@pytest.fixture
def folder(tmp_path):
    for market, symbol, n in (("sh", "600000", 200), ("sz", "000001", 90), ("bj", "920001", 3)):
        at = tmp_path / market / "lday"
        at.mkdir(parents=True)
        (at / f"{market}{symbol}.day").write_bytes(b"".join(day_record(int(d.strftime("%Y%m%d")), 150 + k) for k, d in enumerate(DAYS[:n])))
    (tmp_path / "sz" / "lday" / "sz000002.day").write_bytes(day_record(20240105, 200) + day_record(20240105, 201) + day_record(20241301, 9) + b"cut off")
    (tmp_path / "sz" / "lday" / ".hidden.day").write_bytes(b"1")
    return str(tmp_path)


def test_ranges_equal_whole_files(spark, folder):
    kept, issues = ranges.checked_rows(spark, folder, "day", records_per_task=37, glob="*.day")
    whole, wrong = records.day_bars(records.files(spark, folder, "[a-z]*.day"))
    plain = lambda df: sorted(tuple(str(x).replace("file://", "").replace("file:", "") for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert plain(kept) == plain(whole) and kept.count() == 294
    assert plain(issues) == plain(wrong)
    assert sorted(r.issue_type for r in issues.collect()) == ["conflicting_logical_key", "incomplete_trailing_bytes", "invalid_date"]


def test_large_files_are_split_and_small_ones_share(folder):
    reader = ranges.RecordReader({"path": folder, "kind": "day", "records_per_task": "64"})
    tasks = reader.partitions()
    assert [sum(last - first for _, first, last in t.parts) for t in tasks] == [64, 64, 64, 64, 40]
    assert sum(len({p for p, _, _ in t.parts}) > 1 for t in tasks) >= 1
    assert [t for t in ranges.RecordReader({"path": folder, "kind": "day", "glob": "*.none"}).partitions()] == [ranges.Ranges([])]


def test_filters_prune_files_and_search_records(folder):
    reader = ranges.RecordReader({"path": folder, "kind": "day", "ordered": "true", "glob": "*0000*.day"})
    first, last = D(2024, 3, 1), D(2024, 3, 11)
    assert list(reader.pushFilters([In(("symbol",), ("600000", "920001")), EqualTo(("market",), "sh"), GreaterThanOrEqual(("trade_date",), first), LessThan(("trade_date",), last), EqualTo(("close",), 1.0)])) == [EqualTo(("close",), 1.0)]
    (task,) = reader.partitions()
    assert [p.rpartition("/")[2] for p, _, _ in task.parts] == ["sh600000.day"]
    found = [d for b in reader.read(task) for d in b["trade_date"].to_pylist()]
    assert found == [d for d in DAYS if first <= d < last]
    path, begin, end = task.parts[0]
    with store.opened(path) as file:
        begin, end = reader.searched(file, records.DAY, 0, begin, end)
    assert end - begin == 10  # no more records than wanted are read in bulk


def test_filters_show_in_the_plan(spark, folder):
    rows = ranges.record_rows(spark, folder, "day", glob="s*.day").filter((F.col("market") == "sz") & (F.col("trade_date") >= D(2024, 3, 1)))
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain("formatted")
    pushed = re.search("PushedFilters: (.*)", out.getvalue())[1]
    assert "market" in pushed and "trade_date" in pushed and "Condition : (isnotnull(market" in out.getvalue()
    assert {r.symbol for r in rows.collect()} == {"000001"} and rows.count() == len([d for d in DAYS[:90] if d >= D(2024, 3, 1)])


def test_other_kinds(spark, tmp_path):
    date = (2024 - 2004) * 2048 + 105
    (tmp_path / "sz000001.lc1").write_bytes(struct.pack("<HHfffffII", date, 571, 1.5, 2.0, 1.0, 1.25, 9.0, 3, 0))
    (tmp_path / "bj920001.5").write_bytes(struct.pack("<HHIIIIfII", date, 900, 150, 200, 100, 125, 9.0, 3, 0) + struct.pack("<HHIIIIfII", date, 1500, 1, 1, 1, 1, 0, 0, 0))
    kept, issues = ranges.checked_rows(spark, str(tmp_path), "minute")
    assert sorted((r.market, r.minute_of_day, r.open, r.close) for r in kept.collect()) == [("bj", 900, 1.5, 1.25), ("sz", 571, 1.5, 1.25)]
    assert [r.issue_type for r in issues.collect()] == ["invalid_time"]
    ex = tmp_path / "ex"
    ex.mkdir()
    (ex / "29#IFL0.day").write_bytes(struct.pack("<IffffIIf", 20240105, 1, 2, 0.5, 1.5, struct.unpack("<I", struct.pack("<f", 8.5))[0], 12, 1.25))
    row = ranges.record_rows(spark, str(ex), "ex_day").collect()[0]
    assert (row.market, row.symbol, row.price, row.position, row.settlement) == ("29", "IFL0", 8.5, 12, 1.25)
    other = tmp_path / "gp"
    other.mkdir()
    (other / "gpsh600000.dat").write_bytes(struct.pack("<BIff", 3, 20240105, 1.5, 2.5) + struct.pack("<BIff", 3, 20240105, 9, 9) + b"x")
    kept, issues = ranges.checked_rows(spark, str(other), "metric")
    assert [(r.symbol, r.metric_type, r.value1) for r in kept.collect()] == [("600000", 3, 1.5)] and sorted(r.issue_type for r in issues.collect()) == ["duplicate_logical_key", "incomplete_trailing_bytes"]
    capital = tmp_path / "gbbq"
    capital.write_bytes(struct.pack("<I", 3) + struct.pack("<B7sIB4f", 1, b"600000", 20240105, 1, 1, 2, 3, 4) + struct.pack("<B7sIB4f", 7, b"000001", 20240105, 5, 1, 2, 3, 4))
    kept, issues = ranges.checked_rows(spark, str(capital), "capital")
    assert [(r.market, r.symbol, r.a) for r in kept.collect()] == [("sh", "600000", 1.0)]
    assert sorted((r.row_offset, r.issue_type) for r in issues.collect()) == [(1, "unsupported_market"), (2, "incomplete_trailing_bytes")]
    _, whole = records.capital_changes(records.files(spark, str(tmp_path), "gbbq"))
    assert sorted((r.row_offset, r.issue_type) for r in whole.collect()) == [(1, "unsupported_market"), (2, "incomplete_trailing_bytes")]


@pytest.mark.parametrize("path", ["a/sh600000.day", "x\\SZ_000001.lc5", "gpsh600000.dat", "920001.day", "bj#430001", "none"])
def test_places_of_paths(spark, path):
    from quotemill.functions.text import market_and_symbol

    row = spark.createDataFrame([(path,)], "p string").select(market_and_symbol(F.col("p")).alias("k")).first().k
    if row.symbol:
        assert ranges.place_of(path) == (row.market, row.symbol)
    else:
        assert ranges.place_of(path)[1] == ""
