"""The import life cycle on a small table, and two checks that go with it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.plans import imports, ops
from quotemill.sources import records

D = dt.date
STARTED = dt.datetime(2024, 1, 9, 12)
SCHEMA = "market string, symbol string, trade_date date, close double"


def test_import_and_reimport(spark, tmp_path):
    data = imports.Dataset("bars_1d", str(tmp_path / "bars"), ("market", "symbol", "trade_date"), "trade_date")
    none = spark.createDataFrame([], "source_path string, row_offset long, issue_type string")
    rows = spark.createDataFrame([("sz", "1", D(2023, 12, 29), 1.0), ("sz", "1", D(2024, 1, 2), 2.0)], SCHEMA)
    place = str(tmp_path / "ops")
    assert imports.run_import(rows, none, data, place, "r0", 0, STARTED, dry_run=True)["status"] == "success" and not (tmp_path / "bars").exists()
    assert imports.run_import(rows, none, data, place, "r1", 1, STARTED)["status"] == "success"
    fixed = spark.createDataFrame([("sz", "1", D(2024, 1, 2), 9.0), ("sz", "2", D(2024, 1, 3), None)], SCHEMA)
    issues = spark.createDataFrame([("f", 3, "duplicate_logical_key"), ("f", 4, "conflicting_logical_key")], none.schema)
    assert imports.run_import(fixed, issues, data, place, "r2", 2, STARTED) == {"run_id": "r2", "rows": 2, "issues": 2, "status": "degraded"}
    assert imports.run_import(rows.limit(0), none, data, place, "r3", 3, STARTED, errors_fail=True)["status"] == "failed"
    found = imports.read_facts(spark, data).orderBy("symbol", "trade_date").collect()
    assert [(r.symbol, r.trade_date, r.close) for r in found] == [("1", D(2023, 12, 29), 1.0), ("1", D(2024, 1, 2), 9.0), ("2", D(2024, 1, 3), None)]
    year = imports.read_facts(spark, data, "2024-01-01", "2024-12-31")
    assert year.count() == 2 and "_part" in year._jdf.queryExecution().executedPlan().toString()
    mark = imports.watermarks(spark, place).collect()
    assert [(r.dataset, r.min_time, r.max_time, r.run_id) for r in mark] == [("bars_1d", D(2024, 1, 2), D(2024, 1, 3), "r2")]
    assert sorted((r.run_id, r.status) for r in spark.read.parquet(f"{place}/runs").collect()) == [("r1", "success"), ("r2", "degraded"), ("r3", "failed")]
    assert sorted((r.severity, r.issue_type) for r in spark.read.parquet(f"{place}/issues").collect()) == [("error", "conflicting_logical_key"), ("error", "zero_valid_rows"), ("warning", "duplicate_logical_key")]


def test_failed_writes_are_recorded(spark, tmp_path):
    (tmp_path / "bars").write_text("a file in the way")
    data = imports.Dataset("bars_1d", str(tmp_path / "bars"), ("market", "symbol", "trade_date"), "trade_date", monthly=True)
    rows = spark.createDataFrame([("sz", "1", D(2024, 1, 2), 2.0)], SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        imports.run_import(rows, spark.createDataFrame([], "k string, issue_type string"), data, str(tmp_path / "ops"), "r1", 1, STARTED)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "ops/runs")).collect()] == ["failed"]


def test_breadth(spark):
    names = ["up_count", "down_count", "flat_count", "unchanged_or_suspended_count", "up_gt_3_count", "up_gt_5_count", "up_gt_7_count", "down_gt_3_count", "down_gt_5_count", "down_gt_7_count", "total_count"]
    rows = [(5, 4, 1, None, 3, 2, 1, None, None, None, 10), (5, 4, 2, 0, 3, 2, 1, None, None, None, 10), (5, 4, 1, None, 3, 4, 1, None, None, None, 10)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    assert [r.x for r in frame.select(ops.breadth_issue(F.struct(*names)).alias("x")).collect()] == [None, "counts_exceed_total", "up_gt_5_count_exceeds"]


def test_custom_blocks(spark):
    cfg = "我的".encode("gb18030").ljust(50, b"\0") + b"WD".ljust(70, b"\0") + b"\0" * 120
    rows = spark.createDataFrame([("/b/blocknew.cfg", bytearray(cfg)), ("/b/WD.blk", bytearray(b"1600000\r\n0000001\r\n\r\n1600000\r\nodd")), ("/b/other.blk", bytearray(b"1600000"))], "source_path string, content binary")
    out = sorted((r.block_name, r.block_id, r.member_order, r.market, r.symbol) for r in records.custom_blocks(rows).collect())
    assert out == [("我的", "WD", 0, "sh", "600000"), ("我的", "WD", 1, "sz", "000001")]


def test_ranges_and_pages(spark):
    from quotemill.operators import ordering
    from quotemill.plans import params

    rows = spark.createDataFrame([(dt.datetime(2024, 1, d, 12),) for d in (1, 2, 3)], "t timestamp_ntz")
    kept, counts = imports.in_range(rows, "t", "2024-01-02", "2024-01-02")
    assert kept.count() == 1 and tuple(counts.first()) == (1, 2)
    pages = spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 2, 5), ("a", 3, 0, 1)], "k string, n int, first int, last int")
    assert [r.n for r in ordering.stalled_pages(pages, ["k"], "n", "first", "last").collect()] == [2]
    parts = spark.createDataFrame([("a", 2, 3), ("a", 1, 3), ("b", 2, 3), ("c", 1, 1), ("c", 0, 2)], "k string, n int, total int")
    assert sorted(r.k for r in ordering.incomplete_catalogues(parts, ["k"], "n", "total").collect()) == ["b", "c"]
    assert [ordering.clamped(n) for n in (0, -1, 7, 999)] == [20, 20, 7, 200]
    today = D(2024, 6, 1)
    assert params.ProviderQuery(" 2015-01-01", "2024-06-01").checked(today).since == "2015-01-01"
    for wrong in (("1989-01-01", "1989-02-01"), ("2014-01-01", "2024-01-01"), ("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-06-02")):
        with pytest.raises(params.InvalidQueryError):
            params.ProviderQuery(*wrong).checked(today)
    with pytest.raises(params.InvalidQueryError):
        params.ProviderQuery("2024-01-01", "2024-01-02", "qfq").checked(today)


def test_archived_minutes_and_servers(spark):
    import io
    import struct
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("vipdoc/sh/minline/sh600000.lc1", struct.pack("<HHfffffII", 20 * 2048 + 105, 571, 1.5, 2.0, 1.0, 1.25, 9.0, 3, 0))
    files = records.as_files(records.entries(spark.createDataFrame([("/x/v.zip", bytearray(out.getvalue()))], "source_path string, content binary"), (".lc1",)))
    assert [(r.market, r.symbol, r.minute_of_day) for r in records.minute_bars(files)[0].collect()] == [("sh", "600000", 571)]
    probes = spark.createDataFrame([("g", "a", 9, True), ("g", "b", 1, False), ("g", "c", 9, True)], "g string, server string, latency_ms int, ok boolean")
    assert [(r.server, r.latency_ms) for r in ops.fastest(probes, ["g"]).collect()] == [("a", 9)]


def test_shared_folder_must_be_named_off_one_machine():
    from types import SimpleNamespace

    from quotemill.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: "hdfs://x/y/" if key == "spark.checkpoint.dir" else other))
    assert shared_dir(named) == "hdfs://x/y"


def test_large_partitions_are_written_by_many_tasks(spark, tmp_path):
    data = imports.Dataset("x", str(tmp_path / "x"), ("k",), "d")
    rows = spark.range(400_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.lit("2023-01-01").cast("date")).otherwise(F.lit("2024-01-01").cast("date")).alias("d"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        imports.write_facts(rows, data, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "x" / "_part=2024").glob("*.parquet"))) > 2
    assert imports.read_facts(spark, data).count() == 400_000


def test_edits_of_blocks(spark):
    row = spark.createDataFrame([(["1", "2", "3"],)], "m array<string>")
    of = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert row.select(ops.edited(F.col("m"), of("2"), of("4", "1")).alias("x")).first().x == ["1", "3", "4"]
    assert row.select(ops.edited(F.col("m"), of(), of(), of("9", "9")).alias("x")).first().x == ["9"]
    with pytest.raises(Exception, match="some members"):
        row.select(ops.edited(F.col("m"), of("1", "2", "3"), of()).alias("x")).collect()
