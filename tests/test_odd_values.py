"""Queries against their SQL twins over small tables that hold what the test tables rarely do: prices of zero, keys of more digits, many rows of one group."""

import datetime as dt

import pytest

duckdb = pytest.importorskip("duckdb")

from quotemill.plans import frame_queries, function_queries, guards, registry, source_queries  # noqa: E402, F401 - they register their queries
from quotemill.session import ship  # noqa: E402


def same_as_sql(spark, folder, name, **tables):
    """Whether a query gives the rows of its twin over tables of (rows, schema) written below the folder."""
    ship(spark)
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(folder))
    names = found.columns
    mine = sorted(map(repr, (tuple(r) for r in found.collect())))
    theirs = sorted(map(repr, db.execute(f"select {', '.join(names)} from ({registry.ORACLE_SQL[name]})").fetchall()))
    assert theirs
    return mine == theirs


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(*values, kind="error", user=7):
    """A user's events, a minute apart, of a day."""
    return [(k, dt.datetime(2024, 1, 9, 10, k), user, kind, v, "{}") for k, v in enumerate(values)], EVENTS


def test_tick_chart_that_begins_with_zero(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "wire_tick_chart", events=events(0.0, 0.0, 3.25, 5.5, 0.0, 2.0))


def test_seats_that_sell_nothing(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "seat_texts", events=events(0.0, 4.5, 0.0, 0.0, 1.25))


def test_seats_that_buy_nothing(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "seat_texts", events=events(0.0, 4.5, 0.0, kind="click"))


@pytest.mark.parametrize("name", ["index_page_issues", "index_page_bars"])
def test_index_pages_of_prices_of_zero(spark, tmp_path, name):
    """A low of zero is not among the bars that are made impossible, nor is a day of zeros alone; the seventh is."""
    days = [(k, dt.datetime(2024, 1, day, 10), 1, "view", v, "{}") for k, (day, v) in enumerate([(1, 1.0), (7, 2.0), (7, 3.0), (9, 0.0), (9, 5.25), (10, 0.0), (30, 2.0)])]
    assert same_as_sql(spark, tmp_path, name, events=(days, EVENTS))


CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


def test_aliases_of_keys_of_more_than_six_digits(spark, tmp_path):
    """Part 1234567 is no part of security 123456."""
    customers = [(k, f"Customer#{k:09d}", k % 25, "BUILDING") for k in (7, 123456)]
    parts = [(7, "a bolt", "Brand#1"), (123456, "a ring", "Brand#2"), (1234567, "cold anvil", "Brand#3")]
    assert same_as_sql(spark, tmp_path, "best_aliases", customer=(customers, CUSTOMERS), part=(parts, "p_partkey long, p_name string, p_brand string"))


def test_a_guard_reads_a_table_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(guards, "MOST_EVENTS", 1)
    rows = [(k, dt.datetime(2024, 1, 9, 10), k, "error", 1.0, "{}") for k in range(3)]
    assert same_as_sql(spark, tmp_path, "guard_current_events", events=(rows, EVENTS))


@pytest.mark.parametrize("name", ["src_report_files", "src_report_archives"])
def test_report_files_of_more_symbols_than_a_file_counts(spark, tmp_path, name):
    rows = [(k, dt.datetime(2024, 1, 9, 10), k, "error", 1.0, "{}") for k in range(65_540)]
    assert same_as_sql(spark, tmp_path, name, events=(rows, EVENTS))


@pytest.mark.parametrize("name", ["wire_board_members", "wire_instruments"])
def test_frames_of_keys_that_share_six_digits(spark, tmp_path, name):
    """A hundred keys of eight digits have one symbol, so a block of a hundred symbols is no frame's bound."""
    customers = [(k, f"Customer#{k:09d}", k % 25, "BUILDING") for k in (*range(40), *range(12_345_600, 12_346_700))]
    assert same_as_sql(spark, tmp_path, name, customer=(customers, CUSTOMERS))
