"""Trigram index, Merkle snapshots, rank directory, factor intervals, refreshes: results against plain ways, and what is read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotemill.operators import merkle, ranks, trigrams
from quotemill.plans import bars, derive, imports, intervals, refresh
from tests.test_market import actions, day_bars

D = dt.date


def files_read(spark, df):
    """How many files the scans of a query read, by their metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        node = node.plan() if "QueryStage" in node.nodeName() else node
        found = node.metrics().get("numFiles")
        total += found.get().value() if found.isDefined() else 0
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


TEXTS = ["abc", "abcabc", "xabcx", "ab", "", None, "a%b_c", "日本語のテキスト", "aaa", "aaaa", "the cat sat", "cat the", "\\d+ 'q'"]


def test_search_equals_a_scan(spark, tmp_path):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "id int, t string, trigram string")
    path = str(tmp_path / "index")
    trigrams.build(rows, ["id"], F.col("t"), path)
    for keyword in ("abc", "bca", "a", "", "%b_", "本語の", "aaa", "aaaa", "cat", "t s", "nothing", "\\d+ '", "ab"):
        assert rows_of(trigrams.search(spark, path, keyword)) == rows_of(rows.filter(F.contains("t", F.lit(keyword)))), keyword
    trigrams.build(rows.limit(0), ["id"], F.col("t"), str(tmp_path / "none"))


def test_search_reads_only_the_postings_asked_for(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat(F.lit("item number "), F.md5(F.col("id").cast("string").cast("binary"))).alias("t"))
    path = str(tmp_path / "index")
    trigrams.build(rows, ["id"], F.col("t"), path)
    keyword = rows.filter("id = 77").first().t[12:24]
    found, most = trigrams.candidates(spark, path, keyword)
    assert 1 <= files_read(spark, found) <= trigrams.MOST and most < 200
    assert [r.id for r in trigrams.search(spark, path, keyword).collect()] == [77]
    plan = trigrams.search(spark, path, keyword)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()  # the rows' folders follow from the candidates
    assert trigrams.search(spark, path, "item number").count() == 3000


def test_merkle_difference(spark, tmp_path):
    r = random.Random(4)
    rows = [(k % 900, r.choice("ab"), None if k % 50 == 0 else k % 7) for k in range(1000)]  # some keys twice
    old = spark.createDataFrame(rows, "k int, v string, n int")
    new = spark.createDataFrame([x for x in rows if x[0] not in (3, 400)] + [(3, "new", 1), (5000, "a", None), rows[0]], old.schema)
    paths = [str(tmp_path / p) for p in ("old", "new", "same")]
    for rows_, path in zip((old, new, old.repartition(5)), paths, strict=True):
        merkle.snapshot(rows_, ["k"], path, 2)
    want = new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
    assert rows_of(merkle.difference(spark, *paths[:2])) == rows_of(want)
    assert merkle.root(spark, paths[0]) == merkle.root(spark, paths[2]) != merkle.root(spark, paths[1])
    assert merkle.differing_leaves(spark, paths[0], paths[2]) == [] and merkle.difference(spark, paths[0], paths[2]).count() == 0
    leaves = merkle.differing_leaves(spark, *paths[:2])
    assert 1 <= len(leaves) <= 4
    assert merkle.ranges(spark, paths[0], leaves).count() < 1000 * 4 / 100 and files_read(spark, merkle.ranges(spark, paths[0], leaves)) <= 4
    merkle.snapshot(old.limit(0), ["k"], str(tmp_path / "none"), 2)
    assert rows_of(merkle.difference(spark, str(tmp_path / "none"), paths[0])) == rows_of(old.withColumn("change", F.lit("added")))
    assert merkle.root(spark, str(tmp_path / "none")) is None and merkle.differing_leaves(spark, str(tmp_path / "none"), str(tmp_path / "none")) == []


def test_pages_by_rank(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.lit("x").alias("rank_of"))
    path = str(tmp_path / "ranks")
    assert ranks.build(rows, [F.desc("a")], path, 300) == 5000 == ranks.total(spark, path)
    want = [r.a for r in rows.orderBy(F.desc("a")).collect()]
    for limit, offset in ((10, 0), (700, 2900), (50, 4980), (5, 6000), (0, 3)):
        got = ranks.page(spark, path, limit, offset).collect()
        assert [r.a for r in got] == want[offset : offset + limit] and [r["rank"] for r in got] == list(range(offset, min(5000, offset + limit)))[: len(got)]
    assert files_read(spark, ranks.page(spark, path, 10, 4000)) <= 2 < files_read(spark, spark.read.parquet(f"{path}/rows"))
    assert ranks.build(rows.limit(0), ["a"], str(tmp_path / "none")) == 0 and ranks.total(spark, str(tmp_path / "none")) == 0


def test_intervals_equal_daily_factors(spark, tmp_path):
    rows = day_bars(spark, [10, 11, 12, 13, 14, 15])
    events = actions(spark, [(D(2024, 6, 3), 1, 1.0, 0.0, 2.0, 0.0), (D(2024, 6, 5), 1, 0.5, 0.0, 0.0, 0.0)])
    from quotemill.operators.timeseries import adjustment_factors

    daily = adjustment_factors(rows, events)
    own = intervals.bucketed(rows, str(tmp_path / "bars"), ["trade_date"], 4)
    for adjust in ("qfq", "hfq"):
        found = intervals.adjusted(own, intervals.factor_intervals(rows, events), adjust)
        want = {r.trade_date: r[f"{adjust}_factor"] for r in daily.collect()}
        got = {r.trade_date: r.factor for r in found.collect()}
        assert got == pytest.approx(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("Bucketed: true")
        assert "Exchange" not in plan[plan.index("SortMergeJoin") : scan].split("SortMergeJoin")[-1]  # none between the join and the bars
    plain = bars.adjusted(own, daily, "qfq").select("trade_date", F.round("close", 9)).collect()
    assert sorted(plain) == sorted(intervals.adjusted(own, intervals.factor_intervals(rows, events), "qfq").select("trade_date", F.round("close", 9)).collect())


SCHEMA = "market string, symbol string, trade_date date, close double"


def test_refresh_rewrites_only_what_changed(spark, tmp_path):
    key = ("market", "symbol", "trade_date")
    facts, target = (imports.Dataset(n, str(tmp_path / n), key, "trade_date") for n in ("facts", "derived"))
    state = str(tmp_path / "state")
    r = random.Random(2)
    rows = [("sz", s, D(y, m, 5), r.choice([0.0, 1.0, 2.0, 4.0])) for s in ("1", "2", "3") for y in (2020, 2021, 2022, 2023) for m in range(1, 13)]
    imports.write_facts(spark.createDataFrame(rows, SCHEMA), facts, 1)
    assert refresh.refresh_daily(spark, facts, target, state) == 1

    def files():
        return {str(f.relative_to(tmp_path)) for f in (tmp_path / "derived").rglob("*.parquet")}

    def check():
        want = derive.daily_derived(imports.read_facts(spark, facts))
        got = spark.read.parquet(target.path)
        assert rows_of(got.select(*want.columns)) == rows_of(want)

    check()
    before = files()
    assert refresh.refresh_daily(spark, facts, target, state) == 1 and files() == before  # nothing new
    imports.write_facts(spark.createDataFrame([("sz", "1", D(2021, 6, 5), 9.0)], SCHEMA), facts, 2)
    assert refresh.refresh_daily(spark, facts, target, state) == 2
    check()
    assert {f.split("/")[1] for f in files() ^ before} == {"_part=2021"}
    before = files()
    amended = [("sz", "2", D(2021, 12, 5), 3.0), *[("sz", "2", D(2022, m, 5), 0.0) for m in range(1, 13)], ("sz", "4", D(2024, 1, 2), 1.0)]
    imports.write_facts(spark.createDataFrame(amended, SCHEMA), facts, 3)
    refresh.refresh_daily(spark, facts, target, state)
    check()  # the closes of a year fall away, so the next year's look-back passes it
    assert {f.split("/")[1] for f in files() ^ before} <= {"_part=2021", "_part=2022", "_part=2023", "_part=2024"}


def test_points(spark):
    rows = [("sz", "1", D(2024, 1, 2), t, i, p, v, "f", n) for n, (t, i, p, v) in enumerate([("09:31", 0, 1.0, 5), ("09:31", 0, 1.0, 5), ("09:31:00", 0, 2.0, 5), ("9:99", 1, 1.0, 5), ("09:32", 1, 1.0, -1), ("09:33", 70_000, 1.0, 1), ("09:34", -1, 1.0, 1)])]
    points, issues = imports.checked_points(spark.createDataFrame(rows, "market string, symbol string, trade_date date, point_time string, point_index int, price double, point_volume long, source_path string, row_offset long"))
    assert sorted((r.point_time, r.point_index, r.price) for r in points.collect()) == [("09:31", 0, 1.0), ("09:34", 6, 1.0)]
    assert sorted((r.row_offset, r.issue_type) for r in issues.collect()) == [(2, "conflicting_logical_key"), (3, "invalid_point_time"), (4, "invalid_volume"), (5, "invalid_point_index")]
