"""Segmented running values against plain windows, and how a hot key spreads."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotemill.operators import segments


def table(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), t, None if r.random() < 0.3 else r.randrange(-3, 9), "x") for t in range(n)]
    return spark.createDataFrame(rows, "k string, t int, v int, extra string").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_previous_equals_a_window(spark):
    rows = table(spark)
    before = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    for width in (1, 7, 50, 1000):
        for valid in (F.col("v") > 0, F.lit(True)):
            held = F.when(valid, F.struct(F.col("v").alias("v")))
            want = rows.withColumn("p", F.last(held, ignorenulls=True).over(before)["v"])
            got = segments.previous(rows, F.col("v"), valid, ["k"], ["t"], F.floor(F.col("t") / width), "p")
            assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert segments.previous(rows.limit(0), F.col("v"), F.lit(True), ["k"], ["t"], F.col("t"), "p").count() == 0


def test_running_sum_equals_a_window(spark):
    rows = table(spark).withColumn("t", F.floor(F.col("t") / 3))  # times that several rows share
    upto = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for width in (1, 5, 60):
        got = segments.running_sum(rows, F.col("v"), ["k"], ["t"], F.floor(F.col("t") / width), "s")
        assert rows_of(got) == rows_of(rows.withColumn("s", F.sum("v").over(upto)))


def test_a_hot_key_spreads_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("only").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = segments.previous(rows, F.col("v"), F.col("v") > 0, ["k"], ["t"], F.floor(F.col("t") / 500), "p")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 10_000


def test_filters_on_the_key_reach_the_scan(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    found = segments.previous(spark.read.parquet(str(tmp_path / "t")), F.col("v"), F.lit(True), ["k"], ["t"], F.floor(F.col("t") / 50), "p").filter("k = 'a'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k,a)") >= 2
