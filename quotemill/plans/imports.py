"""The import life cycle: facts, then issues, then the watermark, then the run record; and the newest-version read of what was written."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.dates import clock_of_text
from quotemill.operators.latest import first_with_issues, newest
from quotemill.plans.bars import between
from quotemill.plans.ops import issue_id, severity

COMMIT = "_commit_seq"
ROWS_PER_FILE = 5_000_000
RUNS = "run_id string, dataset string, started_at timestamp, status string, rows_written long, rows_skipped long, issue_count long, error string"


@dataclass(frozen=True)
class Dataset:
    """A fact table: its folder, logical key, date column, and the expression of its partition column."""

    name: str
    path: str
    key: tuple[str, ...]
    date: str
    monthly: bool = False

    @property
    def partition(self) -> F.Column:
        return F.date_format(self.date, "yyyyMM") if self.monthly else F.year(self.date).cast("string")


def write_facts(rows: DataFrame, dataset: Dataset, commit: int) -> dict:
    """Appends rows as one commit, sorted by partition and key within each file, so that files prune by date and by key. Returns row_count, min_time and max_time.

    One shuffle brings a partition's rows together; adaptive execution splits large partitions among tasks and files and lets small
    ones share a task. The rows are computed once: they are counted and bounded by the tasks that write them, above the shuffle, where a repeated task
    counts once.
    """
    placed = rows.withColumn(COMMIT, F.lit(commit).cast("long")).withColumn("_part", dataset.partition)
    placed = placed.hint("rebalance", "_part").sortWithinPartitions("_part", *dataset.key)
    seen = Observation()
    placed = placed.observe(seen, F.count(F.lit(1)).alias("row_count"), F.min(dataset.date).alias("min_time"), F.max(dataset.date).alias("max_time"))
    placed.write.mode("append").partitionBy("_part").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(dataset.path)
    return seen.get


def read_facts(spark: SparkSession, dataset: Dataset, since: str = "", until: str = "") -> DataFrame:
    """The newest row of every key, reading only the partitions that the days can be in."""
    rows = spark.read.option("basePath", dataset.path).parquet(dataset.path).withColumn("_part", F.col("_part").cast("string"))
    form = "%Y%m" if dataset.monthly else "%Y"
    if since:
        rows = rows.filter((F.col("_part") >= dt.date.fromisoformat(since).strftime(form)) & (F.col(dataset.date) >= F.lit(since).cast("date")))
    if until:
        rows = rows.filter((F.col("_part") <= dt.date.fromisoformat(until).strftime(form)) & (F.col(dataset.date) <= F.lit(until).cast("date")))
    return newest(rows.drop("_part"), dataset.key, COMMIT)


def in_range(rows: DataFrame, time: str, since: str = "", until: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows in the range, one row with how many are in it and how many were skipped). A date as the upper bound holds its whole day."""
    inside = between(time, since, until, dict(rows.dtypes)[time] == "date")
    return rows.filter(inside), rows.agg(F.count_if(inside).alias("rows_read"), F.count_if(~inside).alias("rows_skipped"))


def issue_rows(issues: DataFrame, run_id: str, dataset: str, key: Sequence[str]) -> DataFrame:
    """Issues in the form of the operations table."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    kind = F.col("issue_type")
    return issues.select(issue_id(F.lit(run_id), kind, text).alias("issue_id"), F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), severity(kind).alias("severity"), kind.alias("issue_type"), text.alias("logical_key"))


def run_import(rows: DataFrame, issues: DataFrame, dataset: Dataset, ops_path: str, run_id: str, commit: int, started: dt.datetime, dry_run: bool = False, errors_fail: bool = False, skipping: Sequence[str] = ()) -> dict:
    """Writes an import and its records, and returns its summary. There is no transaction: an order that a repeated run repairs.

    No valid row at all is an issue of its own. With issues the run is degraded, or failed where errors fail; a failing write is
    recorded as failed and raised. A dry run only counts. Facts and issues are counted as they are written; nothing is read back from the table, so a
    run's cost is that of its own rows, however large the table is. Skipped rows are the issues, or those of the given types.
    """
    spark = rows.sparkSession
    found = issue_rows(issues, run_id, dataset.name, [c for c in issues.columns if c != "issue_type"]).withColumn("observed_at", F.lit(started))
    number, bad, skipped, counted, error = 0, 0, 0, 0, None
    kind = F.col("issue_type")
    count_issues = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(kind.isin(*skipping) if skipping else kind.isNotNull()).alias("skipped")]
    try:
        if dry_run:
            counted = rows.count()
            number, bad, skipped = found.agg(*count_issues).first()
        else:
            facts = write_facts(rows, dataset, commit)
            counted, seen = facts["row_count"], Observation()
            found.observe(seen, *count_issues).write.mode("append").parquet(f"{ops_path}/issues")
            number, bad, skipped = (seen.get[k] for k in ("n", "errors", "skipped"))
        if not counted:
            none = issue_rows(spark.range(1).select(F.lit(dataset.name).alias("k"), F.lit("zero_valid_rows").alias("issue_type")), run_id, dataset.name, ["k"])
            if not dry_run:
                none.withColumn("observed_at", F.lit(started)).write.mode("append").parquet(f"{ops_path}/issues")
            number, bad = number + 1, bad + 1
        status = "failed" if bad and errors_fail else "degraded" if number else "success"
        if counted and not dry_run:
            time = rows.schema[dataset.date].dataType.simpleString()
            mark = (facts["min_time"], facts["max_time"], counted, dataset.name, status, run_id, commit)
            spark.createDataFrame([mark], f"min_time {time}, max_time {time}, row_count long, dataset string, status string, run_id string, {COMMIT} long").write.mode("append").parquet(f"{ops_path}/watermarks/{time}")
    except Exception as e:
        status, error = "failed", str(e)[:500]
        raise
    finally:
        if not dry_run:
            record = (run_id, dataset.name, started, status, counted, skipped, number, error)
            spark.createDataFrame([record], RUNS).write.mode("append").parquet(f"{ops_path}/runs")
    return {"run_id": run_id, "rows": counted, "issues": number, "status": status}


#: Greatest index of a point in its day.
LAST_POINT = 65_535


def checked_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, issues) of intraday points: market, symbol, trade_date, point_time (HH:MM), point_index, price, point_volume, source_path, row_offset.

    A time that is none, a negative volume or an index beyond the day's last is an issue; a negative or absent index is the row's place. Of rows of one time
    the first stays; later ones that equal it go silently, others are conflicts.
    """
    key = ["market", "symbol", "trade_date", "point_time"]
    index = F.when(F.col("point_index") >= 0, F.col("point_index")).otherwise(F.col("row_offset")).cast("long")
    timed = points.withColumns({"point_time": clock_of_text(F.col("point_time")), "point_index": index})
    wrong = F.when(F.col("point_time").isNull() | F.col("trade_date").isNull(), "invalid_point_time").when(F.col("point_volume") < 0, "invalid_volume").when(F.col("point_index") > LAST_POINT, "invalid_point_index")
    marked = timed.withColumn("_wrong", wrong)
    invalid = marked.filter("_wrong is not null").select("source_path", "row_offset", F.col("_wrong").alias("issue_type"))
    placed = marked.filter("_wrong is null").select(*key, "point_index", "price", "point_volume", F.struct("source_path", "row_offset").alias("_order"))
    first, repeated = first_with_issues(placed, key, "_order")
    conflicts = repeated.filter("issue_type = 'conflicting_logical_key'").select("_order.source_path", "_order.row_offset", "issue_type")
    return first.select(*key, "point_index", "price", "point_volume", "_order.*"), invalid.unionByName(conflicts)


def watermarks(spark: SparkSession, ops_path: str) -> DataFrame:
    """The newest watermark of every dataset whose times are dates; those of other times lie beside them."""
    return newest(spark.read.parquet(f"{ops_path}/watermarks/date"), ["dataset"], COMMIT)
