"""Operational frames: issues, watermarks, task runs, sweep plans, block edits, content addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Issue types that are errors; all others are warnings.
ERRORS = ("conflicting_logical_key", "zero_valid_rows")


def severity(issue_type: Column) -> Column:
    return F.when(issue_type.isin(*ERRORS), "error").otherwise("warning")


def issue_id(run: Column, issue_type: Column, key: Column, nanos: Column | None = None) -> Column:
    return F.concat_ws(":", run, issue_type, key, *([nanos.cast("string")] if nanos is not None else []))


def issue_stats(issues: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent (dataset, severity, issue_type)."""
    counted = issues.groupBy("dataset", "severity", "issue_type").agg(F.count("*").alias("issue_count"))
    return counted.orderBy(F.desc("issue_count"), "dataset", "severity", "issue_type").limit(k)


def bounds(rows: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest time, and the number of rows, per group or of all: the watermark of an import."""
    return rows.groupBy(*by).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.count("*").alias("row_count"))


def import_counters(rows: DataFrame, valid: Column, by: str) -> DataFrame:
    """Rows written and skipped per input."""
    return rows.groupBy(by).agg(F.count_if(valid).alias("rows_written"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("rows_skipped"))


def run_status(issues: Column, failing: bool = False) -> Column:
    """Status of an import with so many error issues and issues (a struct): degraded with any, failed where errors fail."""
    bad = issues["errors"] > 0
    return F.when(bad & F.lit(failing), "failed").when(issues["issues"] > 0, "degraded").otherwise("success")


def latest_runs(runs: DataFrame, n: int, order: str) -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(n)


def sweep_batches(symbols: DataFrame, size: int) -> DataFrame:
    """batch_no and the symbols of every batch, markets apart, in order.

    Positions come from ranges: a sort by key over all partitions numbers its rows locally and adds what the partitions before
    hold, so no task sees all rows.
    """
    placed = symbols.select("market", "symbol").distinct().repartitionByRange("market", "symbol").sortWithinPartitions("market", "symbol")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    within = placed.withColumn("_row", F.row_number().over(Window.partitionBy("market", "_part").orderBy("_at")))
    sizes = placed.groupBy("market", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("market").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = within.join(before.select("market", "_part", "_before"), ["market", "_part"])
    batch = F.floor((F.col("_before") + F.col("_row") - 1) / size) + 1
    return numbered.groupBy("market", batch.cast("long").alias("batch_no")).agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def resume_pending(batches: DataFrame, states: DataFrame) -> DataFrame:
    """Batches whose newest state is not succeeded."""
    done = states.filter("status = 'succeeded'").select("market", "batch_no").distinct()
    return batches.join(done, ["market", "batch_no"], "left_anti")


def sweep_totals(batches: DataFrame) -> DataFrame:
    status = F.col("status")
    return batches.groupBy("run_id").agg(F.count_if(status == "succeeded").alias("succeeded"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "skipped").alias("skipped"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))


def content_address(members: DataFrame, by: Sequence[str], line: Column) -> DataFrame:
    """SHA-256 of each group's sorted lines' digests, one to a line: the same for any order of its rows.

    The definition asks for all of a group's digests in one value: 65 bytes a member, so groups of up to some millions of members.
    """
    return members.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(line.cast("binary"), 256))), "\n").cast("binary"), 256).alias("content_id"))


def block_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that a snapshot of memberships gained or lost."""
    gained = new.select(*key).exceptAll(old.select(*key)).withColumn("change", F.lit("added"))
    return gained.unionByName(old.select(*key).exceptAll(new.select(*key)).withColumn("change", F.lit("removed")))


def edited(members: Column, remove: Column, add: Column, replace: Column | None = None) -> Column:
    """A block's symbols after an edit: replaced, or without those removed and with those added, in order, each once. An edit that leaves none is an error."""
    found = F.array_distinct(replace) if replace is not None else F.array_distinct(F.concat(F.array_except(members, remove), add))
    return F.when(F.size(found) == 0, F.raise_error(F.lit("an edit must leave a block some members"))).otherwise(found)


def count_mismatches(events: DataFrame, declared: DataFrame) -> DataFrame:
    """Days and event types whose number of events is not the declared one."""
    found = events.groupBy("trade_date", "event_type").agg(F.count("*").alias("found"))
    both = declared.join(found, ["trade_date", "event_type"], "full_outer")
    return both.select("trade_date", "event_type", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found")).filter("declared <> found")


def changed_facts(current: DataFrame, incoming: DataFrame, key: Sequence[str], enriched: Sequence[str]) -> DataFrame:
    """Incoming rows that an enrichment must reject: without a current row, or with another value in a column that it may not set."""
    facts = [c for c in current.columns if c not in key and c not in enriched]
    old, new = current.alias("old"), incoming.alias("new")
    joined = new.join(old, [F.col(f"new.{k}") == F.col(f"old.{k}") for k in key], "left")
    changed = F.lit(False)
    for c in facts:
        changed |= ~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    absent = F.col(f"old.{key[0]}").isNull()
    return joined.filter(absent | changed).select(*[F.col(f"new.{k}").alias(k) for k in key], F.when(absent, "missing").otherwise("changed").alias("reason"))


def whole_batches(rows: DataFrame, refused: DataFrame, batch: Sequence[str]) -> DataFrame:
    """The rows of batches of which nothing is refused: one bad row refuses its whole batch."""
    return rows.join(refused.select(*batch).distinct(), list(batch), "left_anti")


def keep_enrichment(current: DataFrame, incoming: DataFrame, key: Sequence[str], enriched: Sequence[str]) -> DataFrame:
    """Incoming rows with the enriched columns of current ones where they come without."""
    old = current.select(*key, *[F.col(c).alias(f"_old_{c}") for c in enriched])
    joined = incoming.join(old, list(key), "left")
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_old_{c}"), F.col(c)).alias(c) if c in enriched else F.col(c) for c in incoming.columns]
    return joined.select(*filled)


def reconciled_pools(pools: DataFrame) -> DataFrame:
    """Provider pools per stock and day with a close status: an open limit that is also in the closing pool resealed.

    pools has trade_date, symbol, pool (open_limit, limit_up, limit_down). A stock in both closing pools is an error.
    """
    own = Window.partitionBy("trade_date", "symbol")
    up, down = [F.max((F.col("pool") == p).cast("int")).over(own) for p in ("limit_up", "limit_down")]
    status = (
        F.when((up == 1) & (down == 1), F.raise_error(F.concat(F.lit("contradictory pools of "), F.col("symbol"))))
        .when(F.col("pool") == "limit_up", "sealed")
        .when(F.col("pool") == "limit_down", "limit_down")
        .when(up == 1, "broken_reseal")
        .otherwise("broken")
    )
    return pools.withColumn("close_status", status)


def expired(rows: DataFrame, column: str, months: int, today: Column) -> DataFrame:
    """Rows that a retention of so many months keeps."""
    return rows.filter(F.col(column) >= F.add_months(today, -months))


def breadth_issue(row: Column) -> Column:
    """Why a breadth row (a struct) cannot be: more movers than instruments, or a stricter threshold passed by more; else null."""
    some = F.lit(0)
    for c in ("up_count", "down_count", "flat_count", "unchanged_or_suspended_count"):
        some = some + F.coalesce(row[c], F.lit(0))
    wrong = F.when(some > row["total_count"], "counts_exceed_total")
    for side in ("up", "down"):
        for least, strict in ((f"{side}_count", f"{side}_gt_3_count"), (f"{side}_gt_3_count", f"{side}_gt_5_count"), (f"{side}_gt_5_count", f"{side}_gt_7_count")):
            wrong = wrong.when(row[strict] > row[least], f"{strict}_exceeds")
    return wrong


def latest_members(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """The members of every scope's newest snapshot, ties by id."""
    newest = snapshots.groupBy("scope").agg(F.max(F.struct("snapshot_time", "snapshot_id")).alias("s")).select("scope", "s.snapshot_id")
    return members.join(newest, ["scope", "snapshot_id"])


def fastest(probes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group the server of least latency among those that answered."""
    return probes.filter("ok").groupBy(*by).agg(F.min(F.struct("latency_ms", "server")).alias("b")).select(*by, "b.server", "b.latency_ms")


def named_codes(codes: DataFrame, quotes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The codes of a list with the names that quotes give them; codes without a quote, or with an empty name, go."""
    return quotes.filter(F.trim("name") != "").join(codes.select(*key).distinct(), list(key), "left_semi")


def board_members_quoted(members: DataFrame, quotes: DataFrame) -> DataFrame:
    """name, members, quoted: the size of every board of a catalogue (name, market, symbol) and how many of its members have quotes."""
    seen = quotes.select("market", "symbol").distinct().withColumn("_quoted", F.lit(1))
    rows = members.distinct().join(seen, ["market", "symbol"], "left")
    return rows.groupBy("name").agg(F.count("*").alias("members"), F.count("_quoted").alias("quoted"))
