"""Checked reads and runs: the current events that a write guard compares with, index bars of a verified symbol, and durable sweeps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.ordering import complete
from quotemill.sources.records import consistent

#: Most events of a day that a guard reads page by page.
MOST_EVENTS = 20_000


def current_events(events: DataFrame, day: str, paged: bool = True) -> DataFrame:
    """A day's events for a write guard: an error if a key is repeated or, of a paged read, if there are more than MOST_EVENTS; a table is read whole."""
    own = events.filter(F.col("trade_date") == F.lit(day).cast("date"))
    own = complete(own, MOST_EVENTS) if paged else own
    key = Window.partitionBy("market", "symbol", "event_type")
    name = F.concat_ws(":", "market", "symbol", "event_type")
    checked = F.when(F.count("*").over(key) == 1, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("repeated current event "), name)))
    return own.withColumn("symbol", checked)


#: Fixed symbols and names, of one market, of the indices whose bars a provider has; the index without stocks under warning has none.
INDEX_SYMBOLS = {"prev_limit_up_perf": ("880863", "昨日涨停"), "prev_ladder_perf": ("880812", "昨日连板"), "prev_limit_down_perf": ("880751", "昨日跌停")}
#: A day's bar counts from this time, in minutes, on.
CLOSED = 15 * 60 + 5


def index_symbol_issues(securities: DataFrame, codes: DataFrame) -> DataFrame:
    """index_code, issue: codes without a verified symbol, whose symbol is not listed, or is listed under another name."""
    known = F.create_map(*[F.lit(x) for c, (s, n) in INDEX_SYMBOLS.items() for x in (c, f"{s}:{n}")])
    wanted = codes.select("index_code", F.split(F.try_element_at(known, F.col("index_code")), ":").alias("w"))
    listed = securities.filter("market = 'sh'").select(F.col("symbol").alias("_symbol"), "name")
    both = wanted.join(listed, F.get("w", F.lit(0)) == F.col("_symbol"), "left")
    issue = F.when(F.col("w").isNull(), "no_verified_symbol").when(F.col("_symbol").isNull(), "symbol_not_listed").when(F.col("name") != F.get("w", F.lit(1)), "name_changed")
    return both.select("index_code", issue.alias("issue")).filter("issue is not null")


def index_bars(pages: DataFrame, since: str, until: str, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of pages read backwards: index_code, page_no from 0, trade_date, prices, volume, amount.

    Errors: a page that does not end before the one read earlier begins (pages_not_backwards), a repeated day, an impossible bar, a
    day not yet closed. A history that begins after since is a warning. Bars are those of the range without an error of their own.
    """
    code = ["index_code"]
    ends = pages.groupBy("index_code", "page_no").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    earlier = F.lag("first").over(Window.partitionBy(*code).orderBy("page_no"))
    stalled = ends.withColumn("earlier", earlier).filter("last >= earlier").select("index_code", F.col("last").alias("trade_date"), F.lit("pages_not_backwards").alias("issue_type"))
    inside = F.col("trade_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    closed = (F.col("trade_date") < F.lit(now.date())) | (F.lit(now.hour * 60 + now.minute) >= CLOSED)
    positive = consistent(pages) & (F.col("low") > 0) & (F.col("volume") >= 0) & (F.col("amount") >= 0) & (F.col("volume") < float("inf")) & (F.col("amount") < float("inf"))
    times = F.count("*").over(Window.partitionBy("index_code", "trade_date"))
    wrong = F.when(times > 1, "repeated_day").when(~inside, None).when(~closed, "day_not_closed").when(~F.coalesce(positive, F.lit(False)), "invalid_bar")
    marked = pages.withColumn("issue_type", wrong)
    late = pages.groupBy(*code).agg(F.min("trade_date").alias("trade_date")).filter(F.col("trade_date") > F.lit(since).cast("date")).withColumn("issue_type", F.lit("index_history_starts_late"))
    issues = stalled.unionByName(marked.filter("issue_type is not null").select("index_code", "trade_date", "issue_type").distinct()).unionByName(late.select("index_code", "trade_date", "issue_type"))
    bars = marked.filter(inside & F.col("issue_type").isNull()).select("index_code", "trade_date", "open", "high", "low", "close", F.round("volume").cast("long").alias("volume"), "amount")
    return bars, issues


#: Kinds of failures by words of an error's text, the first that it holds; others are of transport. Which of them another try may mend.
FAILURES = (("decode", "decode"), ("canceled", "cancelled"), ("deadline", "timeout"), ("timeout", "timeout"), ("no usable", "server_select"), ("pool", "server_select"), ("rate limit", "rate_limit"))
RECOVERABLE = ("transport", "timeout", "server_select", "rate_limit")


def failure_kind(error: Column) -> Column:
    """Empty without an error, else its kind."""
    kind = F.when(F.coalesce(error, F.lit("")) == "", "")
    for word, name in FAILURES:
        kind = kind.when(F.lower(error).contains(word), name)
    return kind.otherwise("transport")


def sweep_status(outcomes: DataFrame) -> DataFrame:
    """outcomes with status, failure and recoverable by their error, and the rows of a batch that succeeded."""
    kind = failure_kind(F.col("error"))
    status = F.when(kind == "", "succeeded").when(kind == "cancelled", "skipped").otherwise("failed")
    return outcomes.withColumns({"status": status, "failure": kind, "recoverable": kind.isin(*RECOVERABLE), "row_count": F.when(status == "succeeded", F.col("row_count")).otherwise(0)})


def sweep_states(outcomes: DataFrame, run_id: str, attempt: int) -> DataFrame:
    """State rows of a run's batches from their outcomes (market, batch_no, error, row_count): to be appended, the newest attempt counts."""
    return sweep_status(outcomes).select(F.lit(run_id).alias("run_id"), "market", "batch_no", F.lit(attempt).alias("attempt"), "status", "failure", "recoverable", "row_count")


def sweep_run(states: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per run: planned, succeeded, failed, skipped batches, rows, and its status.

    A run with skipped or missing batches was interrupted, one with failed ones completed with failures.
    """
    newest = states.groupBy("run_id", "market", "batch_no").agg(F.max_by(F.struct("status", "row_count"), "attempt").alias("s"))
    totals = newest.groupBy("run_id").agg(*[F.count_if(F.col("s.status") == k).alias(k) for k in ("succeeded", "failed", "skipped")], F.sum("s.row_count").alias("row_count"))
    full = totals.join(planned, "run_id")
    missing = F.col("planned") - F.col("succeeded") - F.col("failed") - F.col("skipped")
    status = F.when((F.col("skipped") > 0) | (missing > 0), "interrupted").when(F.col("failed") > 0, "completed_with_failures").otherwise("completed")
    return full.select("run_id", "planned", "succeeded", "failed", "skipped", "row_count", status.alias("status"))


def incompatible_resume(run: DataFrame, plan: DataFrame, fields: tuple[str, ...] = ("symbol_source", "batch_size", "planned", "markets")) -> DataFrame:
    """run_id and the fields in which a stored run differs from the plan that would resume it; none if it may."""
    both = run.alias("r").join(plan.alias("p"), F.col("r.run_id") == F.col("p.run_id"))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"p.{f}")), f) for f in fields]))
    return both.select("r.run_id", differing.alias("fields")).filter(F.size("fields") > 0)


#: Issue types whose rows a financial import counts as skipped.
SKIPPING = ("invalid_date", "unsupported_market", "unsupported_symbol", "duplicate_logical_key", "unknown_dictionary_id", "incomplete_trailing_bytes")


def skipped_rows(issues: DataFrame) -> DataFrame:
    """Rows that the issues of a financial import stand for."""
    return issues.agg(F.count_if(F.col("issue_type").isin(*SKIPPING)).alias("rows_skipped"))
