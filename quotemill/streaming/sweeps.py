"""Sweeps as a stream with durable state: what the newest attempt of every batch came to, and when another attempt is due.

Outcomes arrive in any order, more than once and over any number of runs of the query. State is kept for each (run_id, market,
batch_no), that of some thousands of batches in one value; it lies with the query's checkpoint, so a query that is ended or lost goes on where it was. Timers are of processing time: a
retry is due though no other outcome arrives, and no outcome is ever too late to be read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quotemill.plans.guards import FAILURES, RECOVERABLE, sweep_status

KEY = ["run_id", "market", "batch_no"]
OUTCOMES = "run_id string, market string, batch_no long, attempt int, error string, row_count long"
#: kind: outcome (the batch's state from now on), late (older than the state, or repeated; changes nothing), retry (attempt is the one now due).
CHANGES = "run_id string, market string, batch_no long, kind string, attempt int, status string, failure string, recoverable boolean, row_count long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Retries:
    """budget: attempts after the first. Delays double from base_ms up to most_ms; state of a batch goes keep_ms after its last change."""

    budget: int = 2
    base_ms: int = 200
    most_ms: int = 30_000
    keep_ms: int = 7 * 24 * 3600 * 1000

    def delay(self, key: tuple, attempt: int) -> int:
        """Milliseconds to wait after a failed attempt: between half and all of the doubled delay, by a hash, so that a task run again waits alike."""
        full = min(self.base_ms << (attempt - 1), self.most_ms)
        return max(1, full // 2 + full * (zlib.crc32(repr((*key, attempt)).encode()) % 1000) // 2000)


#: Batch numbers whose state is one value, so that a call for state serves many batches; and the range of those without a number.
BATCHES, NO_NUMBER = 4000, -(2**62)
#: A batch's state. Its failure, by number, says its status and whether another attempt may mend it; due is -1 if none is asked for.
STATE = np.dtype([("batch_no", "<i8"), ("attempt", "<i4"), ("failure", "u1"), ("row_count", "<i8"), ("due", "<i8"), ("changed", "<i8")])
KINDS = ("", "transport", *dict.fromkeys(name for _, name in FAILURES))
STATUSES = np.array(["succeeded" if k == "" else "skipped" if k == "cancelled" else "failed" for k in KINDS], object)
AGAIN = np.array([k in RECOVERABLE for k in KINDS])


class Batches(StatefulProcessor):
    """Keeps the newest attempt of each batch of a range, and one timer: when the first of the attempts that may mend them is due."""

    def __init__(self, retries: Retries) -> None:
        self.retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "packed binary, timer long", self.retries.keep_ms)

    def held(self, now: int) -> tuple[np.ndarray, int | None]:
        """The batches' state by number, without that which is too old, and the time of the timer."""
        found = self.newest.get()
        if not found:
            return np.empty(0, STATE), None
        state = np.frombuffer(bytes(found[0]), STATE)
        return state[state["changed"] > now - self.retries.keep_ms], found[1]

    def keep(self, state: np.ndarray, timer: int | None) -> None:
        """Stores the state, and moves the timer, if it is another, to the first time due."""
        due = state["due"][state["due"] >= 0]
        first = int(due.min()) if len(due) else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.newest.update((state.tobytes(), first))

    @staticmethod
    def changes(key: tuple, kind: np.ndarray | str, batch_no: np.ndarray, attempt: np.ndarray, failure: np.ndarray, row_count: np.ndarray) -> pd.DataFrame:
        run_id, market, block = key
        numbers = pd.array([None] * len(batch_no) if block == NO_NUMBER else batch_no, "Int64")
        ids = {"run_id": pd.array([run_id] * len(batch_no), object), "market": pd.array([market] * len(batch_no), object), "batch_no": numbers}
        return pd.DataFrame(ids | {"kind": kind, "attempt": attempt, "status": STATUSES[failure], "failure": np.array(KINDS, object)[failure], "recoverable": AGAIN[failure], "row_count": row_count})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state, timer = self.held(now)
        own = pd.concat(list(rows), ignore_index=True)
        own = own.sort_values(["batch_no", "attempt", "status", "failure", "row_count"], kind="stable")
        numbers, attempts = own["batch_no"].to_numpy(np.int64), own["attempt"].to_numpy(np.int32)
        failures = pd.Categorical(own["failure"], categories=KINDS).codes.astype(np.uint8)
        counts = own["row_count"].to_numpy(np.int64)
        newest = np.zeros(len(own), np.int64)
        if len(state):
            at = np.searchsorted(state["batch_no"], numbers).clip(max=len(state) - 1)
            newest = np.where(state["batch_no"][at] == numbers, state["attempt"][at], 0)
        step = np.ones(len(own), bool)  # the first row of a batch's attempt
        step[1:] = (numbers[1:] != numbers[:-1]) | (attempts[1:] != attempts[:-1])
        taken = step & (attempts > newest)
        yield self.changes(key, np.where(taken, "outcome", "late").astype(object), numbers, attempts, failures, counts)
        if not taken.any():
            return
        places = np.flatnonzero(taken)
        places = places[np.append(numbers[places][1:] != numbers[places][:-1], True)]  # of a batch's attempts the last
        new = np.zeros(len(places), STATE)
        for name, values in (("batch_no", numbers), ("attempt", attempts), ("failure", failures), ("row_count", counts)):
            new[name] = values[places]
        new["changed"], new["due"] = now, -1
        for k in np.flatnonzero(AGAIN[new["failure"]] & (new["attempt"] <= self.retries.budget)):
            number = None if key[2] == NO_NUMBER else int(new["batch_no"][k])
            new["due"][k] = now + self.retries.delay((key[0], key[1], number), int(new["attempt"][k]))
        state = np.concatenate([state[~np.isin(state["batch_no"], new["batch_no"])], new])
        self.keep(state[np.argsort(state["batch_no"])], timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state, timer = self.held(now)
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        state = state.copy()
        due = (state["due"] >= 0) & (state["due"] <= now)
        told = state[due]
        state["due"][due], state["changed"][due] = -1, now
        self.keep(state, None)  # a timer goes as it expires
        yield self.changes(key, "retry", told["batch_no"], told["attempt"] + 1, told["failure"], told["row_count"])


def sweep_changes(outcomes: DataFrame, retries: Retries = Retries()) -> DataFrame:
    """CHANGES of a stream of OUTCOMES. Of an attempt's outcomes in one micro-batch the least by status counts, the others are late.

    A null error is none; a null attempt counts as 0, which is late; a null row_count is 0. Null keys are keys.
    """
    plain = outcomes.withColumns({"attempt": F.coalesce("attempt", F.lit(0)), "row_count": F.coalesce("row_count", F.lit(0)).cast("long")})
    number = F.col("batch_no")
    block = F.coalesce(F.floor(number / BATCHES), F.lit(NO_NUMBER)).alias("block")
    rows = sweep_status(plain).select("run_id", "market", block, F.coalesce(number, F.lit(0)).alias("batch_no"), "attempt", "status", "failure", "row_count")
    return rows.groupBy("run_id", "market", "block").transformWithStateInPandas(statefulProcessor=Batches(retries), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def sweep_stream(spark: SparkSession, source: str, target: str, checkpoint: str, retries: Retries = Retries(), every: str | None = None) -> StreamingQuery:
    """Starts a query that appends the changes of every new Parquet file of outcomes below source to the table at target.

    It reads what is there and ends; retries due by then are told. With every, an interval, it goes on and tells retries as they fall due.
    """
    stream = spark.readStream.schema(OUTCOMES).parquet(source)
    writer = sweep_changes(stream, retries).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    settings = {PROVIDER: ROCKS, IDLE: "true" if every else "false"}  # batches without files look for timers, without an end
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.start()  # a started query keeps the settings it began with
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def batch_states(changes: DataFrame) -> DataFrame:
    """State rows, one per attempt taken, as `guards.sweep_run` reads them."""
    return changes.filter("kind = 'outcome'").drop("kind")


def due_retries(changes: DataFrame) -> DataFrame:
    """run_id, market, batch_no, attempt: attempts that have fallen due and have no outcome yet."""
    last = F.max(F.when(F.col("kind") == "outcome", F.col("attempt"))).alias("done")
    asked = F.max(F.when(F.col("kind") == "retry", F.col("attempt"))).alias("attempt")
    return changes.groupBy(*KEY).agg(last, asked).filter("attempt > done").drop("done")
