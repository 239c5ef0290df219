"""Sweeps as a stream: newest attempts, late outcomes, restarts from the checkpoint, retries by timers."""

import time

from quotemill.plans import guards
from quotemill.session import ship
from quotemill.streaming import sweeps


def land(spark, source, rows):
    spark.createDataFrame(rows, sweeps.OUTCOMES).coalesce(1).write.mode("append").parquet(source)


def changes(spark, target):
    rows = spark.read.schema(sweeps.CHANGES).parquet(target).collect()
    return {(r.market, r.batch_no, r.kind, r.attempt, r.status, r.failure, r.row_count) for r in rows}


def test_restart_in_the_middle_of_a_sweep(spark, tmp_path):
    ship(spark)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def go_on():
        assert sweeps.sweep_stream(spark, source, target, checkpoint, sweeps.Retries(budget=1, base_ms=1)).awaitTermination(60)

    before = spark.conf.get(sweeps.PROVIDER)
    land(spark, source, [("r", "sh", 1, 1, None, 5), ("r", "sh", 2, 1, "i/o timeout", 5), ("r", "sh", 3, 1, "decode: cut", 5), ("r", None, 4, 1, "reset", 5), ("r", "sz", 6, 2, "", 9)])
    go_on()
    assert spark.conf.get(sweeps.PROVIDER) == before
    first = {("sh", 1, "outcome", 1, "succeeded", "", 5), ("sh", 2, "outcome", 1, "failed", "timeout", 0), ("sh", 3, "outcome", 1, "failed", "decode", 0), (None, 4, "outcome", 1, "failed", "transport", 0), ("sz", 6, "outcome", 2, "succeeded", "", 9)}
    assert changes(spark, target) == first
    # mended before its timer is looked at: no retry; a late failure, a repeat and a null attempt change nothing; another batch's retry falls due
    land(spark, source, [("r", "sh", 2, 2, "", 7), ("r", "sz", 6, 1, "reset", 5), ("r", "sh", 1, 1, "", 5), ("r", "sh", 3, None, "", 5), ("r", "sz", 5, 1, "context canceled", None)])
    go_on()
    second = {("sh", 2, "outcome", 2, "succeeded", "", 7), ("sz", 6, "late", 1, "failed", "transport", 0), ("sh", 1, "late", 1, "succeeded", "", 5), ("sh", 3, "late", 0, "succeeded", "", 5), ("sz", 5, "outcome", 1, "skipped", "cancelled", 0), (None, 4, "retry", 2, "failed", "transport", 0)}
    assert changes(spark, target) == first | second
    written = spark.read.schema(sweeps.CHANGES).parquet(target)
    assert [tuple(r) for r in sweeps.due_retries(written).collect()] == [("r", None, 4, 2)]
    # the budget is spent: a second failure is asked for no more
    land(spark, source, [("r", None, 4, 2, "reset", 5)])
    go_on()
    land(spark, source, [("r", "sz", 5, 2, "", 1)])
    go_on()
    written = spark.read.schema(sweeps.CHANGES).parquet(target)
    assert written.filter("kind = 'retry'").count() == 1 and sweeps.due_retries(written).count() == 0
    planned = spark.createDataFrame([("r", 6)], "run_id string, planned long")
    assert tuple(guards.sweep_run(sweeps.batch_states(written), planned).first()) == ("r", 6, 4, 2, 0, 22, "completed_with_failures")


def test_retries_fall_due_without_further_outcomes(spark, tmp_path):
    ship(spark)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    land(spark, source, [("r", "sh", 1, 1, "reset", 5)])
    query = sweeps.sweep_stream(spark, source, target, checkpoint, sweeps.Retries(base_ms=500), every="200 milliseconds")
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until:
            found = changes(spark, target)
            if ("sh", 1, "retry", 2, "failed", "transport", 0) in found:
                break
            time.sleep(0.3)
    finally:
        query.stop()
    assert found == {("sh", 1, "outcome", 1, "failed", "transport", 0), ("sh", 1, "retry", 2, "failed", "transport", 0)}


def test_many_batches_share_a_value_of_state(spark, tmp_path):
    ship(spark)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    numbers = [*range(-100, 4000), None, 2**53 + 1]

    def go_on(rows):
        land(spark, source, rows)
        query = sweeps.sweep_stream(spark, source, target, checkpoint, sweeps.Retries(budget=1, base_ms=1))
        assert query.awaitTermination(60)
        return sum(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators)

    assert go_on([("r", "sh", n, 1, "reset" if n is None or n % 2 else "", 5) for n in numbers]) < 20
    go_on([("r", "sh", n, 1, "", 5) for n in (0, 1, None)])  # late, while what failed has fallen due
    found = changes(spark, target)
    bad = [n for n in numbers if n is None or n % 2]
    assert {c[1] for c in found if c[2] == "outcome"} == set(numbers) and {c[1] for c in found if c[2] == "late"} == {0, 1, None}
    assert {c for c in found if c[2] == "retry"} == {("sh", n, "retry", 2, "failed", "transport", 0) for n in bad}
    go_on([("r", "sh", n, 2, "", 7) for n in bad])
    written = spark.read.schema(sweeps.CHANGES).parquet(target)
    assert sweeps.due_retries(written).count() == 0 and written.count() == len(numbers) + 3 + 2 * len(bad)
    planned = spark.createDataFrame([("r", len(numbers))], "run_id string, planned long")
    assert tuple(guards.sweep_run(sweeps.batch_states(written), planned).first()) == ("r", len(numbers), len(numbers), 0, 0, 5 * (len(numbers) - len(bad)) + 7 * len(bad), "completed")


def test_delays_double_up_to_their_bound_and_repeat():
    retries = sweeps.Retries(base_ms=200, most_ms=1000)
    for attempt, full in ((1, 200), (2, 400), (3, 800), (4, 1000), (9, 1000)):
        delays = [retries.delay(("r", "sh", n), attempt) for n in range(200)]
        assert full // 2 <= min(delays) < max(delays) <= full
        assert delays == [retries.delay(("r", "sh", n), attempt) for n in range(200)]


def test_empty_and_odd_outcomes(spark):
    rows = spark.createDataFrame([], sweeps.CHANGES)
    assert sweeps.due_retries(rows).count() == 0 and sweeps.batch_states(rows).count() == 0
    one = guards.sweep_status(spark.createDataFrame([("Decode", None)], "error string, row_count long")).first()
    assert (one.status, one.failure, one.recoverable, one.row_count) == ("failed", "decode", False, 0)
