"""Running streams: waves, watermarks, state, and batches that are replayed."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilmark.operators import vault as VT
from veilmark.session import shared_path
from veilmark.streaming import arrivals as AR
from veilmark.streaming import audit_stream as ST

T0 = dt.datetime(2026, 1, 1, 8, 0, 0, 123456)
EVENTS = "event_id long, timestamp timestamp, event string, session_id string, wave int"


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def log_of(spark, rows):
    return spark.createDataFrame([(i, minutes(m), e, s, w) for i, (m, e, s, w) in enumerate(rows)], EVENTS).coalesce(1)


def test_sessions_close_and_leave_the_state(spark):
    rows = [(m, "task_created", s, w) for w, (s, m) in enumerate([("a", 0), ("b", 200), ("c", 400), ("d", 600)])]
    rows += [(10, "task_created", "a", 0), (0, "task_created", "a", 2)]  # the last line comes after its session has closed
    base = shared_path(spark, "t")
    progress = AR.deliver([(log_of(spark, rows), f"{base}/log")], lambda: ST.session_activity(ST.audit_stream(spark, f"{base}/log")),
                          f"{base}/ck", "append", f"{base}/out")
    out = {(r.session_id, r.session_start, r.n_events) for r in spark.read.parquet(f"{base}/out").collect()}
    assert out == {("a", T0, 2), ("b", minutes(200), 1), ("c", minutes(400), 1)}
    rows_held = AR.state_rows(progress)
    # each wave adds its session and the watermark that it moves evicts the one before
    assert max(rows_held) == 2 and rows_held[-1] == 1
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 1


def test_update_mode_merges_and_drops_late_lines(spark):
    day = 24 * 60
    rows = [(0, "file_uploaded", "a", 0), (1, "file_uploaded", "a", 0), (day, "file_uploaded", "a", 0),
            (2, "file_uploaded", "a", 1),  # its day is still open
            (4 * day, "auth_failed", "a", 1), (3, "file_uploaded", "a", 2), (4 * day + 1, "auth_failed", "a", 2)]
    base = shared_path(spark, "t")
    AR.deliver([(log_of(spark, rows), f"{base}/log")], lambda: ST.daily_counts(ST.audit_stream(spark, f"{base}/log")), f"{base}/ck", "update",
               ST.ledger_batch(f"{base}/counts"), waves=3)
    got = ST.committed(spark, f"{base}/counts").groupBy("day_start", "counter").agg(F.max_by("n_events", ST.BATCH_ID).alias("n"))
    midnight = dt.datetime(2026, 1, 1)
    assert {(r.day_start, r.counter): r.n for r in got.collect()} == {
        (midnight, "files"): 3, (midnight + dt.timedelta(days=1), "files"): 1, (midnight + dt.timedelta(days=4), "incidents"): 2}


def test_replayed_batches_change_nothing(spark):
    """The engine replays a batch whose function failed, whether it failed before or after it took effect."""
    base = shared_path(spark, "t")
    log = log_of(spark, [(m, "task_created", f"s{m % 3}", m // 10) for m in range(20)])
    sink, failures = ST.upsert_batch(f"{base}/out", "session_id", "event_id"), []

    def fails_after(batch, batch_id):
        sink(batch, batch_id)
        failures.append(batch_id)
        raise RuntimeError("lost after the ledger was written")

    def fails_between(batch, batch_id):
        # an earlier attempt that wrote other rows and never reached the ledger
        batch.limit(1).withColumn("event_id", F.lit(999).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/{ST.BATCH_ID}={batch_id}")
        failures.append(batch_id)
        raise RuntimeError("lost before the ledger was written")

    def start(k, fn):
        log.where(F.col("wave") == k).drop("wave").write.mode("append").json(f"{base}/log") if fn is not sink else None
        return AR.run_wave(ST.dedup_events(ST.audit_stream(spark, f"{base}/log")), f"{base}/ck", "append", fn)

    for k, fails in enumerate([fails_after, fails_between]):
        with pytest.raises(StreamingQueryException):
            start(k, fails)
        start(k, sink)
    assert len(failures) == 2
    rows = ST.committed(spark, f"{base}/out")
    assert rows.where("event_id = 999").count() == 0
    assert rows.count() == 6  # three sessions in each of two batches
    latest = VT.upsert_latest(rows.drop(ST.BATCH_ID), "session_id", "event_id")
    assert {r.session_id: r.event_id for r in latest.collect()} == {"s0": 18, "s1": 19, "s2": 17}


def test_batches_outside_the_ledger_are_not_read(spark):
    base = shared_path(spark, "t")
    sink = ST.ledger_batch(f"{base}/out")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    sink(df, 0)
    df.write.parquet(f"{base}/out/{ST.BATCH_ID}=1")
    assert ST.committed(spark, f"{base}/out").count() == 1
    sink(df.unionByName(df), 1)
    sink(df, 1)  # entered already
    assert ST.committed(spark, f"{base}/out").count() == 3


def test_results_of_the_second_stream(spark):
    """Matched in time, too late, never, and for a file that is gone."""
    base = shared_path(spark, "t")
    files = spark.createDataFrame([(i, minutes(i), 0) for i in range(4)] + [(9, minutes(3000), 1)], "doc_id long, uploaded_at timestamp, wave int")
    scans = spark.createDataFrame([(0, minutes(5), 0), (1, minutes(30), 0), (3, minutes(4), 0), (9, minutes(3000), 1)], "doc_id long, done_at timestamp, wave int")
    erased = spark.createDataFrame([(3,), (3,), (7,)], "doc_id long")

    def stream():
        return ST.merged_results(AR.read_json_stream(spark, f"{base}/f", "doc_id long, uploaded_at timestamp"),
                                 AR.read_json_stream(spark, f"{base}/s", "doc_id long, done_at timestamp"), erased)

    progress = AR.deliver([(files, f"{base}/f"), (scans, f"{base}/s")], stream, f"{base}/ck", "append", f"{base}/out", waves=2)
    got = {r.doc_id: (r.status, r.done_at) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {0: ("merged", minutes(5)), 1: ("unmatched", None), 2: ("unmatched", None), 3: ("gone", None), 9: ("merged", minutes(3000))}
    held = AR.state_rows(progress)
    assert held[-1] < max(held)


def test_waves_of_an_empty_log(spark):
    log = spark.createDataFrame([], "timestamp timestamp")
    assert log.withColumn("wave", AR.day_waves(log, "timestamp")).count() == 0
