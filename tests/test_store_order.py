"""The bucketed store, ordered numbers, deep pages and the day-partitioned log."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import audit as AU
from veilmark.operators import ordering as O
from veilmark.operators.keyed_store import KeyedStore
from veilmark.session import shared_path
from veilmark.sources import audit_json as AJ

T0 = dt.datetime(2026, 1, 1, 8, 0, 0)


def store_of(spark, buckets=8):
    return KeyedStore(spark, shared_path(spark, "s"), "k", ["k", "t"], "v", "k string, t string, v long", buckets)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, v long")


def test_store_appends_compacts_and_erases(spark):
    s = store_of(spark)
    assert s.rows().collect() == [] and s.compact() == [] and s.erase(rows_of(spark, [("a", "", 0)])) == []
    first = [(f"k{i}", "x", i) for i in range(40)]
    second = [(f"k{i}", "x", 100 + i) for i in range(3)] + [("k0", "y", 5)]
    s.append(rows_of(spark, first))
    s.append(rows_of(spark, second))
    want = {(k, t): v for k, t, v in first + second}
    assert {(r.k, r.t): r.v for r in s.latest().collect()} == want
    before = set(s.live())
    folded = s.compact()
    touched = {b for g, b in before if g == 2}
    assert set(folded) == touched and s.rows().count() == 41
    # buckets with one generation kept theirs
    assert {p for p in before if p[1] not in touched} <= set(s.live())
    before = set(s.live())
    gone = s.erase(rows_of(spark, [("k7", "", 0), ("k8", "", 0), ("nobody", "", 0), ("k7", "z", 1)]))
    assert len(gone) <= 2
    assert {p for p in before if p[1] not in gone} == {p for p in s.live() if p[1] not in gone}
    assert {(r.k, r.t) for r in s.rows().collect()} == {x for x in want if x[0] not in ("k7", "k8")}
    changes = s.versions()
    assert s.erase(rows_of(spark, [("nobody", "", 0)])) == [] and s.versions() == changes
    dead = s.vacuum()
    assert dead > 0 and s.vacuum() == 0 and s.rows().count() == len(want) - 2


def test_store_survives_an_unfinished_write(spark):
    s = store_of(spark)
    s.append(rows_of(spark, [("a", "x", 1)]))
    s._write(s._dealt(rows_of(spark, [("b", "x", 1), ("a", "x", 9)])), 2)  # dies before the manifest
    assert [tuple(r) for r in s.rows().collect()] == [("a", "x", 1)]
    s.append(rows_of(spark, [("c", "x", 1)]))
    assert sorted(r.k for r in s.rows().collect()) == ["a", "c"]
    with pytest.raises(Exception):  # another writer that started from the same version
        s._commit(2, [])


def test_store_loses_its_last_row(spark):
    s = store_of(spark)
    s.append(rows_of(spark, [("a", "x", 1)]))
    assert len(s.erase(rows_of(spark, [("a", "", 0)]))) == 1
    assert s.rows().collect() == [] and s.live() == []
    s.append(rows_of(spark, [("a", "x", 2)]))
    assert s.rows().count() == 1


def events(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(seconds=rng.choice([0, 0, 0, i, 7 * i, 10**6])) if rng.random() < 0.9 else None) for i in range(n)]
    rows += [rows[0]] * 30 + [(2**62, T0)] + [(None, T0)] * 3
    return rows, spark.createDataFrame(rows, "event_id long, timestamp timestamp").repartition(3)


def newest_first(rows):
    low = dt.datetime(1, 1, 1)
    return sorted(rows, key=lambda r: (r[1] or low, r[0] if r[0] is not None else -1), reverse=True)


def test_numbers_follow_the_order_over_many_runs(spark):
    rows, df = events(spark)
    order = [F.col("timestamp").desc_nulls_last(), F.col("event_id").desc_nulls_last()]
    got = sorted(O.numbered_in_order(df, ["timestamp", "event_id"], order, "n", run_rows=20).collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, len(rows) + 1))
    assert [(r.event_id, r.timestamp) for r in got] == newest_first(rows)


def test_one_timestamp_is_cut_into_runs(spark, monkeypatch):
    seen = []
    real = O.written
    monkeypatch.setattr(O, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    df = spark.createDataFrame([(1, T0)] * 1000, "event_id long, timestamp timestamp")
    out = O.numbered_in_order(df, ["timestamp"], [F.col("timestamp").desc()], "n", run_rows=50)
    assert sorted(r.n for r in out.collect()) == list(range(1, 1001))
    sizes = [r["count"] for r in seen[1].groupBy("_run").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150


def test_ranks_in_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["anonymous"] * 20 + ["a", "b", None]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "owner string, at long, task long")
    got = O.ranked_in_groups(df, "owner", ["at", "task"], [F.col("at").desc(), F.col("task")], "rank", run_rows=30).collect()
    want, seen = {}, {}
    for o, at, t in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[o] = want[t] = seen.get(o, 0) + 1
    assert {r.task: r.rank for r in got} == want


@pytest.mark.parametrize("range_rows", [1, 40, 100_000])
def test_pages_equal_a_full_sort(spark, range_rows):
    rows, df = events(spark)
    want = newest_first(rows)
    for offset, limit in ((0, 10), (100, 7), (250, 100), (len(rows) - 5, 50), (len(rows) - 60, 20), (len(rows) + 3, 5)):
        got = [(r.event_id, r.timestamp) for r in AU.audit_page(df, offset, limit, range_rows).collect()]
        assert got == want[offset:offset + limit], (offset, limit)


def test_a_deep_page_reads_its_part_only(spark):
    path = shared_path(spark, "p")
    spark.range(20_000).select(F.col("id").alias("event_id"), (F.lit(T0) + F.make_interval(secs=F.col("id"))).alias("timestamp")).write.parquet(path)
    page = AU.audit_page(spark.read.parquet(path), 18_000, 100, range_rows=500)
    assert [r.event_id for r in page.collect()] == list(range(1999, 1899, -1))
    plan = page._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters"):]
    assert "LessThanOrEqual(timestamp" in pushed and "GreaterThanOrEqual(" in pushed


def test_log_by_days(spark):
    out = os.path.join(shared_path(spark, "log"), "audit")
    now = F.lit("2026-03-01 12:00:00").cast("timestamp")
    rows = [(1, T0, "a", None), (2, T0 + dt.timedelta(days=1, microseconds=7), "b", True), (3, None, "c", False), (4, T0 + dt.timedelta(days=2), "d", None)]
    log = spark.createDataFrame(rows, "event_id long, timestamp timestamp, event string, data_left_boundary boolean")
    AJ.append_audit(log, out, now)
    got = {r.event_id: (r.timestamp, r.data_left_boundary) for r in AJ.read_audit(spark, out).collect()}
    assert got == {1: (T0, False), 2: (T0 + dt.timedelta(days=1, microseconds=7), True), 3: (dt.datetime(2026, 3, 1, 12), False), 4: (T0 + dt.timedelta(days=2), False)}
    day = AJ.read_audit(spark, out, "2026-01-02", "2026-01-02")
    assert [r.event for r in day.collect()] == ["b"]
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(day.inputFiles()) >= 1
    scanned = spark.read.text(out).where("day = date'2026-01-02'")
    assert scanned.select("value").count() == 1
    # a day is replaced, run twice, the others stay
    for _ in range(2):
        AJ.rewrite_days(log.where("event_id = 2").withColumn("event", F.lit("hidden")), out, now)
    assert sorted(r.event for r in AJ.read_audit(spark, out).collect()) == ["a", "c", "d", "hidden"]
    assert AJ.count_lines(spark, out) == 4
    with pytest.raises(ValueError):
        flat = shared_path(spark, "flat")
        spark.createDataFrame([("{}",)], "value string").write.text(flat)
        AJ.read_audit(spark, flat, "2026-01-01")


def test_a_table_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    """Rows of one file and row group are one task of a scan; dealt, each core gets some, and all rows stay."""
    from veilmark.session import DEAL_FROM, dealt

    n = DEAL_FROM + 1000
    spark.range(n, numPartitions=1).selectExpr("id AS k", "id % 7 AS v").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000, numPartitions=1).selectExpr("id AS k", "id % 7 AS v").coalesce(1).write.parquet(str(tmp_path / "few"))
    spark.range(n, numPartitions=8).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "many"))

    def tasks(df):
        return df.selectExpr("spark_partition_id() AS t").distinct().count()

    one, few, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "few", "many"))
    assert tasks(one) == 1 and tasks(dealt(one, "k")) == spark.sparkContext.defaultParallelism
    assert dealt(one, "k").exceptAll(one).count() == 0 and dealt(one, "k").count() == n
    assert dealt(few, "k") is few and dealt(many, "k") is many
