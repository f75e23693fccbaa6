"""Registered queries that run as streams.

Each delivers a log in waves to a folder of the shared directory and runs the
streaming operator after every wave from its checkpoint (``streaming.arrivals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators import vault as VT
from veilmark.plans.queries import QUERIES, register
from veilmark.session import shared_path
from veilmark.sources import tables as TB
from veilmark.streaming import arrivals as AR
from veilmark.streaming import audit_stream as ST

__all__ = ["QUERIES"]


def _slow() -> Column:
    """Sessions whose log lines are delivered late."""
    return F.col("session_id").cast("bigint") % 10 == 3


@register("stream_daily_counts")
def q_stream_daily_counts(spark, sf):
    """Counts per day and group as a stream in update mode, and how many lines came too late for their day.

    Slow sessions' lines come one wave late; those whose day the watermark has closed are dropped by the engine.
    """
    log = TB.audit_events(spark, sf)
    last = F.lit(AR.WAVES - 1)
    base = shared_path(spark, "daily")
    waves = log.withColumn("wave", F.least(last, AR.day_waves(log, "timestamp") + F.when(_slow(), 1).otherwise(0)))
    AR.deliver([(waves, f"{base}/log")], lambda: ST.daily_counts(ST.audit_stream(spark, f"{base}/log")), f"{base}/checkpoint", "update",
               ST.ledger_batch(f"{base}/counts"))
    # update mode: a group comes again whenever it changes, the last batch has its count
    latest = ST.committed(spark, f"{base}/counts").groupBy("day_start", "counter").agg(F.max_by("n_events", ST.BATCH_ID).alias("kept"))
    every = ST.daily_counts(log, watermark=None)
    kept = F.coalesce("kept", F.lit(0))
    return every.join(latest, ["day_start", "counter"], "left").select(
        "day_start", "counter", kept.alias("n_events"), (F.col("n_events") - kept).alias("n_late"))


@register("stream_sessions")
def q_stream_sessions(spark, sf):
    """Expired contexts as they close: session windows in append mode, evicted from the state by the watermark.

    Lines of slow sessions that are older than the watermark of their own wave come a wave late and are dropped.
    """
    log = TB.audit_events(spark, sf)
    waves = log.withColumn("wave", AR.day_waves(log, "timestamp"))
    ends = F.create_map(*[F.lit(x) for r in waves.groupBy("wave").agg(F.max("timestamp")).collect() for x in r])  # a row per wave
    closed = F.col("timestamp") + F.expr(f"INTERVAL {ST.SESSION_GAP}") + F.expr(f"INTERVAL {ST.SESSION_WATERMARK}") <= F.try_element_at(ends, "wave")
    waves = waves.withColumn("wave", F.col("wave") + F.when(_slow() & closed, 1).otherwise(0))
    base = shared_path(spark, "sessions")
    AR.deliver([(waves, f"{base}/log")], lambda: ST.session_activity(ST.audit_stream(spark, f"{base}/log")), f"{base}/checkpoint", "append",
               f"{base}/closed", waves=AR.WAVES + 1)
    return spark.read.parquet(f"{base}/closed")


# FIXED VALUES of the upload times (shared with the SQL oracle): first upload, seconds between uploads,
# longest time of a deep scan
UPLOADS_FROM = 1_700_000_000
UPLOAD_SECONDS = 30
SCAN_SECONDS = 480
# end of fixed values


def _uploads_and_scans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(doc_id, uploaded_at, at) of every document; (doc_id, done_at, at) of the deep scans of those with a text."""
    d = TB.documents(spark, sf).select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")).where("doc_id IS NOT NULL")
    up = F.lit(UPLOADS_FROM) + F.col("doc_id") * UPLOAD_SECONDS
    done = up + (F.col("n") * 7 + F.col("doc_id") * 13) % SCAN_SECONDS
    files = d.select("doc_id", F.timestamp_seconds(up).alias("uploaded_at"), up.alias("at"))
    scans = d.where("n > 0").select("doc_id", F.timestamp_seconds(done).alias("done_at"), done.alias("at"))
    return files, scans


@register("stream_late_results")
def q_stream_late_results(spark, sf):
    """Every file with the deep-scan result that came within its bound, as a stream-stream left outer join.

    Sessions of toxic documents are erased before; a last wave without files moves the watermark past the others.
    """
    files, scans = _uploads_and_scans(spark, sf)
    low, high, most = files.agg(F.min("at"), F.max("at"), F.max("doc_id")).first()
    low, high, beat_id = low or 0, high or 0, (most or 0) + 1

    def waved(log: DataFrame, time: str) -> DataFrame:
        wave = F.least(F.lit(AR.WAVES - 1), F.floor((F.col("at") - low) * AR.WAVES / F.lit(high - low + 1))).cast("int")
        beat = spark.range(1).select(F.lit(beat_id).cast("bigint").alias("doc_id"), F.timestamp_seconds(F.lit(high + 86_400)).alias(time), F.lit(AR.WAVES).alias("wave"))
        return log.select("doc_id", time, wave.alias("wave")).unionByName(beat)

    base = shared_path(spark, "late")
    erased = TB.table(spark, sf, "labels").where("toxic = 1").select("doc_id")

    def stream() -> DataFrame:
        f = AR.read_json_stream(spark, f"{base}/files", "doc_id long, uploaded_at timestamp")
        s = AR.read_json_stream(spark, f"{base}/scans", "doc_id long, done_at timestamp")
        return ST.merged_results(f, s, erased)

    AR.deliver([(waved(files, "uploaded_at"), f"{base}/files"), (waved(scans, "done_at"), f"{base}/scans")], stream, f"{base}/checkpoint", "append",
               f"{base}/out", waves=AR.WAVES + 1)
    # not filtered in the stream: the filter would go below the watermarks and take the last wave away from them
    return spark.read.parquet(f"{base}/out").where(F.col("doc_id") != beat_id)


@register("stream_upsert")
def q_stream_upsert(spark, sf):
    """The latest event of each session and how many it had, from a log that delivers every fifth event twice.

    Repeats are dropped within the watermark, each batch is pre-aggregated and entered once.
    """
    log = TB.audit_events(spark, sf).select("event_id", "timestamp", "event", "session_id")
    once = log.withColumn("wave", AR.day_waves(log, "timestamp"))
    again = once.where(F.col("event_id") % 5 == 0).withColumn("wave", F.col("wave") + 1)
    base = shared_path(spark, "upsert")

    def latest(batch: DataFrame) -> DataFrame:
        return batch.groupBy("session_id").agg(F.max_by(F.struct("event_id", "event"), "event_id").alias("v"), F.count(F.lit(1)).alias("n")).select("session_id", "v.*", "n")

    AR.deliver([(once.unionByName(again), f"{base}/log")], lambda: ST.dedup_events(ST.audit_stream(spark, f"{base}/log")), f"{base}/checkpoint", "append",
               ST.ledger_batch(f"{base}/versions", latest), waves=AR.WAVES + 1)
    versions = ST.committed(spark, f"{base}/versions").drop(ST.BATCH_ID)
    counts = versions.groupBy("session_id").agg(F.sum("n").alias("n_events"))
    return VT.upsert_latest(versions.drop("n"), "session_id", "event_id").join(counts, "session_id")


@register("stream_mask")
def q_stream_mask(spark, sf):
    """Documents masked as they arrive, by the batch expressions; the stream keeps no state."""
    docs = TB.documents(spark, sf).select("doc_id", "text")
    base = shared_path(spark, "masked")
    waves = docs.withColumn("wave", F.pmod(F.xxhash64("doc_id", "text"), F.lit(AR.WAVES)).cast("int"))
    AR.deliver([(waves, f"{base}/in")], lambda: ST.mask_stream(AR.read_json_stream(spark, f"{base}/in", "doc_id long, text string")).drop("tspans"),
               f"{base}/checkpoint", "append", f"{base}/out")
    return spark.read.parquet(f"{base}/out")
