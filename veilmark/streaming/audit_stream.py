"""Structured Streaming over the audit log and incoming texts.

The same column expressions as the batch operators are used: detection and
masking are stateless projections and run unchanged on a stream; the stateful
parts are a watermarked tumbling-window count, a session window for context
expiry, a time-bounded stream-stream join for late deep-scan results, and an
exactly-once ``foreachBatch`` upsert.  Stateless functions and aggregations also run
on a batch table, so a stream's result can be checked against the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators import detect as D
from veilmark.operators import mask as M
from veilmark.operators import vault as VT
from veilmark.sources.audit_json import parse_lines

DAY_WATERMARK = "1 day"
SESSION_WATERMARK = "10 minutes"
SESSION_GAP = f"{R.SESSION_TTL_SECONDS} seconds"


def audit_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The append-only audit folder as a stream (same parser as the batch scan; malformed lines left out)."""
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return parse_lines(r.text(path)).where("corrupt IS NULL").drop("corrupt")


def _group(event):
    return (
        F.when(event.isin(*R.FILE_EVENTS), "files")
        .when(event.isin(*R.TASK_EVENTS), "tasks")
        .when(event.isin(*R.INCIDENT_EVENTS), "incidents")
        .otherwise("other")
    )


def daily_counts(events: DataFrame, watermark: str | None = DAY_WATERMARK) -> DataFrame:
    """Per day and counter group (files / tasks / incidents / other) event counts."""
    ev = events.withWatermark("timestamp", watermark) if watermark else events
    g = ev.groupBy(F.window("timestamp", "1 day").alias("w"), _group(F.col("event")).alias("counter"))
    return g.agg(F.count(F.lit(1)).alias("n_events")).select(
        F.col("w.start").alias("day_start"), "counter", "n_events"
    )


def session_activity(events: DataFrame, watermark: str | None = SESSION_WATERMARK, gap: str = SESSION_GAP) -> DataFrame:
    """Activity sessions per session id; a closed session window = an expired context."""
    ev = events.withWatermark("timestamp", watermark) if watermark else events
    g = ev.groupBy("session_id", F.session_window("timestamp", gap).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("n_events")).select(
        "session_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("expires_at"), "n_events"
    )


def mask_stream(texts: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detect + mask on arrival (stateless, same expressions as batch)."""
    return M.mask(D.with_spans(texts, text_col), key, text_col).select(
        key, "masked_text", F.size("tspans").alias("n_spans"), "tspans"
    )


def late_deep_results(files: DataFrame, deep: DataFrame, bound: str = "6 minutes") -> DataFrame:
    """Files (doc_id, uploaded_at) left-outer-joined with deep-scan results (doc_id, done_at)
    arriving within ``bound``.

    Both sides are watermarked, so a file waits in the state until the watermark has
    passed its bound and then comes out without a result; a result whose file is not
    in the state any more is dropped.
    """
    f = files.withWatermark("uploaded_at", bound).alias("f")
    d = deep.withWatermark("done_at", bound).alias("d")
    cond = (F.col("f.doc_id") == F.col("d.doc_id")) & (F.col("d.done_at") >= F.col("f.uploaded_at")) & (
        F.col("d.done_at") <= F.col("f.uploaded_at") + F.expr(f"INTERVAL {bound}")
    )
    return f.join(d, cond, "left_outer")


def merged_results(files: DataFrame, deep: DataFrame, erased: DataFrame, bound: str = "6 minutes") -> DataFrame:
    """X5 with what becomes of each file: (doc_id, uploaded_at, done_at, status).

    ``merged``: its result came in time; ``unmatched``: none did; ``gone``: the file's
    record was erased meanwhile (``erased``: a static table, read by each batch), so
    there is nothing that a result could be merged into.
    """
    j = late_deep_results(files, deep, bound).select(F.col("f.doc_id").alias("doc_id"), "uploaded_at", "done_at")
    gone = erased.select(F.col("doc_id").alias("_gone")).distinct()
    status = F.when(F.col("_gone").isNotNull(), "gone").when(F.col("done_at").isNull(), "unmatched").otherwise("merged")
    kept = F.when(F.col("_gone").isNull(), F.col("done_at"))
    return j.join(gone, F.col("doc_id") == F.col("_gone"), "left").select("doc_id", "uploaded_at", kept.alias("done_at"), status.alias("status"))


def dedup_events(events: DataFrame, key: str = "event_id", watermark: str = SESSION_WATERMARK) -> DataFrame:
    """Replayed events dropped within the watermark."""
    return events.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([key])


#: Partition column of the tables that ``ledger_batch`` writes.
BATCH_ID = "_batch_id"


def _ledger(target: str) -> str:
    return f"{target.rstrip('/')}-ledger"


def _entered(spark: SparkSession, target: str, batch_id: int) -> bool:
    try:
        return bool(spark.read.parquet(f"{_ledger(target)}/{BATCH_ID}={batch_id}").head(1))
    except AnalysisException:  # the folder is not there yet
        return False


def ledger_batch(target: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose batches take effect exactly once.

    A batch is written to a folder of its own, replacing what an earlier attempt left
    there, and then entered in a ledger beside the table.  A batch that the engine
    replays after a failure is either in the ledger, and its rows stay as they are, or not,
    and its rows replace the unfinished ones.  ``committed`` reads entered batches only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _entered(spark, target, batch_id):
            # still run: the state of the stream's operators is committed by the tasks of the batch
            batch.write.format("noop").mode("overwrite").save()
            return
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{BATCH_ID}={batch_id}")
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{_ledger(target)}/{BATCH_ID}={batch_id}")

    return run


def committed(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all entered batches of a ``ledger_batch`` table, with their batch number."""
    entered = spark.read.parquet(_ledger(target)).select(F.col(BATCH_ID).alias("_entered")).distinct()
    rows = spark.read.parquet(target)
    return rows.join(entered, rows[BATCH_ID] == F.col("_entered"), "left_semi")


def upsert_batch(target_path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """Each batch's latest version per key, exactly once; readers compact with ``upsert_latest``."""
    return ledger_batch(target_path, lambda batch: VT.upsert_latest(batch, key, version))


def boundary_alert_stream(events: DataFrame) -> DataFrame:
    """P18 on a stream: every event flagged as having left the boundary."""
    return events.filter(F.col("data_left_boundary"))
