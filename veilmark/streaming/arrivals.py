"""Streams over logs that arrive in waves: a log is delivered piece by piece and each
piece is one run of a restarted query.

A wave's rows are appended as files to the log's folder; the query is then started
from its checkpoint with ``availableNow``, takes the new files, and stops.  Between
waves nothing of it is in memory: offsets, watermark and state come from the
checkpoint, as after a restart or the loss of a driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.sources.audit_json import TIMES_IN_FULL

#: Waves in which the registered queries deliver their logs.
WAVES = 4
#: Rows of a log for each partition of a stream's state, and partitions at least.
STATE_ROWS, STATE_PARTITIONS = 100_000, 4
#: Longest run over one wave, in seconds.
PATIENCE = 3600


def day_waves(log: DataFrame, time: str, waves: int = WAVES) -> Column:
    """Wave of each row by its day: the days from the first to the last in ``waves`` equal parts (no time: the first)."""
    first, last = log.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    if first is None:
        return F.lit(0)
    days = (last - first).days + 1
    return F.coalesce(F.floor(F.datediff(F.col(time), F.lit(first)) * waves / F.lit(days)).cast("int"), F.lit(0))


def run_wave(stream: DataFrame, checkpoint: str, mode: str, sink: str | Callable[[DataFrame, int], None],
             partitions: int | None = None) -> list[dict[str, Any]]:
    """One run over what has newly arrived, into a folder (append mode) or a ``foreachBatch`` function.

    The first run of a checkpoint fixes the number of state partitions for good, so it
    should come from the expected rows: ``partitions``, else the session's number of
    shuffle partitions.  Returns the progress of each batch.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        if partitions:
            conf.set(key, str(partitions))  # the query takes a copy of the session's settings when it starts
        query = writer.format("parquet").start(sink) if isinstance(sink, str) else writer.foreachBatch(sink).start()
    finally:
        conf.set(key, before)
    if not query.awaitTermination(PATIENCE):
        query.stop()
        raise TimeoutError(f"a wave took more than {PATIENCE} s")
    return list(query.recentProgress)


def deliver(
    logs: Sequence[tuple[DataFrame, str]], stream: Callable[[], DataFrame], checkpoint: str, mode: str,
    sink: str | Callable[[DataFrame, int], None], waves: int = WAVES, wave: str = "wave",
) -> list[dict[str, Any]]:
    """Append wave after wave of each log (rows with a column ``wave``; its folder) and run the query after each."""
    progress: list[dict[str, Any]] = []
    partitions = max(STATE_PARTITIONS, -(-sum(log.count() for log, _ in logs) // STATE_ROWS))
    for k in range(waves):
        for log, folder in logs:
            log.where(F.col(wave) == k).drop(wave).write.mode("append").options(**TIMES_IN_FULL).json(folder)
        progress += run_wave(stream(), checkpoint, mode, sink, partitions)
    return progress


def state_rows(progress: Sequence[dict[str, Any]]) -> list[int]:
    """Rows in the state after each batch."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


def read_json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
