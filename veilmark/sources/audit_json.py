"""Audit log as JSON lines: scan (S9), count (A8) and append sink.

The log is read as text and parsed without an inference pass: known fields get
their types, all others go to a map, and lines that are no JSON object are split
off with their text.  The sink appends day-partitioned files so later scans prune
by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("data_left_boundary", T.BooleanType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("pii_count", T.LongType()),
        T.StructField("pii_types", T.ArrayType(T.StringType())),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("unresolved_tokens", T.LongType()),
    ]
)


#: Options for writing lines: times with microseconds (the default cuts them to milliseconds).
TIMES_IN_FULL = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Known fields as they are read; a value of another kind is kept as text in ``extra``.
KNOWN = [(f.name, f.dataType.simpleString()) for f in AUDIT_SCHEMA.fields]


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Raw JSON lines -> the columns of ``AUDIT_SCHEMA``, ``extra`` and ``corrupt``.

    The log's schema is open.  A known field whose value has another type (such as
    "3" for a number) is converted, or null if it cannot be; all other fields, and
    the text of those that could not be read, are in the map ``extra``.  A line that
    is no JSON object has its text in ``corrupt`` and nulls elsewhere; blank lines
    give no row.
    """
    raw = lines.select(F.col(value)).where(F.col(value).rlike(r"\S"))
    # values as text, whatever their kind
    parsed = raw.withColumn("_map", F.from_json(F.col(value), "map<string,string>", {"mode": "PERMISSIVE"}))
    ok = F.json_object_keys(F.col(value)).isNotNull() & F.col("_map").isNotNull()

    def field(name: str, kind: str) -> Column:
        text = F.try_element_at(F.col("_map"), F.lit(name))
        if kind.startswith("array"):
            return F.from_json(text, kind)
        return text if kind == "string" else F.when(text.isNotNull(), text.try_cast(kind))

    fields = {name: field(name, kind) for name, kind in KNOWN}
    out = parsed.select(value, "_map", *[F.when(ok, c).alias(n) for n, c in fields.items()])
    read = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n, _ in KNOWN]), lambda n: n.isNotNull())
    extra = F.map_filter(F.col("_map"), lambda k, v: v.isNotNull() & ~F.array_contains(read, k))
    return out.select(*[n for n, _ in KNOWN], F.when(ok, extra).alias("extra"), F.when(~ok, F.col(value)).alias("corrupt"))


def log_lines(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Lines of a log folder; of a log written by ``append_audit`` only the files of the days asked for are read.

    A folder without day partitions is read with all its subfolders; then days cannot be asked for.
    """
    lines = spark.read.text(path)
    if DAY not in lines.columns:
        if first_day or last_day:
            raise ValueError(f"{path} is not partitioned by {DAY}")
        return spark.read.option("recursiveFileLookup", "true").text(path)
    for day, keep in ((first_day, F.col(DAY) >= F.lit(first_day).cast("date")), (last_day, F.col(DAY) <= F.lit(last_day).cast("date"))):
        lines = lines.where(keep) if day else lines
    return lines.select("value")


def read_audit(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Audit events with ``extra``; lines that are no JSON object are left out (see ``read_corrupt``)."""
    return parse_lines(log_lines(spark, path, first_day, last_day)).where("corrupt IS NULL").drop("corrupt")


def read_corrupt(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_audit`` leaves out."""
    return parse_lines(log_lines(spark, path)).where("corrupt IS NOT NULL").select("corrupt")


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines, malformed ones included."""
    return log_lines(spark, path).filter(F.col("value").rlike(r"\S")).count()


def with_audit_defaults(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The UTC timestamp where there is none, and ``data_left_boundary`` False where nothing is said."""
    ts = now if now is not None else F.current_timestamp()
    given = F.coalesce(F.col("timestamp").cast("timestamp"), ts) if "timestamp" in df.columns else ts
    flag = F.coalesce(F.col("data_left_boundary"), F.lit(False)) if "data_left_boundary" in df.columns else F.lit(False)
    return df.withColumn("timestamp", given).withColumn("data_left_boundary", flag)


#: Partition column of a log that the sink writes.
DAY = "day"


def append_audit(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Append events as JSON lines, partitioned by day (task-level files, commit protocol instead of a lock).

    Rows are dealt by (day, hash) so that a day has few files and a busy day many writers.
    """
    _by_day(with_audit_defaults(df, now)).write.mode("append").partitionBy(DAY).options(**TIMES_IN_FULL).json(path)


def rewrite_days(df: DataFrame, path: str, now: Column | None = None) -> None:
    """Replace the days that occur in ``df`` by its rows and leave all others as they are (dynamic partition overwrite).

    Run again after a failure it gives the same days.  ``df`` must not be read from the
    days that it replaces.
    """
    out = _by_day(with_audit_defaults(df, now))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).options(**TIMES_IN_FULL).json(path)


#: Files of a day that one write makes at most.
DAY_FILES = 16


def _by_day(df: DataFrame) -> DataFrame:
    dated = df.withColumn(DAY, F.to_date("timestamp"))
    return dated.repartition(DAY, F.pmod(F.xxhash64("timestamp", *[c for c in ("event_id", "session_id") if c in df.columns]), F.lit(DAY_FILES)))
