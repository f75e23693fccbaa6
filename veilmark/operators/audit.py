"""Audit analytics: dashboard, breakdowns, paging, CSV lines, labels.

Input is an audit table with the columns of ``veilmark.sources.tables.audit_events``
(event_id, timestamp, event, data_left_boundary, session_id, user, filename,
pii_count, pii_types, provider, model).  Aggregations are single-pass
conditional sums with map-side partial aggregation; the only global sorts are
top-k reports (TakeOrderedAndProject) and the explicit audit page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators.ordering import RANGE_ROWS, numbered_in_order, page


def _is(event: list[str]) -> Column:
    return F.col("event").isin(*event)


def latest(audit: DataFrame, cap: int | None) -> DataFrame:
    """Optional row cap of the original dashboard (newest ``cap`` events); ``None`` = full history."""
    if cap is None:
        return audit
    return audit.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(cap)


def dashboard_stats(audit: DataFrame, active_sessions: DataFrame | None = None, active_tasks: DataFrame | None = None,
                    cap: int | None = None) -> DataFrame:
    """Totals in one aggregation pass.

    Active sessions / tasks are row counts of the given tables; their rows are
    unioned in as markers so everything is one aggregate (no join).
    """
    a = latest(audit, cap).select("event", "pii_count", F.lit(0).alias("_s"), F.lit(0).alias("_t"))
    parts = [a]
    if active_sessions is not None:
        parts.append(active_sessions.select(F.lit(None).cast("string").alias("event"), F.lit(None).cast("bigint").alias("pii_count"),
                                            F.lit(1).alias("_s"), F.lit(0).alias("_t")))
    if active_tasks is not None:
        parts.append(active_tasks.select(F.lit(None).cast("string").alias("event"), F.lit(None).cast("bigint").alias("pii_count"),
                                         F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(
        F.coalesce(F.sum(F.when(_is(R.FILE_EVENTS), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("total_files"),
        F.coalesce(F.sum(F.when(_is(R.TASK_EVENTS), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("total_tasks"),
        F.coalesce(F.sum(F.when(_is(R.FILE_EVENTS), F.coalesce(F.col("pii_count"), F.lit(0))).otherwise(0)), F.lit(0)).cast("bigint").alias(
            "total_pii_detected"
        ),
        F.coalesce(F.sum(F.when(_is(R.INCIDENT_EVENTS), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("security_incidents"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast("bigint").alias("active_sessions"),
        F.coalesce(F.sum("_t"), F.lit(0)).cast("bigint").alias("active_tasks"),
    )


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` (a row per type, provider or day) with its rank in the report's order."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def pii_breakdown(audit: DataFrame, top: int | None = None, cap: int | None = None) -> DataFrame:
    """A4: number of upload events naming each type (not spans), most named first; ties by type.

    ``top`` keeps the first so many.
    """
    a = latest(audit, cap).filter(_is(R.FILE_EVENTS))
    ex = a.select(F.explode_outer(F.array_distinct("pii_types")).alias("type")).filter(F.col("type").isNotNull())
    counts = ex.groupBy("type").agg(F.count(F.lit(1)).alias("n_events"))
    order = [F.col("n_events").desc(), F.col("type")]
    return _ranked(counts.orderBy(*order).limit(top) if top is not None else counts, *order)


def provider_usage(audit: DataFrame, cap: int | None = None) -> DataFrame:
    """A5: task events per provider (missing -> 'unknown'), most used first; ties by name."""
    a = latest(audit, cap).filter(_is(R.TASK_EVENTS))
    counts = a.groupBy(F.coalesce(F.col("provider"), F.lit("unknown")).alias("provider")).agg(F.count(F.lit(1)).alias("n_tasks"))
    return _ranked(counts, F.col("n_tasks").desc(), F.col("provider"))


def day_of(ts: Column) -> Column:
    """First 10 characters of the ISO timestamp; 'unknown' when there is none."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))


def daily_activity(audit: DataFrame, days: int | None = None, cap: int | None = None) -> DataFrame:
    """Uploads + texts + tasks per day in ascending order; ``days`` keeps the last so many with activity."""
    a = latest(audit, cap).filter(_is(R.FILE_EVENTS + R.TASK_EVENTS))
    per_day = a.groupBy(day_of(F.col("timestamp")).alias("date")).agg(F.count(F.lit(1)).alias("n_events"))
    return _ranked(per_day.orderBy(F.col("date").desc()).limit(days) if days is not None else per_day, F.col("date"))


def audit_count(audit_lines: DataFrame) -> DataFrame:
    """Non-blank lines (malformed ones included) of a raw JSONL text table (column ``value``)."""
    return audit_lines.filter(F.col("value").rlike(r"\S")).agg(F.count(F.lit(1)).alias("n_entries"))


def audit_page(audit: DataFrame, offset: int = 0, limit: int = 100, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Newest first, rows [offset, offset+limit).  A limit outside 1..1000 or a negative offset is an error.

    A deep page sorts only the part of the log that holds it (``ordering.page``).
    """
    if not 1 <= int(limit) <= R.AUDIT_PAGE_MAX:
        raise ValueError(f"limit must be 1 to {R.AUDIT_PAGE_MAX}, not {limit}")
    if int(offset) < 0:
        raise ValueError(f"offset must not be negative, not {offset}")
    return page(audit, ["timestamp", "event_id"], int(offset), int(limit), range_rows)


def event_label(event: Column) -> Column:
    """P20: display label; unknown events show their own name."""
    kv: list[Column] = []
    for k, v in R.EVENT_LABEL.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), event), event)


def event_color(event: Column) -> Column:
    """P20: colour class by substring, first match wins.  The words and class names are FIXED VALUES of the data model."""
    return (
        F.when(event.contains("failed"), "text-red-400")
        .when(event.contains("uploaded") | event.contains("created"), "text-blue-400")
        .when(event.contains("complete") | event.contains("received"), "text-green-400")
        .otherwise("text-pp-text-muted")
    )


def boundary_alerts(audit: DataFrame) -> DataFrame:
    """Events flagged as data having left the boundary (critical)."""
    return audit.filter(F.col("data_left_boundary"))


def _csv_field(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    s2 = F.replace(s, F.lit('"'), F.lit('""'))
    return F.when(s2.rlike('[,"\n]'), F.concat(F.lit('"'), s2, F.lit('"'))).otherwise(s2)


CSV_COLUMNS = [
    "timestamp", "event", "data_left_boundary", "session_id", "user", "filename",
    "pii_count", "pii_types", "provider", "model",
]


def csv_value(name: str) -> Column:
    """Text form of one audit field as the service would print it."""
    c = F.col(name)
    if name == "timestamp":
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    if name == "data_left_boundary":
        return F.when(c, "True").when(~c, "False")
    if name == "pii_types":
        return F.when(c.isNotNull(), F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))
    return c.cast("string")


def audit_csv_lines(audit: DataFrame, cap: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """(line_no, event_id, line): the header at 0, then one CSV line per event, newest first.

    Numbers come from a range sort of the keys and the sizes of its runs, so the events
    are never in one task, whatever their timestamps.  ``cap`` reproduces the export limit.
    """
    cols = columns or CSV_COLUMNS
    a = latest(audit, cap)
    body = a.select("event_id", "timestamp", F.concat_ws(",", *[_csv_field(csv_value(c)) for c in cols]).alias("line"))
    newest = ["timestamp", "event_id"]
    numbered = numbered_in_order(body, newest, [F.col(c).desc() for c in newest], "line_no")
    header = audit.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("line_no"), F.lit(None).cast("bigint").alias("event_id"), F.lit(",".join(cols)).alias("line"))
    return header.unionByName(numbered.select("line_no", "event_id", "line"))


def resolve_model(provider: Column, requested: Column) -> Column:
    """Requested model, or the provider's default when blank."""
    kv: list[Column] = []
    for k, v in R.DEFAULT_MODEL.items():
        kv += [F.lit(k), F.lit(v)]
    default = F.coalesce(F.try_element_at(F.create_map(*kv), provider), F.lit(""))
    req = F.trim(F.coalesce(requested, F.lit("")))
    return F.when(req == "", default).otherwise(req)


def client_ip(xff: Column, peer: Column) -> Column:
    """First X-Forwarded-For element, else the peer address, else 'unknown'."""
    first = F.trim(F.split(xff, ",").getItem(0))
    return F.coalesce(F.when(F.coalesce(xff, F.lit("")) != "", first), peer, F.lit("unknown"))


def csv_header(json_lines: DataFrame, order_cols: tuple[str, str] = ("timestamp", "event_id")) -> DataFrame:
    """Union of the keys of all JSON records, in first-seen order when reading newest first.

    A key's first appearance is in the newest record holding it, at its
    position in that record.  Computed as a per-key aggregate (one row per
    distinct key), never by walking records on the driver.  Output (key, ordinal).
    """
    ts, eid = order_cols
    keys = json_lines.select(ts, eid, F.posexplode(F.json_object_keys("value")).alias("pos", "key"))
    first = keys.groupBy("key").agg(
        F.max(F.struct(F.col(ts).alias("ts"), F.col(eid).alias("eid"), (-F.col("pos")).alias("neg_pos"))).alias("first")
    )
    order = [F.col("first.ts").desc(), F.col("first.eid").desc(), F.col("first.neg_pos").desc()]
    # one row per distinct key (a few dozen)
    return first.select("key", F.row_number().over(Window.orderBy(*order)).alias("ordinal"))
