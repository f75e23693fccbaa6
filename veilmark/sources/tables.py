"""Table access and the fixed projections of the driver's tables onto the PII data model.

The driver's tables stand in for the service's data:

* ``documents``      -> files (file_id = doc_id, owner = source, language = lang)
* ``conversations``  -> chat turns (conv_id, turn, role, text)
* ``events``         -> the audit log (see ``audit_events``)
* ``orders``         -> task records of the conversations (task_id = conv_id = o_orderkey)

Every projection is a plain column expression, so the same rows are produced by
the SQL oracle (``veilmark.plans.oracle``) and by Spark.  All reads go through
``spark.read.parquet`` so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import rules

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# ---------------------------------------------------------------------------
# FIXED VALUES of the events -> audit projection (shared with the SQL oracle)
# ---------------------------------------------------------------------------
EVENT_TYPE_MAP = {
    "click": "file_uploaded",
    "view": "text_submitted",
    "purchase": "task_created",
    "error": "auth_failed",
    "signup": "security_incident",
}
# PII types an upload event reports: two picks from this list by the event's k.
AUDIT_PII_TYPES = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "PESEL", "LOCATION", "DATE_TIME",
    "CREDIT_CARD", "CRYPTO", "IP_ADDRESS", "NIP", "REGON", "KRS",
]
AUDIT_FILE_EXTS = [".docx", ".xlsx", ".pdf", ".eml", ".txt"]
# A task event above this value is recorded as data having left the boundary.
BOUNDARY_VALUE = 200.0
# orders.o_orderstatus -> task status
ORDER_STATUS_MAP = {"F": "completed", "O": "processing", "P": "failed"}
# end of fixed values


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def _map_lit(d: dict[str, str]) -> Column:
    kv: list[Column] = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit schema as a projection of ``events`` (one row per event).

    Columns: event_id, timestamp, event, data_left_boundary, session_id, user,
    filename, pii_count, pii_types, provider, model.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    event = F.coalesce(F.try_element_at(_map_lit(EVENT_TYPE_MAP), F.col("event_type")), F.col("event_type"))
    is_file = event.isin(*rules.FILE_EVENTS)
    is_task = event.isin(*rules.TASK_EVENTS)
    provider = _pick(rules.PROVIDERS, k)
    types = F.array_distinct(F.array(_pick(AUDIT_PII_TYPES, k), _pick(AUDIT_PII_TYPES, k * 7 + 3)))
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("timestamp"),
        event.alias("event"),
        (is_task & (F.col("value") > F.lit(BOUNDARY_VALUE))).alias("data_left_boundary"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.when(is_file, F.concat(F.lit("***"), _pick(AUDIT_FILE_EXTS, k))).alias("filename"),
        F.when(is_file, k).alias("pii_count"),
        F.when(is_file, types).alias("pii_types"),
        F.when(is_task, provider).alias("provider"),
        F.when(is_task, requested_model(provider, k)).alias("model"),
    )


def requested_model(provider: Column, k: Column) -> Column:
    """Model named by a task request: blank for k >= 90 (use the default), the service's
    configured default id for 80 <= k < 90, else the provider's registry default."""
    return (
        F.when(k >= 90, F.lit(""))
        .when(k >= 80, F.lit(rules.CONFIGURED_DEFAULT_MODEL))
        .otherwise(F.try_element_at(_map_lit(rules.DEFAULT_MODEL), provider))
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per conversation, its record fields taken from the order with the same key.

    task_id = conv_id; owner = customer of the order; created_at = order date;
    last_activity_at = created_at + one minute per turn; provider/model by the order key.
    """
    conv = conversations(spark, sf_dir)
    per_conv = conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("turn").alias("last_turn"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    provider = _pick(rules.PROVIDERS, F.col("conv_id"))
    status = F.coalesce(F.try_element_at(_map_lit(ORDER_STATUS_MAP), F.col("o_orderstatus")), F.lit("unknown"))
    return per_conv.join(orders, per_conv.conv_id == orders.o_orderkey, "left").select(
        F.col("conv_id").alias("task_id"),
        F.col("conv_id").alias("file_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("user_id"),
        status.alias("status"),
        provider.alias("provider"),
        F.try_element_at(_map_lit(rules.DEFAULT_MODEL), provider).alias("model"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("message_count").cast("int"))).alias(
            "last_activity_at"
        ),
        F.col("message_count"),
    )


# FIXED VALUES: file name of a document by language ('en' = raw text submission)
FILE_EXT_BY_LANG = {"pl": ".docx", "de": ".pdf", "fr": ".xlsx"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file record per document (file_id = doc_id, owner = source)."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "source")
    ext = F.try_element_at(_map_lit(FILE_EXT_BY_LANG), F.col("lang"))
    name = F.when(ext.isNull(), F.lit(rules.TEXT_PLACEHOLDER_FILENAME)).otherwise(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    )
    return d.select(F.col("doc_id").alias("file_id"), name.alias("filename"), F.col("source").alias("owner"))


def task_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with ownership fields: failed tasks are legacy records without user id (username only)."""
    t = tasks(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_name").alias("username")
    )
    j = t.join(cust, "user_id", "left")
    return j.withColumn("user_id", F.when(F.col("status") == "failed", F.lit(None).cast("string")).otherwise(F.col("user_id")))
