"""PII summaries.

``pii_summary`` is computed per document row with higher-order functions on
the span array, so the per-document grouping needs no shuffle at all; only
the corpus roll-up (``pii_rollup``) aggregates across rows, with map-side
partial aggregation over a handful of (severity, type) keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions.arrays import explode_kept


def pii_summary(docs_with_spans: DataFrame, key: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """A1: per (document, type): span count, sorted distinct non-empty matches, label, severity.

    Ordered critical -> warning -> info within a document by ``severity_rank``.
    """
    sp = F.col(spans_col)
    types = F.array_distinct(F.transform(sp, lambda s: s["type"]))
    per_type = F.transform(
        types,
        lambda t: F.struct(
            t.alias("type"),
            F.size(F.filter(sp, lambda s: s["type"] == t)).alias("n_spans"),
            F.array_sort(
                F.array_distinct(
                    F.filter(F.transform(F.filter(sp, lambda s: s["type"] == t), lambda s: s["text"]), lambda x: F.length(x) > 0)
                )
            ).alias("matches"),
        ),
    )
    out = docs_with_spans.select(key, explode_kept(per_type).alias("t")).filter(F.col("t").isNotNull()).select(key, "t.*")
    sev = R.type_severity(F.col("type"))
    return out.select(
        key,
        "type",
        R.type_label(F.col("type")).alias("label"),
        sev.alias("severity"),
        R.severity_rank(sev).alias("severity_rank"),
        "n_spans",
        F.array_join("matches", "|").alias("matches"),
    )


def pii_rollup(spans: DataFrame) -> DataFrame:
    """A11 at corpus level: spans per (severity, type) with severity subtotals and a grand total."""
    sev = R.type_severity(F.col("type"))
    return (
        spans.select(sev.alias("severity"), "type")
        .rollup("severity", "type")
        .agg(F.count(F.lit(1)).alias("n_spans"))
    )


def with_type_dim(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Label / severity / prefix with defaults, as literal-map lookups (no join, no shuffle)."""
    t = F.col(type_col)
    sev = R.type_severity(t)
    return df.select(
        "*",
        R.type_label(t).alias("label"),
        sev.alias("severity"),
        R.severity_rank(sev).alias("severity_rank"),
        R.token_prefix(t).alias("prefix"),
    )
