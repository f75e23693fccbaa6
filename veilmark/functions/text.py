"""Text helpers for what leaves the engine: file names and error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: error-message scrubbing patterns, applied in this order, and their labels
ERROR_SCRUBBERS = [
    (r"\b\d{11}\b", "[PESEL]"),
    (r"\b\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b", "[PHONE]"),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[EMAIL]"),
    (r"\b[A-Z]{2}\d{2}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}\b", "[IBAN]"),
]
TRUNCATION_MARK = "...[truncated]"
MASKED_NAME = "***"


def sanitize_filename(name: Column) -> Column:
    """M16: '***' + lower-cased suffix (no suffix -> '***')."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\]+?(\.[^./\\]+)$", 1))
    return F.concat(F.lit(MASKED_NAME), ext)


def sanitize_error(error: Column, max_length: int | None = None) -> Column:
    """Scrub identifiers; with ``max_length`` cut to it and mark the cut.

    The scrubbing runs on the whole message before the cut, so a value split
    by the cut can never leak half-masked.
    """
    s = F.coalesce(error, F.lit(""))
    for pat, label in ERROR_SCRUBBERS:
        s = F.regexp_replace(s, "(?U)" + pat, label)
    if max_length is None:
        return s
    cut = F.substring(s, 1, max_length)
    return F.when(F.length(s) > max_length, F.concat(cut, F.lit(TRUNCATION_MARK))).otherwise(cut)
