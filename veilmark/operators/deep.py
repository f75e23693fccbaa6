"""Second-stage ("deep") detection from externally supplied candidates.

The language model itself is outside the engine: its replies arrive as a
table ``(doc_id, reply)``.  Everything after the reply is Catalyst:

* P12 ``salvage``: first ``[`` .. last ``]``, parsed as a JSON array, keeping
  objects with non-blank ``text`` and a ``type``; anything unparsable -> [].
* P9  ``align``: every case-insensitive literal occurrence of each candidate in
  the *whole* text (replies are produced from fragments that cover it, P13).
* P10 declension fallback when a candidate has no literal hit.
* P11 merge: drop spans overlapping (theta .5) existing or earlier new spans.

All per-row: candidates stay inside their document's row, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions import spans as S
from veilmark.functions.arrays import cut, let, text_blocks

_ITEM = "struct<text:string,type:string>"


def fragments(text: Column, size: int = R.DEEP_FRAGMENT_CHARS, overlap: int = 200) -> Column:
    """The whole text as consecutive fragments of ``size`` characters, each shown to the model.

    Neighbours share ``overlap`` characters, so a value of up to that length is whole
    in one of them; every character of the text is in a fragment.
    """
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    return let(text_blocks(text), lambda blocks: F.transform(
        F.sequence(F.lit(0), last), lambda k: cut(blocks, k * step, F.least(k * step + size, F.length(text)))))


def salvage_all(replies: Column) -> Column:
    """P12 over the replies to all fragments of a text: their candidates, each once, in order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(replies, salvage)))


def salvage(reply: Column) -> Column:
    """Reply -> array<struct<text,type>> (stripped text, blank and incomplete items dropped)."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0)
    elems = F.from_json(F.when(body != "", body), "array<string>")
    items = F.transform(F.coalesce(elems, F.array().cast("array<string>")), lambda e: F.from_json(e, _ITEM))
    kept = F.filter(items, lambda it: it.isNotNull() & it["text"].isNotNull() & it["type"].isNotNull())
    cleaned = F.transform(
        kept,
        lambda it: F.struct(F.regexp_replace(it["text"], r"(?U)^\s+|\s+$", "").alias("text"), it["type"].alias("type")),
    )
    return F.filter(cleaned, lambda it: it["text"] != "")


def _literal_regex(value: Column) -> Column:
    return S.literal_pattern(value)


def _fuzzy_regex(value: Column) -> Column:
    core = F.when(F.length(value) > 4, F.substring(value, 1, F.length(value) - 1)).otherwise(value)
    return F.concat(S.literal_pattern(core), F.lit(f"[{R.DECLENSION_LETTERS}]{{0,3}}"))


def align(text: Column, items: Column) -> Column:
    """Spans (score .6, source deep) of every candidate; rank = candidate index."""

    def one(it: Column, i: Column) -> Column:
        lit_hits = S.extract_spans(text, _literal_regex(it["text"]), it["type"], score=R.DEEP_SCORE, source="deep",
                                   rank=i, strip=False)
        fuzzy = S.extract_spans(text, _fuzzy_regex(it["text"]), it["type"], score=R.DEEP_SCORE, source="deep",
                                rank=i, strip=False)
        # bind the literal hits once (a lambda parameter), instead of evaluating them twice
        pick = F.transform(
            F.array(lit_hits),
            lambda h: F.when(F.size(h) > 0, h).when(F.length(it["text"]) > 3, fuzzy).otherwise(S.empty_spans()),
        )
        return F.element_at(pick, 1)

    return F.flatten(F.transform(items, one))


def new_spans(existing: Column, candidates: Column) -> Column:
    """Candidate spans not duplicating (theta .5) existing spans or earlier new ones."""
    existing_i = F.transform(
        F.coalesce(existing, F.array().cast(S.PUBLIC_SPANS_TYPE)),
        lambda s: F.struct(*[s[f].alias(f) for f in S.PUBLIC_SPAN_FIELDS], F.lit(-1).alias("rank")),
    )
    kept = S.greedy_keep(candidates, R.THETA_ACROSS, seed=existing_i)
    # existing spans carry rank -1; keep only the new ones (``kept`` is referenced once)
    return F.filter(kept, lambda s: s["rank"] >= 0)


def with_new_spans(df: DataFrame, text_col: str = "text", spans_col: str = "spans", replies_col: str = "replies", out: str = "deep_spans") -> DataFrame:
    """``df`` with the new spans that the replies to its text's fragments give (each step a column of its own)."""
    items, found = f"_{out}_items", f"_{out}_found"
    staged = df.withColumn(items, salvage_all(F.col(replies_col))).withColumn(found, align(F.col(text_col), F.col(items)))
    return staged.withColumn(out, S.public(new_spans(F.col(spans_col), F.col(found)))).drop(items, found)


def deep_merge(df: DataFrame, text_col: str = "text", spans_col: str = "spans", replies_col: str = "replies") -> DataFrame:
    """Append the new spans to the existing ones and mark the deep scan done."""
    return with_new_spans(df, text_col, spans_col, replies_col).withColumn(
        spans_col, F.concat(F.col(spans_col), F.col("deep_spans"))
    ).withColumn("deep_scan_completed", F.lit(True))


# -- guard ---------------------------------------------------------------------


def guard_verdict(instruction: Column, reply: Column, strict: bool = False) -> Column:
    """True = safe.  Blank instruction safe; missing reply (error/timeout) blocks;
    blocked iff the upper-cased reply names the threat word and not the clean word.
    ``strict`` blocks anything but an explicit clean verdict (fail-closed)."""
    up = F.upper(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?U)^\s+|\s+$", ""))
    threat = up.contains(R.GUARD_THREAT_WORD) & ~up.contains(R.GUARD_CLEAN_WORD)
    verdict = up.contains(R.GUARD_CLEAN_WORD) & ~up.contains(R.GUARD_THREAT_WORD) if strict else ~threat
    blank = F.regexp_replace(F.coalesce(instruction, F.lit("")), r"(?U)\s", "") == ""
    return F.when(blank, F.lit(True)).when(reply.isNull(), F.lit(False)).otherwise(verdict)


def guard_rules(spans: Column) -> Column:
    """Deterministic guard — unsafe when any span has a critical identity type."""
    crit = F.array(*[F.lit(t) for t in R.GUARD_CRITICAL_TYPES])
    return ~F.exists(spans, lambda s: F.array_contains(crit, s["type"]))
