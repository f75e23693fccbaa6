"""Span algebra as Catalyst expressions (no Python on the rows).

A span is ``STRUCT<text, type, start, end, score, source, rank>`` with
half-open code-point offsets ``[start, end)``.  ``rank`` orders rules for
equal-length ties and is dropped when spans leave the engine.

Offsets come from one walk that marks the matches in the text
(``regexp_replace``); cut at the marks, piece *k* is match *k* with the text up
to the next one (piece 0: the text before the first) and

    start_k = sum(len(piece_0..k-1))

``length`` counts code points, so offsets are Python-compatible even with
characters outside the BMP (a JVM matcher would count UTF-16 units).
Everything is row-local: detection never shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.arrays import FEW, indices, let, prefix_scan
from veilmark.functions.rules import Rule

SPAN_TYPE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
SPANS_TYPE = T.ArrayType(SPAN_TYPE)
PUBLIC_SPAN_FIELDS = ["text", "type", "start", "end", "score", "source"]
PUBLIC_SPANS_TYPE = T.ArrayType(T.StructType([f for f in SPAN_TYPE.fields if f.name in PUBLIC_SPAN_FIELDS]))

# Java regex flags: case-insensitive with Unicode case folding, Unicode
# character classes (so \b, \s, \w, \d behave like Python's str patterns).
JAVA_FLAGS = "(?iU)"

# Marks set around matches; texts that have such characters themselves, or empty matches, are walked twice.
MATCH_START, MATCH_END = "\x01", "\x02"


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def java_pattern(pattern: str, flags: str = JAVA_FLAGS) -> str:
    return f"{flags}{pattern}"


def _span(text: Column, type_: Column, start: Column, score: Column, source: Column, rank: Column) -> Column:
    return F.struct(
        text.alias("text"),
        type_.alias("type"),
        start.cast("int").alias("start"),
        (start + F.length(text)).cast("int").alias("end"),
        score.cast("double").alias("score"),
        source.alias("source"),
        rank.cast("int").alias("rank"),
    )


def extract_spans(
    text: Column,
    pattern: str | Column,
    type_: str | Column,
    *,
    score: float | Column,
    source: str | Column,
    rank: int | Column = 0,
    strip: bool = True,
    needs: str | None = None,
) -> Column:
    """Every non-overlapping match of ``pattern`` in ``text`` as spans.

    ``pattern`` is a complete Java regex (flags included) or a column of them
    (used for per-row literal candidates).  With ``strip`` the match is cut
    of surrounding whitespace, offsets moved accordingly, empty ones dropped.
    ``needs`` is a cheap pattern that every text with a match contains.  Texts
    are walked once; running offsets cost no array copies.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    tcol = F.lit(type_) if isinstance(type_, str) else type_
    scol = F.lit(score) if not isinstance(score, Column) else score
    ocol = F.lit(source) if isinstance(source, str) else source
    rcol = F.lit(rank) if not isinstance(rank, Column) else rank

    def span(m: Column, start: Column) -> Column:
        return _span(m, tcol, start, scol, ocol, rcol)

    def marked(pieces: Column) -> Column:
        """Spans of the pieces of a text cut before each match; a match ends at its mark."""
        lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1))
        only = F.array(span(F.substring_index(F.get(pieces, F.lit(1)), MATCH_END, 1), F.length(F.get(pieces, F.lit(0)))))
        return F.when(F.size(pieces) == 1, empty_spans()).when(F.size(pieces) == 2, only).otherwise(let(lengths, lambda ls: let(prefix_scan(ls, "sum"), lambda before: F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: span(F.substring_index(p, MATCH_END, 1), F.get(before, i + 1))))))

    def placed(m: Column, steps: Column) -> Column:
        """Spans of the matches ``m``; ``steps`` are their lengths with the text since the match before."""
        return let(steps, lambda st: let(prefix_scan(st, "sum"), lambda before: F.transform(
            m, lambda t, i: span(t, F.get(before, i) + F.get(st, i) - F.length(t)))))

    def found(m: Column) -> Column:
        # a split compiles its pattern for every text, so it is left to patterns with empty matches
        pieces = F.transform(F.regexp_extract_all(text, F.concat(F.lit(r"\G(?s:.*?)(?:"), pat, F.lit(")")), 0), lambda p: F.length(p))
        split = F.zip_with(F.slice(F.transform(F.split(text, pat, -1), lambda g: F.length(g)), F.lit(1), F.size(m)), m, lambda g, t: g + F.length(t))
        return F.when(F.size(m) > 0, placed(m, F.when(F.array_contains(m, ""), split).otherwise(pieces))).otherwise(empty_spans())

    twice = let(F.regexp_extract_all(text, pat, 0), found)
    own_marks = F.contains(text, F.lit(MATCH_START)) | F.contains(text, F.lit(MATCH_END))
    # an empty match may be between the halves of a wide character, where no mark can stand
    once = let(F.regexp_replace(text, pat, F.lit(f"{MATCH_START}$0{MATCH_END}")), lambda m: F.when(
        F.contains(m, F.lit(MATCH_START + MATCH_END)), twice).otherwise(let(F.split(m, MATCH_START, -1), marked)))
    raw = F.when(text.isNull() | own_marks, twice).otherwise(once)
    if strip:
        raw = F.filter(F.transform(raw, strip_span), lambda s: F.length(s["text"]) > 0)
    return F.when(text.rlike(needs), raw).otherwise(empty_spans()) if needs else raw


def may_match_space(pattern: str) -> bool:
    """Whether a match could start or end with whitespace (only then is stripping needed).

    Conservative scan: whitespace classes, a literal space, negated classes,
    ``\\W``/``\\D``/``\\S``/``\\h``/``\\v``/``\\R``/``\\p``/``\\P`` and an unescaped ``.``
    outside a character class all count as "may match whitespace".
    """
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            if pattern[i + 1] in "sSWDhvRpP":
                return True
            i += 2
            continue
        if ch == " ":
            return True
        if ch == "[":
            if pattern[i + 1: i + 2] == "^":
                return True
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "." and not in_class:
            return True
        i += 1
    return False


def strip_span(s: Column) -> Column:
    """Trim Unicode whitespace from a span's text and move its offsets."""
    lead = F.length(F.regexp_extract(s["text"], r"(?U)^\s*", 0))
    stripped = F.regexp_replace(s["text"], r"(?U)^\s+|\s+$", "")
    cut = _span(stripped, s["type"], s["start"] + lead, s["score"], s["source"], s["rank"])
    return F.when(s["text"].rlike(r"(?U)^\s|\s$"), cut).otherwise(s)


def extract_rules(text: Column, rules: Sequence[Rule], *, rank_offset: int = 0, flags: str = JAVA_FLAGS) -> Column:
    """All rules, concatenated in rule order (then position): R1 over a rule list."""
    parts = []
    # a condition that all rules share is checked once, by the caller
    shared = len({r.needs for r in rules}) == 1
    for i, r in enumerate(rules):
        pattern = f"(?=(?-i:{r.begins}))(?:{r.pattern})" if r.begins else r.pattern
        sp = extract_spans(text, java_pattern(pattern, flags), r.type, score=r.score, source=r.source,
                           rank=rank_offset + i, strip=may_match_space(r.pattern), needs=None if shared else r.needs)
        if r.validator == "luhn":
            sp = F.filter(sp, lambda s: luhn_valid(s["text"]))
        elif r.validator:
            raise ValueError(f"unknown validator {r.validator!r}")
        parts.append(sp)
    if not parts:
        return empty_spans()
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def luhn_valid(value: Column) -> Column:
    """Luhn checksum over the digits of ``value`` (separators ignored)."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, r"[^0-9]", "")), ""), lambda d: d != "")
    weighted = F.transform(
        digits,
        lambda d, i: let(d.try_cast("int"), lambda v: F.when(i % 2 == 0, v).when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x)
    return (F.size(digits) > 0) & (total % 10 == 0)


def span_len(s: Column) -> Column:
    return s["end"] - s["start"]


def overlaps(a: Column, b: Column, theta: float) -> Column:
    """Positive overlap and overlap / min(len) >= theta (theta=0: any overlap)."""
    # a positive overlap means that neither is empty; most pairs fail the first comparisons
    ov = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    ok = (a["start"] < b["end"]) & (b["start"] < a["end"]) & (ov > 0)
    if theta <= 0:
        return ok
    return ok & (ov / F.when(ov > 0, F.least(span_len(a), span_len(b))).otherwise(F.lit(1)) >= F.lit(theta))


def _sort_by_key(spans: Column, key) -> Column:
    """Sort by a computed struct key using the natural ordering (no comparator lambda per comparison)."""
    keyed = F.transform(spans, lambda s: F.struct(key(s).alias("k"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda x: x["s"])


def _sort_by_number(spans: Column, key) -> Column:
    """Sort by a whole number from 0 to 2**31 - 1, then by place in the array; numbers are compared, not structs."""
    keys = F.sort_array(F.transform(spans, lambda s, i: F.shiftleft(key(s).cast("bigint"), 32) + i))
    return F.transform(keys, lambda k: F.get(spans, k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))


def by_length_desc(spans: Column, in_order: bool = False) -> Column:
    """Longest first; ties by rule rank, then position (a stable sort of rule order).

    ``in_order``: the spans come by rank, then position, as those of :func:`extract_rules` do.
    """
    if in_order:
        return let(spans, lambda a: F.when(F.size(a) <= 1, a).otherwise(_sort_by_number(a, lambda s: F.lit(2**31 - 1) - s["end"] + s["start"])))
    return _sort_by_key(
        spans, lambda s: F.struct((s["start"] - s["end"]).alias("neg_len"), s["rank"].alias("rank"), s["start"].alias("start"))
    )


def by_start(spans: Column) -> Column:
    return _sort_by_key(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _clusters(spans: Column) -> Column:
    """Start-sorted spans as arrays of those that overlap one another in a chain."""
    def cut(heads: Column, n: Column) -> Column:
        return F.transform(heads, lambda h, k: F.slice(spans, h + 1, F.coalesce(F.get(heads, k + 1), n) - h))

    def split(reach: Column) -> Column:
        return let(
            F.filter(indices(F.size(spans)), lambda i: F.coalesce(F.get(spans, i)["start"] >= F.get(reach, i), F.lit(True))),
            lambda heads: cut(heads, F.size(spans)),
        )

    return let(F.transform(spans, lambda s: s["end"]), lambda ends: let(prefix_scan(ends, "max"), split))


def _placed(spans: Column, place) -> Column:
    """Spans with their place in the order of priority, sorted by position."""
    return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), place(i).alias("place"), s.alias("s")))


def _by_cluster(items: Column, resolve) -> Column:
    """``resolve`` (items in order of priority -> kept items) applied to each cluster; kept spans in order of priority.

    Only spans of one cluster can overlap, so the greedy pass never looks at more.
    """
    def ordered(c: Column) -> Column:
        keyed = F.sort_array(F.transform(c, lambda x: F.struct(x["place"].alias("place"), x.alias("x"))))
        return F.transform(keyed, lambda k: k["x"])

    def each(c: Column) -> Column:
        return F.when(F.size(c) == 1, c).otherwise(resolve(ordered(c)))

    def all_of(sorted_items: Column) -> Column:
        kept = F.flatten(F.transform(_clusters(sorted_items), each))
        return F.transform(ordered(kept), lambda x: x["s"])

    return let(F.sort_array(items), all_of)


def _item_type(elem: T.ArrayType) -> str:
    return f"array<struct<start:int,end:int,place:int,s:{elem.elementType.simpleString()}>>"


def greedy_keep(candidates: Column, theta: float, seed: Column | None = None, elem=SPANS_TYPE) -> Column:
    """Keep each candidate (in array order) unless it overlaps a kept one.

    With ``seed`` the kept list starts with those spans (which are all kept).
    ``elem`` is the array type of the candidates (internal spans by default).
    """
    init = F.array().cast(_item_type(elem))

    def resolve(items: Column) -> Column:
        return F.aggregate(items, init, lambda acc, x: F.when(
            (x["place"] >= 0) & F.exists(acc, lambda k: overlaps(x["s"], k["s"], theta)), acc).otherwise(F.concat(acc, F.array(x))))

    def small(c: Column, start: Column) -> Column:
        return F.aggregate(c, start, lambda acc, s: F.when(
            F.exists(acc, lambda k: overlaps(s, k, theta)), acc).otherwise(F.concat(acc, F.array(s))))

    if seed is None:
        return let(candidates, lambda c: F.when(F.size(c) <= 1, c).when(F.size(c) <= FEW, small(c, F.array().cast(elem))).otherwise(
            _by_cluster(_placed(c, lambda i: i), resolve)))

    def merged(pair: Column) -> Column:
        sd, c = pair["seed"], pair["c"]
        every = F.concat(_placed(sd, lambda i: i - F.size(sd)), _placed(c, lambda i: i))
        return F.when(F.size(c) == 0, sd).when(F.size(sd) + F.size(c) <= FEW, small(c, sd)).otherwise(_by_cluster(every, resolve))

    return let(F.struct(seed.alias("seed"), candidates.alias("c")), merged)


def dedup_within(spans: Column, theta: float = 0.1, in_order: bool = False) -> Column:
    """R2: longest first, drop a span overlapping a kept one by >= theta."""
    return greedy_keep(by_length_desc(spans, in_order), theta)


def merge_stages(base: Column, added: Column, theta: float = 0.5) -> Column:
    """Base spans all kept; ``added`` appended unless duplicate of base or earlier added."""
    return greedy_keep(added, theta, seed=base)


def _uncovered(x: Column, kept: Column) -> Column:
    """Parts [a, b) of a span that no kept item covers."""
    part = "array<struct<a:int,b:int>>"

    def minus(parts: Column, k: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.filter(
            F.array(F.struct(p["a"].alias("a"), F.least(p["b"], k["start"]).alias("b")),
                    F.struct(F.greatest(p["a"], k["end"]).alias("a"), p["b"].alias("b"))),
            lambda q: q["a"] < q["b"])))

    return F.aggregate(kept, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b"))).cast(part), minus)


def make_disjoint(spans: Column, elem=PUBLIC_SPANS_TYPE) -> Column:
    """Last pass before masking: disjoint spans that cover every character that any span covers.

    Of overlapping spans the earlier in the array keeps its place; a later one is
    cut to the parts that are not covered yet (parts of white space only are left out).
    """
    init = F.array().cast(_item_type(elem))
    rest = [f.name for f in elem.elementType.fields if f.name not in ("text", "start", "end")]

    def part(x: Column, q: Column) -> Column:
        fields = {"text": F.substring(x["s"]["text"], q["a"] - x["start"] + 1, q["b"] - q["a"]), "start": q["a"], "end": q["b"],
                  **{f: x["s"][f] for f in rest}}
        s = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in elem.elementType.fields])
        return F.struct(q["a"].alias("start"), q["b"].alias("end"), x["place"].alias("place"), s.alias("s"))

    def resolve(items: Column) -> Column:
        return F.aggregate(items, init, lambda acc, x: F.concat(acc, F.filter(
            F.transform(_uncovered(x, acc), lambda q: part(x, q)), lambda y: y["s"]["text"].rlike(r"(?U)\S"))))

    def merged(all_: Column) -> Column:
        whole = F.transform(resolve(all_), lambda x: x["s"])
        return F.when(F.size(all_) <= 1, F.transform(all_, lambda x: x["s"])).when(F.size(all_) <= FEW, whole).otherwise(_by_cluster(all_, resolve))

    def apart(a: Column) -> Column:
        """Are start-sorted spans whole, none of white space only, and no two of them over one character?"""
        return F.forall(F.transform(a, lambda s, i: (s["start"] < s["end"]) & (F.length(s["text"]) == s["end"] - s["start"]) & s["text"].rlike(r"(?U)\S")
                                    & ((i == 0) | (s["start"] >= F.get(a, F.greatest(i - 1, F.lit(0)))["end"]))), lambda ok: F.coalesce(ok, F.lit(False)))

    # spans that are apart have no equal starts
    def disjoint(given: Column) -> Column:
        return let(_sort_by_number(given, lambda s: s["start"]), lambda a: F.when(apart(a), a).otherwise(by_start(let(_placed(given, lambda i: i), merged))))

    return let(spans, disjoint)


def public(spans: Column) -> Column:
    """Drop the internal rank field."""
    return F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in PUBLIC_SPAN_FIELDS]))


def literal_pattern(value: Column, flags: str = JAVA_FLAGS) -> Column:
    r"""Case-insensitive literal pattern of a column value (``\Q...\E`` quoting)."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(flags), quoted)
