"""Detection operators over a table of texts.

All of them are narrow projections: the span arrays are computed inside the
scan stage of the text table, no shuffle, and whole texts are searched.
``explode_spans`` turns the arrays into the long ``spans`` table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions import spans as S
from veilmark.functions.arrays import explode_kept, let, prefix_scan
from veilmark.operators.joins import hash_filter, may_hold
from veilmark.session import written


def base_spans(text: Column, recognizers: Sequence[R.Rule] | None = None, theta: float = R.THETA_WITHIN) -> Column:
    """P1 (re-aimed): stage-1 pattern recognizers, score >= 0.4, types remapped.

    Score and type are properties of a recognizer, so the threshold and the
    remap are resolved once when the expression is built, not per span.
    Overlapping stage-1 spans are resolved like rule spans (longest first) so
    the masker never sees two spans over the same characters.
    """
    recs = list(recognizers) if recognizers is not None else R.default_base_recognizers()
    recs = [
        R.Rule(R.TYPE_REMAP.get(r.type, r.type), r.pattern, r.score, r.source, r.validator, r.needs, r.begins)
        for r in recs
        if r.score >= 0.4
    ]
    return S.dedup_within(S.extract_rules(text, recs), theta, in_order=True)


def rule_spans_raw(text: Column, rules: Sequence[R.Rule] | None = None) -> Column:
    """R1 over P3-P8: all stripped matches of every business rule, rule order then position."""
    return S.extract_rules(text, list(rules) if rules is not None else R.business_rules(), rank_offset=100)


def rule_spans(text: Column, rules: Sequence[R.Rule] | None = None, theta: float = R.THETA_WITHIN) -> Column:
    """R2: business-rule spans after within-stage overlap suppression (longest first)."""
    return S.dedup_within(rule_spans_raw(text, rules), theta, in_order=True)


def with_spans(
    df: DataFrame, text_col: str = "text", out: str = "spans",
    recognizers: Sequence[R.Rule] | None = None, rules: Sequence[R.Rule] | None = None,
) -> DataFrame:
    """``df`` with the array of stage-1 spans, then rule spans that are not duplicates (theta .5).

    When every rule states what its matches need, texts that meet none of these
    conditions skip the whole expression; one rule without a condition switches
    that off.  The stages are columns of their own, so the analyzer resolves one
    nest of lambdas at a time; nothing is shuffled.
    """
    recs = list(recognizers) if recognizers is not None else R.default_base_recognizers()
    rls = list(rules) if rules is not None else R.business_rules()
    base, added = f"_{out}_base", f"_{out}_rules"
    staged = df.withColumn(base, _stage("base", text_col, tuple(recs))).withColumn(added, _stage("rules", text_col, tuple(rls)))
    merged = S.merge_stages(F.col(base), F.col(added), R.THETA_ACROSS)
    return staged.withColumn(out, S.public(merged)).drop(base, added)


def _stage(kind: str, text_col: str, rules: tuple[R.Rule, ...]) -> Column:
    return _built(kind, text_col, rules, id(SparkContext._gateway))


@lru_cache(maxsize=64)
def _built(kind: str, text_col: str, rules: tuple[R.Rule, ...], gateway: int) -> Column:
    """A stage's expression; putting it together takes thousands of calls to the JVM, so it is kept."""
    text = F.col(text_col)
    made = {"base": base_spans, "rules": rule_spans, "rules_raw": rule_spans_raw}[kind](text, rules)
    return _where_needed(text, rules, made)


def _where_needed(text: Column, rules: Sequence[R.Rule], spans: Column) -> Column:
    needs = [r.needs for r in rules]
    if not needs or None in needs:
        return spans
    any_of = "|".join(f"(?:{n})" for n in dict.fromkeys(needs))
    return F.when(text.rlike(any_of), spans).otherwise(S.empty_spans())


def explode_spans(df: DataFrame, keys: Sequence[str], spans_col: str = "spans") -> DataFrame:
    """Long ``spans`` table: (keys..., type, start, end, text, score, source)."""
    return df.select(*keys, explode_kept(F.col(spans_col)).alias("s")).filter(F.col("s").isNotNull()).select(
        *keys,
        F.col("s.type").alias("type"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.text").alias("text"),
        F.col("s.score").alias("score"),
        F.col("s.source").alias("source"),
    )


def detect(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("doc_id",), **kw) -> DataFrame:
    """Document table -> long spans table (the ``detect_all`` query)."""
    return explode_spans(with_spans(df.select(*keys, text_col), text_col, "spans", **kw), list(keys))


def detect_stage(df: DataFrame, stage: str, text_col: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One stage only: ``base`` (P1), ``rules_raw`` (R1), ``rules`` (R2)."""
    expr = _stage(stage, text_col, tuple(R.default_base_recognizers() if stage == "base" else R.business_rules()))
    return explode_spans(df.select(*keys, S.public(expr).alias("spans")), list(keys))


def pii_per_doc(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A2: number of spans and sorted distinct types per document (documents without PII included)."""
    spans = F.col("spans")
    return with_spans(df.select(key, text_col), text_col, "spans").select(
        F.col(key),
        F.size(spans).alias("total_pii"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"]))), ",").alias("pii_types"),
    )


def span_overlap_pairs(spans: DataFrame, key: str = "doc_id", theta: float = R.THETA_ACROSS, bin_size: int = 64) -> DataFrame:
    """R3/J7 as a table operator: all pairs of overlapping spans of the same document.

    A range self-join done without comparing all pairs of a document: every
    span is replicated into the fixed-width bins it covers, the join is on
    (key, bin), and a pair is reported only in the bin holding the start of
    the overlap, so each pair appears once.  Output: the pair, overlap length,
    ratio (overlap / shorter length) and whether it counts as a duplicate at
    ``theta``.  Spans of zero length never overlap.
    """
    cols = ["type", "start", "end", "text"]
    binned = spans.filter(F.col("end") > F.col("start")).select(
        key, *cols,
        F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("bin"),
    )
    a = binned.select(key, "bin", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = binned.select(key, "bin", *[F.col(c).alias(f"b_{c}") for c in cols])
    ov_start = F.greatest("a_start", "b_start")
    ov = F.least("a_end", "b_end") - ov_start
    pair_order = (F.col("a_start") < F.col("b_start")) | (
        (F.col("a_start") == F.col("b_start"))
        & ((F.col("a_end") < F.col("b_end")) | ((F.col("a_end") == F.col("b_end")) & (F.col("a_type") < F.col("b_type"))))
    )
    joined = a.join(b, [key, "bin"]).filter(pair_order & (ov > 0) & (F.floor(ov_start / bin_size) == F.col("bin")))
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    ratio = ov / shorter
    return joined.select(
        key,
        *[f"a_{c}" for c in cols],
        *[f"b_{c}" for c in cols],
        ov.alias("overlap"),
        F.round(ratio, 6).alias("ratio"),
        (ratio >= F.lit(theta)).alias("is_duplicate"),
    )


def candidate_spans(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every raw candidate of both stages (before any suppression), long form."""
    t = F.col(text_col)
    raw = F.concat(
        S.extract_rules(t, R.default_base_recognizers()),
        rule_spans_raw(t),
    )
    return explode_spans(df.select(key, S.public(raw).alias("spans")), [key])


def gazetteer_spans(
    texts: DataFrame, names: DataFrame, key: str = "doc_id", text_col: str = "text", score: float = R.DEEP_SCORE, source: str = "gazetteer",
    declined: bool = False,
) -> DataFrame:
    """P9 with a candidate table: long spans of every name (name, type) in every text.

    Names match case-insensitively between word boundaries and may have any number of
    words; of overlapping names the longest stays.  Texts stay where they are read: a
    place in a text is asked whether a name may begin there with this word, then whether
    the words that follow may be a name (``joins.hash_filter``, a digest of the names of
    bounded size).  What may be one goes, as its own few words, to the names with the same
    hash, where it is compared in full; no text and no name list is broadcast, and names
    that share a first word do not meet each other's texts.

    With ``declined`` (P10) a name that a text does not hold literally may have another
    ending: all but its last letter, then up to three letters (names of four letters
    are kept whole, shorter ones are not declined).  Names of one type and stem are one
    row there with their number: a text's hit on the stem counts while it holds fewer
    of them literally.
    """
    t = texts.select(F.col(key).alias("_key"), F.col(text_col).alias("_text"))
    forms, firsts, lengths = name_forms(names, declined)
    may = name_candidates(t, hash_filter(forms.select("_h").unionByName(firsts), "_h"), lengths, declined)

    # the whole comparison; the hash on which rows meet is not among the columns that travel
    met = may.join(forms, candidate_hash() == F.col("_h")).where((F.col("n") == F.col("_n")) & ((F.col("_cut") == LITERAL) == F.col("literal")))
    met = met.where(F.col("form") == _candidate_form())
    met = met.where(F.col("head").isNull() | (F.col("head") == F.lower(F.regexp_extract("text", R.WORD_PATTERN, 0))))

    def span(text: Column, kind: Column, start: Column, literal: Column) -> Column:
        return F.struct(text.alias("text"), kind.alias("type"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), F.lit(score).cast("double").alias("score"),
                        F.lit(source).alias("source"), F.when(literal, 0).otherwise(1).alias("rank")).cast(S.SPAN_TYPE)

    # a text's hits meet once, under its key; what all spans share is added there
    if declined:
        hits = met.select("_key", "type", "start", "text", "n", "head", "core", "form", "literal", "of").repartition("_key")
        hits = hits.withColumn("span", span(F.col("text"), F.col("type"), F.col("start"), F.col("literal")))
        stems = hits.groupBy("_key", "type", "n", "head", "core").agg(
            F.collect_set(F.when(F.col("literal"), F.col("span"))).alias("as_is"), F.collect_set(F.when(~F.col("literal"), F.col("span"))).alias("other"),
            F.size(F.collect_set(F.when(F.col("literal"), F.col("form")))).alias("held"), F.max("of").alias("of"))
        kept = stems.select("_key", F.when(F.col("of") > F.col("held"), F.concat("as_is", "other")).otherwise(F.col("as_is")).alias("spans"))
        per_text = kept.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    else:
        hits = met.groupBy("_key").agg(F.collect_set(F.struct("start", "text", "type")).alias("hits"))
        per_text = hits.select("_key", F.array_sort(F.transform("hits", lambda x: span(x["text"], x["type"], x["start"], F.lit(True)))).alias("spans"))
    return explode_spans(per_text.select(F.col("_key").alias(key), S.public(S.dedup_within(F.col("spans"), R.THETA_WITHIN)).alias("spans")), [key])


def name_forms(names: DataFrame, declined: bool) -> tuple[DataFrame, DataFrame, list[int]]:
    """The forms under which texts meet names, with their hashes; the hashes of first words; the numbers of words that names have."""
    parts = names.select("type", F.col("name"), word_places(F.col("name")).alias("parts")).where(F.size("parts") > 0)
    phrase = F.lower(_phrase(F.col("parts")))
    core = F.when(F.length("phrase") > 4, F.expr("left(phrase, length(phrase) - 1)")).when(F.length("phrase") == 4, F.col("phrase"))
    wanted = parts.select("type", F.size("parts").alias("n"), phrase.alias("phrase"), F.lower(F.get("parts", F.lit(0))["text"]).alias("first")).distinct()
    # names of one word meet on their stem alone
    wanted = written(wanted.withColumn("core", core).withColumn("head", F.when(F.col("n") > 1, F.col("first"))), "names")
    literal_names = wanted.select(_name_hash("n", F.lit(LITERAL), "phrase").alias("_h"), "type", "n", "head", "core", F.col("phrase").alias("form"), F.lit(True).alias("literal"), F.lit(0).cast("bigint").alias("of"))
    forms = literal_names
    if declined:
        stems = wanted.where("core IS NOT NULL").groupBy("type", "n", "head", "core").agg(F.count_distinct("phrase").alias("of"))
        forms = forms.unionByName(stems.select(_name_hash("n", F.lit(STEM), "core").alias("_h"), "type", "n", "head", "core", F.col("core").alias("form"), F.lit(False).alias("literal"), "of"))
    firsts = wanted.where("n > 1").select(_name_hash("n", F.lit(FIRST), "first").alias("_h"))
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())
    return forms, firsts, lengths


def name_candidates(t: DataFrame, keys: DataFrame, lengths: list[int], declined: bool) -> DataFrame:
    """(_key, start, text, _cut, _n): the runs of words of (_key, _text) that the filter of the names' hashes lets pass."""
    # a word with the text since the word before it; running places only where there are many words
    pieces = F.regexp_extract_all("_text", F.lit(R.WORD_PIECE_PATTERN), F.lit(0))
    words = t.select("_key", F.regexp_extract_all("_text", F.lit(R.WORD_PATTERN), F.lit(0)).alias("_words"), pieces.alias("_pieces"))
    words = words.select("*", F.when(F.size("_pieces") > FEW_WORDS, word_starts(F.col("_words"), F.col("_pieces"))).alias("_starts"))
    each = words.select("_key", "_words", "_pieces", "_starts", F.posexplode_outer("_words").alias("_i", "_word")).where("_word IS NOT NULL")
    each = each.withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"))).where("_i + n <= size(_words)")
    whole = _name_hash("n", F.lit(LITERAL), F.lower("_word"))
    begins = F.when(F.col("n") > 1, _name_hash("n", F.lit(FIRST), F.lower("_word"))).otherwise(F.lit(None) if declined else whole)
    each = may_hold(each, keys, begins)
    start = F.coalesce(F.get("_starts", F.col("_i")), F.length(F.array_join(F.slice("_pieces", F.lit(1), F.col("_i") + 1), "")) - F.length("_word"))
    gap = F.length(F.get("_pieces", F.col("_i"))) - F.length("_word")
    said = each.select("_key", "n", start.cast("int").alias("start"), F.substring(F.array_join(F.slice("_pieces", F.col("_i") + 1, F.col("n")), ""), gap + 1, F.lit(2**31 - 1)).alias("text"))
    cuts = [LITERAL] + ([0, 1, 2, 3] if declined else [])
    said = said.select("_key", "start", "text", F.explode(F.array(*[F.lit(k) for k in cuts])).alias("_cut"), F.col("n").alias("_n"))
    said_lower = F.lower("text")
    fits = (F.col("_cut") == LITERAL) | ((F.length(said_lower) - F.col("_cut") > 3) & F.regexp_like(F.right(said_lower, F.col("_cut")), F.lit(f"^[{R.DECLENSION_LETTERS}]*$")))
    return may_hold(said.where(fits), keys, candidate_hash())


def _candidate_form() -> Column:
    """The form under which a row of ``name_candidates`` meets names: lower-cased, without the ending that is cut."""
    said = F.lower("text")
    return F.when(F.col("_cut") == LITERAL, said).otherwise(F.left(said, F.length(said) - F.col("_cut")))


def candidate_hash() -> Column:
    """The hash of a row of ``name_candidates``, as ``name_forms`` has it."""
    return _name_hash("_n", F.when(F.col("_cut") == LITERAL, F.lit(LITERAL)).otherwise(F.lit(STEM)), _candidate_form())


#: Words of a text of which each finds its place by itself.
FEW_WORDS = 256
#: What a hash of ``gazetteer_spans`` is made of: a whole name, a name's stem, a name's first word.
LITERAL, STEM, FIRST = -1, -2, -3


def _name_hash(n: Column | str, kind: Column, form: Column | str) -> Column:
    return F.xxhash64(n, kind, form)


def _phrase(placed: Column) -> Column:
    """The text from the first to the last of consecutive words."""
    return F.array_join(F.transform(placed, lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(x["gap"], x["text"]))), "")


def word_starts(words: Column, pieces: Column) -> Column:
    """Where each word of a text begins; ``pieces`` are the words with the text since the word before."""
    return let(F.transform(pieces, lambda p: F.length(p)), lambda st: let(prefix_scan(st, "sum"), lambda before: F.transform(
        words, lambda w, i: F.get(before, i) + F.get(st, i) - F.length(w))))


def word_places(text: Column) -> Column:
    """array<struct<text, gap, start, end>> of the words of a text; ``gap`` is the text before a word."""
    def placed(m: Column, g: Column) -> Column:
        steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        return let(prefix_scan(steps, "sum"), lambda before: F.transform(m, lambda w, i: F.struct(
            w.alias("text"), F.get(g, i).alias("gap"), (F.get(before, i) + F.length(F.get(g, i))).cast("int").alias("start"),
            (F.get(before, i) + F.length(F.get(g, i)) + F.length(w)).cast("int").alias("end"))))

    none = F.array().cast("array<struct<text:string,gap:string,start:int,end:int>>")
    return let(F.regexp_extract_all(text, F.lit(R.WORD_PATTERN), F.lit(0)), lambda m: F.when(
        F.size(m) > 0, let(F.split(text, R.WORD_PATTERN, -1), lambda g: placed(m, g))).otherwise(none))
