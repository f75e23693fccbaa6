"""Masking: tokens, masked text, token maps, vault rows, re-masking (M1-M9).

Tokens are a keyed hash of (session, type, value): the same value gets the
same token in a session without any state, and a retried task recomputes
identical tokens (a random id would not survive task re-execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions import spans as S
from veilmark.functions.arrays import cut, explode_kept, let, neighbours_distinct, text_blocks
from veilmark.operators.joins import salted_join
from veilmark.session import written

DEFAULT_WIDTH = 12


def token_expr(session: Column, type_: Column, value: Column, width: int = DEFAULT_WIDTH, salt: str = "") -> Column:
    """M2/M3: ``[PREFIX_hhhh…]`` from sha-256 of salt|session|type|value."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), session.cast("string"), type_, value), 256)
    return F.concat(F.lit("["), R.token_prefix(type_), F.lit("_"), F.substring(digest, 1, width), F.lit("]"))


def tokenize_spans(spans: Column, session: Column, width: int = DEFAULT_WIDTH, salt: str = "") -> Column:
    """Disjoint, start-sorted spans with their token: array<struct<start,end,type,text,token>>."""
    disjoint = S.make_disjoint(spans)
    return F.transform(
        F.filter(disjoint, lambda s: F.length(s["text"]) > 0),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"),
            token_expr(session, s["type"], s["text"], width, salt).alias("token"),
        ),
    )


def masked_text(text: Column, tspans: Column) -> Column:
    """M1: replace each span by its token (spans are disjoint and sorted); work follows the text and the spans."""
    def built(blocks: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            prev = F.when(i == 0, F.lit(0)).otherwise(F.get(tspans, F.greatest(i - 1, F.lit(0)))["end"])
            return F.concat(cut(blocks, prev, s["start"]), s["token"])

        tail = cut(blocks, F.element_at(tspans, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(tspans, before), ""), tail)

    return F.when(F.size(tspans) == 0, text).otherwise(let(text_blocks(text), built))


def token_entries(tspans: Column) -> Column:
    """M5: distinct (token, value) entries."""
    return neighbours_distinct(F.sort_array(F.transform(tspans, lambda s: F.struct(s["token"].alias("token"), s["text"].alias("value")))))


def mask(
    df: DataFrame,
    key: str = "doc_id",
    text_col: str = "text",
    spans_col: str = "spans",
    session_col: str | None = None,
    width: int = DEFAULT_WIDTH,
    salt: str = "",
) -> DataFrame:
    """Adds ``tspans`` (tokenized spans), ``masked_text`` and ``token_map`` to a table with spans."""
    session = F.col(session_col or key)
    tsp = tokenize_spans(F.col(spans_col), session, width, salt)
    out = df.withColumn("tspans", tsp)
    return out.withColumn("masked_text", masked_text(F.col(text_col), F.col("tspans"))).withColumn(
        "token_map", F.map_from_entries(token_entries(F.col("tspans")))
    )


def vault_rows(masked: DataFrame, key: str = "doc_id", session_col: str | None = None, with_start: bool = False) -> DataFrame:
    """Long vault table (session_id, token, type, value) from masked rows; one row per distinct token of a row.

    ``with_start`` adds ``first_start``, where the token's first span begins (H7).
    """
    session = F.col(session_col or key).cast("string")
    ent = F.sort_array(F.transform(F.col("tspans"), lambda s: F.struct(
        s["token"].alias("token"), s["type"].alias("type"), s["text"].alias("value"), s["start"].alias("start"))))
    first = let(ent, lambda a: F.filter(a, lambda x, i: (i == 0) | (
        (x["token"] != F.get(a, i - 1)["token"]) | (x["type"] != F.get(a, i - 1)["type"]) | (x["value"] != F.get(a, i - 1)["value"]))))
    rows = masked.select(session.alias("session_id"), explode_kept(first).alias("e")).filter(F.col("e").isNotNull())
    return rows.select("session_id", "e.token", "e.type", "e.value", *([F.col("e.start").alias("first_start")] if with_start else []))


def token_collisions(vault: DataFrame) -> DataFrame:
    """M4: tokens that stand for more than one value within a session (must be empty)."""
    return (
        vault.groupBy("session_id", "token")
        .agg(F.count_distinct("value").alias("n_values"))
        .filter(F.col("n_values") > 1)
    )


def map_lines(m: Column) -> Column:
    """A map as sorted 'token=value' lines (stable, engine-neutral text form)."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")


def merge_maps(base: Column, override: Column) -> Column:
    """M6: instruction tokens override document tokens (last writer wins).

    Keys of ``base`` that ``override`` also has are dropped first, so the result
    does not depend on the session's map-key deduplication policy.
    """
    empty = F.create_map().cast("map<string,string>")
    b, o = F.coalesce(base, empty), F.coalesce(override, empty)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(o, k)), o)


def replace_values(text: Column, pairs: Column) -> Column:
    """M7/M8 core: ``replace(value -> token)`` over (value, token) pairs in the given order.

    Pieces that have the shape of a token (in the text, or inserted by an earlier
    pair) are never changed (H6).
    """
    def step(acc: Column, p: Column) -> Column:
        def joined(tokens: Column) -> Column:
            pieces = F.transform(F.split(acc, R.TOKEN_PATTERN, -1), lambda x: F.replace(x, p["value"], p["token"]))
            return F.array_join(F.zip_with(pieces, tokens, lambda x, t: F.concat(x, F.coalesce(t, F.lit("")))), "")

        return F.when(F.contains(acc, p["value"]), let(F.regexp_extract_all(acc, F.lit(R.TOKEN_PATTERN), F.lit(0)), joined)).otherwise(acc)

    return F.aggregate(pairs, text, step)


def longest_first(pairs: Column) -> Column:
    """Sort (value, token) pairs by value length desc, then value (deterministic)."""
    keyed = F.sort_array(F.transform(pairs, lambda p: F.struct((-F.length(p["value"])).alias("n"), p["value"].alias("value"), p["token"].alias("token"))))
    return F.transform(keyed, lambda k: F.struct(k["value"].alias("value"), k["token"].alias("token")))


def inverse_pairs(vault: DataFrame, session_col: str = "session_id") -> DataFrame:
    """H7: one token per (session, value): that of the earliest span if the vault has ``first_start``, then the smallest."""
    at = F.col("first_start") if "first_start" in vault.columns else F.lit(0)
    return vault.where(F.length("value") > 0).groupBy(session_col, "value").agg(F.min(F.struct(at.alias("at"), "token"))["token"].alias("token"))


#: Letters of the key under which a value and the texts that may hold it meet.
GRAM = 4


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters of a text of at least ``n`` characters."""
    return let(F.split(text, ""), lambda chars: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))))


def value_keys(inv: DataFrame) -> DataFrame:
    """Each (session, value) with the run of ``GRAM`` characters in it that fewest values of its session share.

    Shorter values are their own key.
    """
    n = F.least(F.length("value"), F.lit(GRAM))
    each = inv.select("session_id", "value", "token", n.alias("n"), F.explode(let(F.col("value"), lambda v: _grams(v, F.least(F.length(v), F.lit(GRAM))))).alias("gram"))
    shared = each.groupBy("session_id", "gram").agg(F.count(F.lit(1)).alias("shared"))
    best = F.min(F.struct("shared", "gram", "token"))
    found = each.join(shared, ["session_id", "gram"]).groupBy("session_id", "value", "n").agg(best.alias("k"))
    return found.select("session_id", "value", "n", F.col("k.gram").alias("gram"), F.col("k.token").alias("token"))


#: Bits of a session's filter for each of its values, at least and at most; bits that a run sets.
FILTER_BITS, FILTER_MOST, FILTER_HASHES = 16, 1 << 16, 2


def _bit(gram: Column, bits: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(gram, F.lit(k)), bits)


def session_filters(values: DataFrame) -> DataFrame:
    """(session_id, lengths, bits, words): a Bloom filter of the keys of each session's values.

    Filters are unions of bits, so parts of a session are merged by ``bit_or`` before
    and after the exchange; a session of any size gives one row of at most
    ``FILTER_MOST`` bits.  ``lengths`` are the key lengths that occur (1 to ``GRAM``).
    """
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.least(F.greatest(F.col("values") * FILTER_BITS, F.lit(64)), F.lit(FILTER_MOST)))))
    sizes = values.groupBy("session_id").agg(F.count(F.lit(1)).alias("values"), F.collect_set("n").alias("lengths")).select("session_id", "lengths", size.cast("bigint").alias("bits"))
    each = values.select("session_id", "gram").distinct().join(sizes.select("session_id", "bits"), "session_id")
    marks = each.select("session_id", "bits", F.explode(F.array(*[_bit(F.col("gram"), F.col("bits"), k) for k in range(FILTER_HASHES)])).alias("bit"))
    words = marks.groupBy("session_id", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    # at most FILTER_MOST / 64 words
    filled = words.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return sizes.join(filled, "session_id")


def _may_hold(words: Column, bits: Column, gram: Column) -> Column:
    """Has the filter all bits of a run of characters?"""
    found = F.lit(True)
    for k in range(FILTER_HASHES):
        word = F.try_element_at(words, F.floor(_bit(gram, bits, k) / 64).cast("int"))
        found = found & (F.coalesce(word, F.lit(0).cast("bigint")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), (_bit(gram, bits, k) % 64).cast("int"))) != 0)
    return found


def candidate_grams(turns: DataFrame, values: DataFrame, session_key: str, text_col: str) -> DataFrame:
    """``turns`` with ``_grams``: the runs of characters of each text that may be a key of its session's values.

    The session's filter is brought to the text and tested there, run by run, so what
    goes on from here are candidates and not characters.
    """
    filters = session_filters(values).withColumnRenamed("session_id", "_filter_of")
    t = turns.withColumn("_sid", F.col(session_key).cast("string"))
    met = salted_join(t, filters, F.col("_sid"), "_filter_of", F.xxhash64(text_col))

    def tested(x: Column) -> Column:
        grams = F.when(F.length(x["t"]) >= x["n"], _grams(x["t"], x["n"])).otherwise(F.array().cast("array<string>"))
        return F.filter(grams, lambda g: _may_hold(F.col("words"), F.col("bits"), g))

    by_length = F.transform("lengths", lambda n: let(F.struct(F.col(text_col).alias("t"), n.alias("n")), tested))
    return met.withColumn("_grams", F.coalesce(F.flatten(by_length), F.array().cast("array<string>"))).drop("lengths", "bits", "words")


def remask_by_runs(turns: DataFrame, vault: DataFrame, session_key: str, text_col: str = "text",
           keys: list[str] | None = None) -> DataFrame:
    """M7 where sessions have many values.

    A text and a value of its session meet only on (session, run of characters),
    where the value's run is the one that fewest values of the session share, and
    only if the session's Bloom filter may hold the run.  The match is checked in
    full against the text.  What is shuffled are candidates; texts without one are
    not exploded.
    """
    keys = list(keys) if keys is not None else [session_key, "turn"]
    values = written(value_keys(inverse_pairs(vault)), "value-keys")
    t = candidate_grams(turns.withColumn("_tid", F.struct(*keys)), values, session_key, text_col)
    probes = written(t.where(F.size("_grams") > 0).select("_tid", "_sid", "_grams"), "probes")
    met = probes.select("_tid", "_sid", F.explode("_grams").alias("_gram")).join(values, (F.col("_sid") == values["session_id"]) & (F.col("_gram") == values["gram"]))
    # values that the text may hold; those that it does not hold are left out beside the text
    per_text = met.groupBy("_tid").agg(F.collect_set(F.struct("value", "token")).alias("_pairs")).withColumnRenamed("_tid", "_of")
    plain = turns.withColumn("_tid", F.struct(*keys))
    j = plain.join(per_text, F.col("_tid") == F.col("_of"), "left")
    empty = F.array().cast("array<struct<value:string,token:string>>")
    held = longest_first(F.filter(F.coalesce(F.col("_pairs"), empty), lambda p: F.contains(F.col(text_col), p["value"])))
    out = j.withColumn("_pairs", held).withColumn(text_col, replace_values(F.col(text_col), F.col("_pairs")))
    return out.drop("_tid", "_of", "_pairs")


#: Entries of a session up to which its texts get all of its values at once.
FEW_VALUES = 64


def remask(turns: DataFrame, vault: DataFrame, session_key: str, text_col: str = "text",
           keys: list[str] | None = None) -> DataFrame:
    """M7: re-mask texts with every known value of their session (longest value first).

    The values of a session of few entries are one row, sorted once, that its texts are
    joined with; texts and entries are shuffled once, by their session.  Sessions of more
    entries go by :func:`remask_by_runs`, where a text meets single values.  ``keys``
    identify a text uniquely (default: session key + ``turn``).
    """
    # counted by partial sums, so that no session is collected before it is known to be small
    sizes = written(vault.groupBy("session_id").agg(F.count(F.lit(1)).alias("_entries")), "session-sizes")
    small = vault.join(sizes.where(F.col("_entries") <= FEW_VALUES).select("session_id"), "session_id")
    pairs = inverse_pairs(small).groupBy(F.col("session_id").alias("_of")).agg(longest_first(F.collect_list(F.struct("value", "token"))).alias("_pairs"))
    j = turns.withColumn("_sid", F.col(session_key).cast("string")).join(pairs, F.col("_sid") == F.col("_of"), "left")
    held = F.filter(F.col("_pairs"), lambda p: F.contains(F.col(text_col), p["value"]))
    j = j.withColumn("_pairs", held)
    out = j.withColumn(text_col, F.when(F.size("_pairs") > 0, replace_values(F.col(text_col), F.col("_pairs"))).otherwise(F.col(text_col))).select(*turns.columns)
    large = sizes.where(F.col("_entries") > FEW_VALUES).select("session_id")
    return out if large.isEmpty() else remask_by_runs(out, vault.join(large, "session_id"), session_key, text_col, keys)


def mask_cells(cells: DataFrame, vault: DataFrame, session_key: str, value_col: str = "value",
               keys: list[str] | None = None) -> DataFrame:
    """M8: every known value inside each cell replaced by its token."""
    return remask(cells, vault, session_key, value_col, keys or [session_key, "sheet", "row", "col"])
