"""Document fingerprints by SimHash, in DataFrame functions only.

*Votes.*  The terms of a text (runs of letters, digits and non-ASCII characters,
lower case) vote with their 64-bit hash: +weight on set bits, -weight on others;
a bit is set where the sum is positive.  A term's weight is the square of its
length (up to ``TERM_LETTERS``) at every occurrence, so that the short words that
all texts of a language share weigh little.  Each text's terms are exploded and
summed up by 32 aggregates of two 32-bit lanes each, which partial aggregation
keeps to one row for each text and task.

*Search.*  Permuted block tables: the 64 bits are cut into ``2 * radius`` blocks;
fingerprints within the radius agree in ``radius`` blocks at least.  There is one
table for each choice of them, keyed by the bits of the chosen blocks; a pair is
found by an equi-join and kept in the first table that has it if its bits differ
in ``radius`` places at most.

*Neighbours.*  :func:`with_next` gives each row the next row's text without a sort
of the whole table in one place: a histogram of the ids (bounded) makes buckets of
consecutive ids, the first row of each bucket is also sent to the bucket before,
and one window per bucket does the rest.

Cases: a null or empty text has fingerprint zero, like one without terms; a null
doc_id orders before all numbers, repeated ids by the hash of their text; the only
row of a table is its own next row; an empty table gives no rows; extra columns
are ignored.  Sums hold for texts of up to 2**28 characters.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import written

TERM_LETTERS = 8
#: Signs between terms: ASCII but letters and digits.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Rows of a bucket in small tables, buckets up to which that holds; rows of a bucket beyond, buckets at most.
BUCKET_ROWS, FEW_BUCKETS, MANY_ROWS, MOST_BUCKETS = 64, 4096, 20_000, 1 << 16
#: Smallest hash.
LEAST = -(1 << 63)
RADIUS = 3
#: The stated set of searches: rows whose doc_id is divisible by this.
QUERY_STEP = 20

_LANES = 0x100000001


def _long(x: int) -> Column:
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


# ---------------------------------------------------------------- fingerprints
def fingerprints(texts: DataFrame, key: list[str], text: str, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """``key`` columns, ``fp`` and the ``carried`` long columns, one row for each key.

    Rows of ``texts`` must have distinct keys.  Carried columns must be longs.
    """
    terms = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN)
    each = texts.select(*key, *carried, F.explode(terms).alias("term"))
    letters = F.least(F.length("term"), F.lit(TERM_LETTERS)).cast("long")
    voted = each.select(*key, *carried, F.xxhash64("term").alias("h"), (letters * letters).alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"lane{i}") for i in range(32)]
    summed = voted.groupBy(*key).agg(*lanes, F.sum("w").alias("total"), *[F.max(c).alias(c) for c in carried])
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"lane{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"lane{i}"), 32)
        for bit, votes in ((i, low), (i + 32, high)):
            fp = fp + F.when(votes * 2 > F.col("total"), _long(1 << bit)).otherwise(F.lit(0).cast("long"))
    return summed.select(*key, fp.alias("fp"), *carried)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


# ---------------------------------------------------------------------- search
def near(queries: DataFrame, points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, p, distance) of all fingerprints of ``points`` within ``radius`` bits of one of ``queries``.

    Both have one column ``fp`` of distinct longs; a fingerprint is near itself.
    """
    blocks = 2 * radius if radius else 1
    take = blocks - radius
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), take)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for t, m in enumerate(masks)])
    a = queries.select(F.col("fp").alias("q"), F.inline(keys).alias("qt", "qk"))
    b = points.select(F.col("fp").alias("p"), F.inline(keys).alias("pt", "pk"))
    differ = F.col("q").bitwiseXOR(F.col("p"))
    first = F.lit(True)  # no earlier table has the pair
    for t, m in enumerate(masks):
        first = first & ((F.col("qt") <= t) | (differ.bitwiseAND(_long(m)) != 0))
    met = (F.col("qt") == F.col("pt")) & (F.col("qk") == F.col("pk")) & (F.bit_count(differ) <= radius) & first
    return a.join(b, met).select("q", "p", F.bit_count(differ).alias("distance"))


# ------------------------------------------------------------------ neighbours
def key_cuts(rows: DataFrame) -> list[tuple[int | None, int]]:
    """Ascending keys (doc_id, hash) that cut ``rows`` (doc_id) into buckets of about equal size.

    Quantiles of the id, as many as the row count asks for.  An id that is several
    quantiles, and rows without one, are cut by the hash into as many parts.
    """
    n, some = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not n:
        return [(None, LEAST)]
    buckets = min(MOST_BUCKETS, max(1, min(FEW_BUCKETS, n // BUCKET_ROWS), n // MANY_ROWS))
    none = -(-buckets * (n - some) // n)
    cuts: list[tuple[int | None, int]] = [(None, LEAST)] + [(None, LEAST + (i << 64) // none) for i in range(1, none)]
    of_ids = max(1, buckets - none)
    shares = [i / of_ids for i in range(of_ids)]
    at = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * of_ids))).first()[0] if some else None
    often: dict[int, int] = {}
    for x in at or []:
        often[x] = often.get(x, 0) + 1
    for x, parts in sorted(often.items()):
        cuts += [(x, LEAST + (i << 64) // parts) for i in range(parts)]
        if parts > 1 and x < -LEAST - 1 and x + 1 not in often:
            cuts.append((x + 1, LEAST))
    return cuts


def cut_of(key: Column, cuts: list[tuple[int | None, int]]) -> Column:
    """Number of the last cut that is no larger than ``key`` (a struct of id and hash), by bisection."""
    held = F.from_json(F.lit(json.dumps([{"doc_id": d, "h": h} for d, h in cuts])), "array<struct<doc_id:long,h:long>>")
    steps = F.lit([1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step) <= key, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text, next_rid, next_text: the next row by (doc_id, hash of the text), after the last the first.

    ``rid`` numbers the rows, the same at every run over the same rows.  Buckets follow
    quantiles of the key, so an outlier among the ids or one id that very many rows have
    does not fill a bucket.
    """
    h = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = key_cuts(rows.select("doc_id"))
    key = F.struct(F.col("doc_id"), h.alias("h"))
    cell = cut_of(key, cuts)
    # a row for each bucket that has rows: its smallest key
    cells = rows.groupBy(cell.alias("cell")).agg(F.min(key)).orderBy("cell").collect()
    bucket_of, firsts = [0] * len(cuts), []
    for number, least in cells:
        bucket_of[number] = len(firsts)
        firsts.append(least)
    firsts = firsts or [(None, 0)]
    last = len(firsts) - 1

    def at(values: list, index: Column, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")[index]

    bucket = at(bucket_of, cell, "int")
    heads_id = at([x[0] for x in firsts], F.col("bucket"), "long")
    heads_h = at([x[1] for x in firsts], F.col("bucket"), "long")
    dealt = rows.withColumn("bucket", bucket).withColumn("h", h)
    is_first = F.col("doc_id").eqNullSafe(heads_id) & (F.col("h") == heads_h)
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))
    both = F.when(is_first, F.array(own, F.struct(before.alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    sent = dealt.select("doc_id", "text", "h", F.inline(both))
    w = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    number = F.shiftleft(F.col("b").cast("long"), 32) + F.row_number().over(w)
    following = sent.select(
        "b", "doc_id", "text", "ghost", number.alias("rid"),
        F.lead("text").over(w).alias("next_text"), F.lead("ghost").over(w).alias("next_ghost"),
    ).where("ghost = 0")
    after = F.when(F.col("b") == last, F.lit(0)).otherwise(F.col("b") + 1).cast("long")
    next_rid = F.when(F.col("next_ghost") == 1, F.shiftleft(after, 32) + 1).otherwise(F.col("rid") + 1)
    return following.select("rid", "doc_id", "text", next_rid.alias("next_rid"), "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last quarter of code points replaced by the first as many of ``next_text``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def compare(docs: DataFrame, radius: int = RADIUS, every: int = QUERY_STEP) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    Rows whose doc_id is divisible by ``every`` are also searches against all rows:
    ``n_near`` is the number of distinct fingerprints of texts within ``radius`` bits,
    its own included (null for other rows).
    """
    rows = with_next(docs)
    sha = F.sha2(edited(F.col("text"), F.col("next_text")), 256)
    # the digest travels as four longs, so that all aggregates have a fixed width
    quarters = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    none = F.lit(None).cast("long")
    meta = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("sha", sha)
    pair = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), "doc_id", "next_rid", F.length("text").cast("long").alias("n_chars"),
                 *[none.alias(f"sha{i}") for i in range(4)]),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), none.alias("doc_id"), none.alias("next_rid"), none.alias("n_chars"), *quarters),
    )
    bodies = meta.select("rid", F.inline(pair))
    carried = ["doc_id", "next_rid", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    prints = written(fingerprints(bodies, ["rid", "kind"], "body", carried), "prints")
    own = prints.where("kind = 0").select("rid", "doc_id", "next_rid", "n_chars", F.col("fp").alias("own"))
    cut = prints.where("kind = 1").select(F.col("rid").alias("e_rid"), F.col("fp").alias("cut"), "sha0", "sha1", "sha2", "sha3")
    following = prints.where("kind = 0").select(F.col("rid").alias("n_rid"), F.col("fp").alias("following"))
    joined = own.join(cut, F.col("rid") == F.col("e_rid")).join(following, F.col("next_rid") == F.col("n_rid"))
    points = prints.where("kind = 0").select("fp").distinct()
    asked = F.col("doc_id") % every == 0
    found = near(prints.where("kind = 0").where(asked).select("fp").distinct(), points, radius)
    found = found.groupBy("q").agg(F.count(F.lit(1)).alias("n_near"))
    joined = joined.join(found, F.col("own") == F.col("q"), "left")
    return joined.select(
        "doc_id", "n_chars", F.concat(*[hexed(F.col(f"sha{i}")) for i in range(4)]).alias("edited_sha256"),
        hexed(F.col("own")).alias("fingerprint"), hexed(F.col("cut")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("cut")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
    )
