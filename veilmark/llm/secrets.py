"""Secret scanning with corpus-wide ownership, in DataFrame functions only.

*Candidates.*  Three base kinds (assigned values, access keys, hex strings) are
always reported.  Three more are only candidates: private-key blocks, passwords in
connection strings, and long strings that mix digits with letters of both cases.

*Ownership.*  The hash of every candidate is counted over the whole corpus by
distinct owners and distinct repositories, with two mergeable aggregations.  A
value that ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories or more
have is a widely copied example; any other looks live.  Both numbers are returned.  Live candidates of the further kinds are added to the
spans unless they overlap a base span; copied ones are not.

Offsets are code points.  A pattern's matches and the text between them give the
lengths; running sums over (row, kind) give the offsets, so work is linear in the
matches of a text.  Patterns run only on texts that contain a character string
which every match contains.

Cases: a null or empty text has no span; a null owner or repository counts as one
of its own; repeated rows are reported each by itself and count as one repository;
an empty table gives no rows; extra columns are carried or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.arrays import cut, text_blocks
from veilmark.llm.common import free_name, marked, numbered, written


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value_group: int  # the group whose text is the secret
    min_value: int  # its characters at least
    needs: tuple[str, ...]  # one of them is in every text with a match (empty: not known)
    also: str | None = None  # further condition on the value


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Kind("assign", ASSIGN, 2, 8, (":", "=")),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, ()),
]
ADDED = [
    Kind("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60, ("PRIVATE KEY-----",)),
    # a scheme is tried only where none of its signs stands before, and never given back: linear in any run of letters
    Kind("connect", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s:/@]++:([^\s:/@]++)@", 1, 6, ("://",)),
    Kind("mixed", r"[A-Za-z0-9_-]{20,}", 0, 20, (), r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
]
KINDS = BASE + ADDED
#: Owners that make a value a widely copied example.
COPIED_OWNERS = 3
#: Repositories that do so, be they of one owner.
COPIED_REPOSITORIES = 4


def _hits(text: Column, kind: Kind) -> Column:
    """Array of (order, before, length, value): lengths of the text before a match and of the match."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value_group)) if kind.value_group else whole
    between = F.split(text, kind.pattern, -1)
    zipped = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("before"), F.transform(whole, lambda x: F.length(x)).alias("length"), value.alias("value"))
    found = F.transform(F.slice(zipped, 1, F.size(whole)), lambda x, i: F.struct(
        i.alias("place"), x["before"].alias("before"), x["length"].alias("length"), x["value"].alias("value")))
    none = F.array().cast("array<struct<place:int,before:int,length:int,value:string>>")
    may = F.lit(True)
    if kind.needs:
        may = F.lit(False)
        for s in kind.needs:
            may = may | text.contains(s)
    # one look for a first match; the passes for positions only where there is one
    return F.when(may & text.rlike(kind.pattern), found).otherwise(none)


def scanned(docs: DataFrame, text: Column, owner: Column, repository: Column, hits: str, who: str, where: str) -> DataFrame:
    """``docs`` with the raw matches of all kinds and its owner and repository."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    cols = {hits: F.array(*[_hits(t, k) for k in KINDS]), who: owner, where: repository}
    return docs.withColumns(cols)


def spans_of(rows: DataFrame, rid: str, hits: str, who: str, where: str, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """All spans of the written table ``rows``: rid, kind (number), start, stop, live, and the value's owners and repositories.

    Base spans all stay; added spans are live ones that overlap no base span.
    """
    each = (
        rows.where(F.exists(hits, lambda x: F.size(x) > 0))
        .select(rid, F.col(who).alias("owner"), F.col(where).alias("repository"), F.posexplode(hits).alias("kind", "found"))
        .select(rid, "owner", "repository", "kind", F.inline("found"))
    )
    run = Window.partitionBy(rid, "kind").orderBy("place")
    least = F.array(*[F.lit(k.min_value) for k in KINDS])
    also = F.lit(True)
    for i, k in enumerate(KINDS):
        if k.also:
            also = also & ((F.col("kind") != i) | F.col("value").rlike(k.also))
    stop = F.sum(F.col("before") + F.col("length")).over(run)
    found = (
        each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("length"))
        .where((F.length("value") >= least[F.col("kind")]) & also)
        .select(rid, "owner", "repository", "kind", "start", "stop", F.xxhash64("value").alias("secret"))
    )
    # added spans may not overlap base spans: base spans that begin before the span's end are known by their furthest stop
    near = Window.partitionBy(rid).orderBy("start", "kind")
    base = F.col("kind") < len(BASE)
    reach = F.max(F.when(base, F.col("stop"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    # what follows, as a running minimum in the reversed order (a frame up to the last row would be formed anew for each row)
    back = Window.partitionBy(rid).orderBy(F.desc("start"), F.desc("kind"))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = base | ((F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop")))
    found = written(found.withColumn("free", free).where("free").drop("free"), "secret-spans")
    # distinct owners and repositories of a value: merged before each exchange, however often it occurs
    places = found.groupBy("secret", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    spread = owners.groupBy("secret").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    # values of one owner and one repository are not joined
    shared = spread.where("owners > 1 OR repositories > 1").withColumnRenamed("secret", "shared")
    one = F.lit(1).cast("long")
    judged = found.drop("owner", "repository").join(shared, F.col("secret") == F.col("shared"), "left").select(
        rid, "kind", "start", "stop", F.coalesce("owners", one).alias("owners"), F.coalesce("repositories", one).alias("repositories"))
    judged = judged.withColumn("live", (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories))
    return judged.where(F.col("live") | (F.col("kind") < len(BASE)))


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _spread(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["owners"].cast("string"), s["repositories"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source", repository: list[str] = ["source", "lang"]) -> DataFrame:  # noqa: B006
    """One row per document: counts, digests and the spans of all kinds, and how many are live or copied.

    ``spread`` has ``owners:repositories`` of each span's value, in the order of ``spans``.
    """
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(c).cast("string").alias(c) for c in dict.fromkeys([owner, *repository])])
    scan = scanned(work, F.col("text"), _named(F.col(owner)), _joined(repository), "hits", "who", "repo")
    rows = numbered(scan.select("doc_id", "hits", "who", "repo"), "secrets", "rid")
    one = F.struct("start", "kind", "stop", "owners", "repositories")
    base = F.col("kind") < len(BASE)
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    of = spans_of(rows, "rid", "hits", "who", "repo").groupBy("rid").agg(
        *counts, F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_copied"),
        F.collect_list(F.when(base, one)).alias("base"), F.collect_list(one).alias("all"),  # a text's own spans
    )
    none = F.lit(0).cast("long")
    of = of.withColumnRenamed("rid", "of")
    joined = rows.select("rid", "doc_id").join(of, F.col("rid") == F.col("of"), "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k.name}", none).alias(f"n_{k.name}") for k in BASE],
        F.sha2(F.coalesce(_digest(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_digest(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied"),
        F.coalesce(_spread(F.col("all")), F.lit("")).alias("spread"),
    )


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _joined(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *[_named(F.col(c)) for c in columns])


def redact(
    docs: DataFrame, owner: str = "source", repository: list[str] = ["source", "lang"],  # noqa: B006
    live: str = "[SECRET]", copied: str = "[EXAMPLE-SECRET]",
) -> DataFrame:
    """``docs`` with every span replaced: by ``live``, or by ``copied`` where all it covers are copied examples.

    Only rows that have a span are shuffled; ``n_chars``, if present, follows the text.
    """
    names = {c: free_name(docs, c) for c in ("rid", "hits", "who", "repo", "has", "cuts", "cut_of", "blocks", "size")}
    rid, has = names["rid"], names["has"]
    rows = numbered(scanned(docs, F.col("text"), _named(F.col(owner)), _joined(repository), names["hits"], names["who"], names["repo"]), "redact", rid)
    spans = spans_of(rows, rid, names["hits"], names["who"], names["repo"])
    # overlapping spans become one
    near = Window.partitionBy(rid).orderBy("start", "stop")
    reach = F.max("stop").over(near.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") < F.coalesce(reach, F.lit(0)), 0).otherwise(1)
    merged = (
        spans.withColumn("begins", begins).withColumn("part", F.sum("begins").over(near))
        .groupBy(rid, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("live").alias("live"))
    )
    cuts, blocks, size = (names[c] for c in ("cuts", "blocks", "size"))
    bounds = written(merged.groupBy(rid).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "live"))).alias(cuts)), "cuts")
    rows = marked(rows.drop(names["hits"], names["who"], names["repo"]), rid, bounds.select(rid), has)
    own = [F.col(f"`{c}`") for c in docs.columns]
    some = rows.where(F.col(has)).join(bounds.withColumnRenamed(rid, names["cut_of"]), F.col(rid) == F.col(names["cut_of"]))
    some = some.withColumn(blocks, text_blocks(F.col("text"))).withColumn(size, F.length("text"))
    pieces = F.transform(cuts, lambda s, i: F.concat(
        cut(F.col(blocks), F.when(i == 0, F.lit(0)).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1)))["stop"]), s["start"]),
        F.when(s["live"], F.lit(live)).otherwise(F.lit(copied))))
    tail = cut(F.col(blocks), F.element_at(cuts, -1)["stop"], F.col(size))
    new = F.concat(F.array_join(pieces, ""), tail)
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(new.alias(c))
        elif c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.length(new).cast(kind).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.where(~F.col(has)).select(*own).unionByName(some.select(*out))
