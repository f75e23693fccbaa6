"""Near-duplicate groups by SimHash and a Gray-order hierarchical index.

*Fingerprints.*  A bit of a text's 64-bit fingerprint is set if it is set in over
half of the XXH64 hashes of its word shingles.

*Links.*  Two fingerprints link at ``distance`` or fewer differing bits.  Work is
dealt out by exact blocks: the 64 bits are cut into ``distance + spare`` blocks,
and fingerprints that link agree in ``spare`` blocks at least, so for every choice
of ``spare`` blocks a fingerprint goes to the bucket of its values there.  No
linked pair is missed and no bucket is capped; ``spare`` rises with the number of
fingerprints so that buckets stay small.

*Index.*  A task sorts the fingerprints of a bucket by Gray rank (neighbours then
differ in few bits) and builds nodes over runs of ``FAN`` of them, level by level.
A node holds the bits on which all its members agree; what its parent holds
already is factored out of it.  A search goes down with the differences counted
so far and leaves a whole group as soon as they exceed the distance.  It also
leaves a group all of whose members are known to be connected with the searcher,
so a dense group of near copies costs about its size, not its square.

*Groups.*  A bucket gives a spanning forest of its links, at most one edge for
each member.  The forests are joined into components by rounds of large-star and
small-star steps, each round written to the shared folder.

Cases: a null or wordless text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows belong to one group;
rows whose doc_id is null never name a group unless it has no other row; an empty
table gives no rows; extra columns are carried unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import ASCII_LOWER, free_name, marked, numbered, written

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
#: Children of an index node.
FAN = 8
#: Searches that go down the index together.
SEARCHES = 256
#: Fingerprints that a bucket is meant to hold.
BUCKET = 64
#: Rows of a task's buckets that are indexed together (a bucket is never split by it).
FOREST_ROWS = 100_000
#: Shingle hashes whose bits are counted together.
HASHES = 1 << 16


# ---------------------------------------------------------------- fingerprints
def fingerprint(raw: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = raw.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - take + 1].tolist(), ends[take - 1:].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = np.array(hashes[i:i + HASHES], ">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprint_column(texts: pa.Array, shingle: int) -> pa.Array:
    out = np.fromiter((fingerprint((t or "").encode(), shingle) for t in texts.to_pylist()), np.uint64, len(texts))
    return pa.array(out.view(np.int64))


def fingerprints(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprints of a text column as (signed) longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return _fingerprint_column(texts, shingle)

    return of(F.coalesce(text.cast("string"), F.lit("")))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ----------------------------------------------------------------------- index
def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayForest:
    """One index for each bucket of a batch; ``fps`` ascends by (bucket, Gray rank)."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.fps, self.bucket = fps, bucket
        self.pattern, self.mask = [fps], [np.full(len(fps), full)]
        self.first, self.last = [np.arange(len(fps))], [np.arange(len(fps))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # of each upper level: first child, number of children
        owner = bucket
        while True:
            size = len(owner)
            new = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
            runs = np.diff(np.append(new, size))
            if (runs == 1).all():
                break
            place = np.arange(size) - np.repeat(new, runs)
            heads = np.flatnonzero(place % FAN == 0)
            counts = np.diff(np.append(heads, size))
            both = np.bitwise_and.reduceat(self.pattern[-1], heads)
            some = np.bitwise_or.reduceat(self.pattern[-1], heads)
            agree = np.bitwise_and.reduceat(self.mask[-1], heads) & ~(both ^ some)
            parent = np.repeat(np.arange(len(heads)), counts)
            self.mask[-1] = self.mask[-1] & ~agree[parent]  # factored out into the upper node
            self.pattern.append(both & agree)
            self.mask.append(agree)
            self.first.append(self.first[-1][heads])
            self.last.append(self.last[-1][np.append(heads[1:], size) - 1])
            self.children.append((heads, counts))
            owner = owner[heads]
        self.root_of = np.searchsorted(owner, bucket) if len(owner) else np.zeros(0, np.int64)

    def forest(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, first member of its component) for every member that is not itself the first."""
        n = len(self.fps)
        label = np.arange(n)
        for a in range(0, n, SEARCHES):
            q = np.arange(a, min(n, a + SEARCHES))
            one = [np.minimum.reduceat(label, f) for f in self.first]
            top = [np.maximum.reduceat(label, f) for f in self.first]
            node, diff = self.root_of[q], np.zeros(len(q), np.int64)
            for level in range(len(self.pattern) - 1, -1, -1):
                # later members only: a pair is met once
                keep = self.last[level][node] > q
                keep &= (one[level][node] != label[q]) | (top[level][node] != label[q])
                q, node, diff = q[keep], node[keep], diff[keep]
                diff = diff + np.bitwise_count((self.fps[q] ^ self.pattern[level][node]) & self.mask[level][node])
                keep = diff <= distance
                q, node, diff = q[keep], node[keep], diff[keep]
                if level:
                    heads, counts = self.children[level - 1]
                    c = counts[node]
                    at = np.repeat(np.cumsum(c) - c, c)
                    q, diff, node = np.repeat(q, c), np.repeat(diff, c), np.repeat(heads[node], c) + np.arange(len(at)) - at
            later = node > q
            label = joined_labels(label, q[later], node[later])
        member = np.flatnonzero(label != np.arange(n))
        return member, label[member]


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (smallest member of each component) after the links a-b."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return label


def _bucket_forests(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links in each bucket; rows arrive sorted by bucket."""

    def forests(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.diff(key, axis=0, prepend=key[:1]).any(axis=1))
        order = np.lexsort((gray_rank(fps), bucket))
        fps, bucket = fps[order], bucket[order]
        sizes = np.bincount(bucket)
        pick = sizes[bucket] > 1
        fps, bucket = fps[pick], bucket[pick]
        member, root = GrayForest(fps, bucket).forest(distance) if len(fps) else (np.zeros(0, np.int64),) * 2
        return pa.record_batch([pa.array(fps[member].view(np.int64)), pa.array(fps[root].view(np.int64))], ["a", "b"])

    keys, held, count = [], [], 0
    for batch in batches:
        table, value, fp = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        keys.append(np.stack([table, value], axis=1))
        held.append(fp.view(np.uint64))
        count += len(fp)
        if count < FOREST_ROWS:
            continue
        key, fps = np.concatenate(keys), np.concatenate(held)
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))  # the last bucket may go on in the next batch
        if len(ends):
            cut = ends[-1] + 1
            yield forests(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
        keys, held, count = [key], [fps], len(fps)
    if count:
        yield forests(np.concatenate(keys), np.concatenate(held))


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints that chains of links connect.

    ``fps``: one column ``fp`` of distinct longs, written (it is counted and read).
    """
    n = max(1, fps.count())
    spare = 1
    while spare < 4 and n / 2 ** (64 * spare / (distance + spare)) > bucket:
        spare += 1
    blocks = distance + spare
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), spare)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << int(edges[i]) for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")))
    dealt = fps.select("fp", F.inline(F.array(*keys))).select("table", "value", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(parts, math.ceil(n * len(keys) / 2_000_000)), "table", "value").sortWithinPartitions("table", "value")
    return dealt.mapInArrow(partial(_bucket_forests, distance=distance), "a long, b long").distinct()


# ------------------------------------------------------------------ components
def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``edges`` (columns a, b)."""
    low, high = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    stars = written(edges.where("a != b").select(high, low).distinct(), "stars")
    before = None
    while True:
        after = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
        # large star: every larger neighbour of a node goes to the smallest of all its neighbours
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, large["u"] == least["c"])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = written(small.select("e.u", "e.v").where("u != v").distinct(), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, shingle: int, distance: int, whole: bool) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(rows, roots, names): the written rows with number and fingerprint; (fp, root) of every fingerprint."""
    names = {c: free_name(docs, c) for c in ("rid", "fp")}
    rows = docs.withColumn(names["fp"], fingerprints(F.col("text"), shingle))
    rows = numbered(rows if whole else rows.select("doc_id", names["fp"]), "simhash", names["rid"])
    nodes = written(rows.select(F.col(names["fp"]).alias("fp")).distinct(), "nodes")
    found = components(links(nodes, distance))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows, roots, names


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group) of every row."""
    rows, roots, names = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, distance, whole=False)
    fp = names["fp"]
    smallest = rows.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("m")).join(roots, "fp")
    named = smallest.groupBy("root").agg(F.min("m").alias("component_id"))
    of = written(smallest.select("fp", "root").join(named, "root").select(F.col("fp").alias("of_fp"), "component_id"), "components")
    thin = rows.select("doc_id", fp)
    return thin.join(of, thin[fp] == of["of_fp"]).select("doc_id", hexed(F.col(fp)).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id (null last), then the first written."""
    rows, roots, names = grouped(docs, shingle, distance, whole=True)
    rid, fp = names["rid"], names["fp"]
    doc_id = F.col("doc_id").cast("long")
    thin = rows.select(F.col(fp).alias("row_fp"), F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col(rid).alias("rid")).alias("row"))
    stay = thin.join(roots, thin["row_fp"] == roots["fp"]).groupBy("root").agg(F.min("row").alias("row"))
    stays = free_name(docs, "stays")
    out = marked(rows, rid, stay.select(F.col("row.rid").alias(rid)), stays)
    return out.where(F.col(stays)).select(*[F.col(f"`{c}`") for c in docs.columns])
