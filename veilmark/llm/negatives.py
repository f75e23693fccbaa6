"""Hard negatives by shared lists of anchor clusters (MAXIMUS-style).

Rows that take part are quantised to integer components and written once with a row
number.  Anchors are assigned to centroids; the anchors of a centroid are dealt by a
hash of their row number to *parts* of about ``PART`` members, and parts to groups.
Candidates are dealt by the same kind of hash to blocks of about ``BLOCK`` rows.  A
task holds one group of parts and one block:

1. For each part the block is sorted once by an upper bound that holds for all of its
   members: with ``b`` the widest angle between a member and the centroid and ``t`` the
   candidate's angle to the centroid, a member ``u`` scores at most
   ``|u| * |candidate| * cos(max(0, t - b))``.  The sorted list (places and bounds) is
   written.
2. Every member walks the list for its positives, a run of the list at a time for all
   members still walking, and stops where the bound of the next candidate is under the
   worst of the positives found: nothing behind can enter.
3. Positives of all blocks are merged.  With them known, every member walks the lists
   again, once for all of its positives' windows, and stops where the bound is under
   each window's floor or under its worst negative found.  Negatives of all blocks are
   merged.

Results are exact; the centroids (spherical k-means on at most ``SAMPLE`` anchors picked
by a hash) only decide how early a walk ends.  A walk that the bounds cannot stop goes
through the whole list.  No row is ever compared outside the stated query set, and
scores are formed in blocks.

Scores are exact integers while squares of norms stay under 2**50; larger ones are
formed with Python integers and held at the limits of a long.

Cases: rows with a null label, vector or component, or with a component that is not
finite, take no part; a shorter vector counts as filled up with zeros; a null vec_id
is no anchor, keeps its label and comes last among equal scores; repeated rows are
rows of their own (an anchor's copy is another row); an empty table, no anchors, or an
anchor without positives give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.common import numbered, written

ANCHORS, RELABELLED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Scores of negatives, in hundredths of the positive's.
FLOOR, CEILING = 30, 90
SCALE = 256
#: Candidates of a block, anchors of a part, parts of a group (all about, by hash).
BLOCK, PART, GROUP = 4096, 128, 32
#: Centroids at most, members that each should have at least, sampled anchors, rounds of k-means.
CENTROIDS, MEMBERS, SAMPLE, ROUNDS = 256, 16, 4096, 8
#: Candidates of a list that a step of a walk takes.
STEP = 512
#: Added to cosines, so that rounding cannot lower a bound.
SLACK = 1e-6
#: Largest sum of squares for which integers are formed in floating point, and largest score.
EXACT, LONG = 2.0**50, 2**63 - 1

_NONE = np.iinfo(np.int64).min

ROW = "row long, vec_id long, label int, vector array<double>"
LISTED = "part long, block int, places binary, bounds binary, anchors array<long>, rows array<long>, vec_ids array<long>, scores array<long>"
FOUND = "anchor long, positive int, row long, vec_id long, score long"


# ---------------------------------------------------------------------------
# One block of candidates and one part of anchors
# ---------------------------------------------------------------------------
class Vectors:
    """Rows (row, vec_id, label, vector) of a block or a group."""

    def __init__(self, table: pa.Table, width: int):
        self.row = table["row"].to_numpy().astype(np.int64)
        order = np.argsort(self.row)
        self.row = self.row[order]
        ids = table["vec_id"].take(pa.array(order))
        self.vec_id = pa.compute.fill_null(ids, 0).to_numpy().astype(np.int64)
        self.no_id = ids.is_null().to_numpy().astype(bool)
        self.label = table["label"].to_numpy().astype(np.int64)[order]
        vectors = table["vector"].combine_chunks()
        sizes = pa.compute.list_value_length(vectors).to_numpy().astype(np.int64)
        filled = np.zeros((len(order), width))
        at = np.repeat(np.arange(len(order)), sizes)
        filled[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
        self.vector = filled[order]
        # norms of very large vectors are formed on a smaller scale
        big = np.abs(self.vector).max(axis=1, initial=1.0)
        scaled = self.vector / big[:, None]
        size = np.sqrt((scaled**2).sum(axis=1))
        self.unit = scaled / np.where(size, size, 1.0)[:, None]
        with np.errstate(over="ignore"):
            self.norm = size * big
        self.exact = bool((self.norm < EXACT**0.5).all())


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole numbers."""
    if exact:
        return np.rint(a @ b.T).astype(np.int64)
    wide = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in b]
    sums = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in wide[1]] for r in wide[0]]
    return np.array([[max(-LONG, min(LONG, x)) for x in r] for r in sums], np.int64).reshape(len(a), len(b))


def shared_list(centroid: np.ndarray, members: np.ndarray, block: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """(candidates by descending bound, bounds for an anchor of norm 1) for all members (unit vectors)."""
    spread = np.arccos(np.clip(members @ centroid, -1, 1)).max(initial=0.0) + 1e-7
    angle = np.arccos(np.clip(block.unit @ centroid, -1, 1))
    bound = block.norm * (np.cos(np.maximum(angle - spread, 0)) + SLACK)
    if not members.any(axis=1).all():  # an anchor of zeros has no direction; its scores are 0
        bound = np.maximum(bound, block.norm * SLACK)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The best ``size`` candidates of each of ``n`` walks, by score and, for ties, by rank in the block."""

    def __init__(self, n: int, size: int, block: Vectors):
        # order among equal scores: smaller vec_id, no vec_id last, then the row number
        order = np.lexsort((block.row, block.vec_id, block.no_id))
        self.place = order
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.size = size
        self.score = np.full((n, size), _NONE, np.int64)
        self.at = np.full((n, size), len(order), np.int64)  # rank

    def offer(self, walks: np.ndarray, scores: np.ndarray, places: np.ndarray, fits: np.ndarray) -> None:
        """Candidates ``places`` with ``scores`` (walks x places), where ``fits``."""
        line, col = np.nonzero(fits & (scores >= self.score[walks, -1][:, None]))
        if not len(line):
            return
        touched, line = np.unique(line, return_inverse=True)
        own = walks[touched]
        k = np.concatenate([np.repeat(np.arange(len(own)), self.size), line])
        score = np.concatenate([self.score[own].ravel(), scores[touched[line], col]])
        rank = np.concatenate([self.at[own].ravel(), self.rank[places[col]]])
        order = np.lexsort((rank, -score - 1, k))  # -score - 1 cannot overflow
        first = np.searchsorted(k[order], np.arange(len(own)))
        pick = order[first[:, None] + np.arange(self.size)]
        self.score[own], self.at[own] = score[pick], rank[pick]

    def worst(self) -> np.ndarray:
        """Score of the last one of each walk; the least number while there are fewer."""
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(walk, place in the block, score) of all found."""
        walk, k = np.nonzero(self.at < len(self.place))
        return walk, self.place[self.at[walk, k]], self.score[walk, k]


def _steps(order: np.ndarray, bounds: np.ndarray, norms: np.ndarray):
    """Runs of the list; a caller takes walks out by sending their places where the bound says so."""
    for a in range(0, len(order), STEP):
        # no candidate from here on scores more than this for an anchor of norm 1
        yield order[a:a + STEP], bounds[a] * np.where(bounds[a] > 0, norms * (1 + SLACK), norms * (1 - SLACK))


def walk_positives(anchors: Vectors, members: np.ndarray, block: Vectors, order: np.ndarray, bounds: np.ndarray) -> tuple[Best, int]:
    """(best rows of the same label but the anchor itself, candidates visited) of each member."""
    best, on, seen = Best(len(members), POSITIVES, block), np.arange(len(members)), 0
    norms = anchors.norm[members]
    for places, bound in _steps(order, bounds, norms):
        on = on[bound[on] >= best.worst()[on]]
        if not len(on):
            break
        mine = members[on]
        scores = products(anchors.vector[mine], block.vector[places], anchors.exact and block.exact)
        fits = (anchors.label[mine][:, None] == block.label[places]) & (anchors.row[mine][:, None] != block.row[places])
        best.offer(on, scores, places, fits)
        seen += len(on) * len(places)
    return best, seen


def walk_negatives(anchors: Vectors, members: np.ndarray, lows: np.ndarray, highs: np.ndarray, block: Vectors, order: np.ndarray, bounds: np.ndarray) -> tuple[Best, int]:
    """Best rows of another label for each member and each of its windows (members x POSITIVES, empty: low > high)."""
    wide = lows.shape[1]
    best, on, seen = Best(len(members) * wide, NEGATIVES, block), np.arange(len(members)), 0
    norms, empty = anchors.norm[members], lows > highs
    for places, bound in _steps(order, bounds, norms):
        least = np.where(empty, LONG, np.maximum(lows, best.worst().reshape(lows.shape))).min(axis=1)
        on = on[(bound[on] >= least[on]) & ~empty[on].all(axis=1)]
        if not len(on):
            break
        mine = members[on]
        scores = products(anchors.vector[mine], block.vector[places], anchors.exact and block.exact)
        other = anchors.label[mine][:, None] != block.label[places]
        for k in range(wide):
            best.offer(on * wide + k, scores, places, other & (scores >= lows[on, k, None]) & (scores <= highs[on, k, None]))
        seen += len(on) * len(places)
    return best, seen


# ---------------------------------------------------------------------------
# On Spark
# ---------------------------------------------------------------------------
def centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means on unit vectors; empty clusters keep their centroid."""
    middle = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        nearest = (sample @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums**2).sum(axis=1))
        middle = np.where(size[:, None] > 0, sums / np.where(size, size, 1.0)[:, None], middle)
    return middle


def _nearest(batches: Iterator[pa.RecordBatch], middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own = Vectors(pa.Table.from_batches([batch]), middle.shape[1])
            near = (own.unit @ middle.T).argmax(axis=1)
            yield pa.record_batch([pa.array(own.row), pa.array(near, pa.int32())], ["row", "cluster"])


def _parts(anchors: Vectors, table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    """(part, cluster, members) of a group."""
    order = np.argsort(table["row"].to_numpy())
    part, cluster = table["part"].to_numpy()[order], table["cluster"].to_numpy()[order]
    return [(int(p), int(cluster[part == p][0]), np.flatnonzero(part == p)) for p in np.unique(part)]


def _lists(group: pa.Table, block: pa.Table, middle: np.ndarray) -> pa.Table:
    """For each part of a group: the sorted list of a block, and the members' positives in it."""
    names = [c.split()[0] for c in LISTED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 4
    rows = []
    if group.num_rows and block.num_rows:
        anchors, candidates = Vectors(group, middle.shape[1]), Vectors(block, middle.shape[1])
        number = block["block"][0].as_py()
        for part, cluster, members in _parts(anchors, group):
            order, bounds = shared_list(middle[cluster], anchors.unit[members], candidates)
            best, _ = walk_positives(anchors, members, candidates, order, bounds)
            walk, place, score = best.rows()
            ids = [None if n else v for n, v in zip(candidates.no_id[place].tolist(), candidates.vec_id[place].tolist())]
            rows.append((part, number, order.astype("<i4").tobytes(), bounds.astype("<f8").tobytes(),
                         anchors.row[members[walk]].tolist(), candidates.row[place].tolist(), ids, score.tolist()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _mined(group: pa.Table, block: pa.Table, width: int) -> pa.Table:
    """Negatives that one block has for the anchors of a group; ``group`` holds anchors and the block's lists."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    out = [[np.zeros(0, np.int64)] for _ in names]
    missing = [np.zeros(0, bool)]
    is_list = pa.compute.is_valid(group["places"])
    lists = {r["part"]: (np.frombuffer(r["places"], "<i4"), np.frombuffer(r["bounds"])) for r in group.filter(is_list).select(["part", "places", "bounds"]).to_pylist()}
    group = group.filter(pa.compute.invert(is_list))
    if group.num_rows and block.num_rows:
        anchors, candidates = Vectors(group, width), Vectors(block, width)
        by_row = group.take(pa.array(np.argsort(group["row"].to_numpy())))
        lows, highs = np.full((group.num_rows, POSITIVES), 1), np.full((group.num_rows, POSITIVES), 0)
        for i, scores in enumerate(by_row["scores"].to_pylist()):
            for k, p in enumerate(scores or ()):
                lows[i, k], highs[i, k] = -(-FLOOR * p // 100), CEILING * p // 100
        for part, _, members in _parts(anchors, group):
            best, _ = walk_negatives(anchors, members, lows[members], highs[members], candidates, *lists[part])
            walk, place, score = best.rows()
            for column, values in zip(out, (anchors.row[members[walk // POSITIVES]], walk % POSITIVES, candidates.row[place], candidates.vec_id[place], score), strict=True):
                column.append(values)
            missing.append(candidates.no_id[place])
    columns = [np.concatenate(c) for c in out]
    return pa.table([pa.array(c, k, mask=np.concatenate(missing) if n == "vec_id" else None) for c, k, n in zip(columns, kinds, names, strict=True)], names)


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label (some moved), whole components."""
    vec = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    # not F.floor, which gives a long
    whole = F.transform(vec, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").where(F.coalesce(usable, F.lit(False)))
    # the product of a component near the largest double stays finite
    return kept.select("vec_id", moved.cast("int").alias("label"), F.transform(whole, lambda x: F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x))).alias("vector"))


def hard_negatives(vectors: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = numbered(prepared(vectors), "vectors", "row").select("row", "vec_id", "label", "vector")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0)
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # centroids from a bounded sample of anchors
    space = 1 << 30
    h = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(space))
    sample = anchors.where(h < int(space * min(1.0, 0.9 * SAMPLE / n_anchors))).limit(2 * SAMPLE).select("row", "vec_id", "label", "vector").toArrow()
    if not sample.num_rows:  # a few anchors, none picked
        sample = anchors.limit(SAMPLE).select("row", "vec_id", "label", "vector").toArrow()
    middle = centroids(Vectors(sample, width).unit, max(1, min(CENTROIDS, n_anchors // MEMBERS, sample.num_rows)))
    clustered = written(anchors.join(anchors.mapInArrow(partial(_nearest, middle=middle), "row long, cluster int"), "row"), "anchors")
    # parts of a cluster: as many as its members need; at most CENTROIDS sizes come to the driver
    offset, table = 0, []
    for cluster, size in sorted(tuple(r) for r in clustered.groupBy("cluster").count().collect()):
        parts = -(-size // part)
        table.append((cluster, parts, offset))
        offset += parts
    dealt = F.create_map(*[F.lit(x) for c, parts, at in table for x in (c, parts)])
    begin = F.create_map(*[F.lit(x) for c, parts, at in table for x in (c, at)])
    number = begin[F.col("cluster")] + F.pmod(F.xxhash64("row"), dealt[F.col("cluster")])
    grouped = clustered.withColumn("part", number.cast("long")).withColumn("group", (F.col("part") / GROUP).cast("int"))
    groups, blocks = (offset - 1) // GROUP + 1, -(-n // block)

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("group", every_group)

    def met(left: DataFrame):
        return left.groupBy("group", "block").cogroup(candidates.groupBy("group", "block"))

    def listed(a: pa.Table, b: pa.Table) -> pa.Table:
        return _lists(a, b, middle)

    def mined(a: pa.Table, b: pa.Table) -> pa.Table:
        return _mined(a, b, width)

    lists = written(met(grouped.withColumn("block", every_block)).applyInArrow(listed, LISTED), "lists")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    found = lists.select(F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("rows").alias("other"), F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    positives = written(
        best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("of")).select(F.col("anchor").alias("row"), "of"), "positives")

    known = grouped.join(positives, "row").select("row", "vec_id", "label", "vector", "cluster", "part", "group", F.col("of.score").alias("scores"))
    sides = known.withColumn("block", every_block).unionByName(
        lists.select("part", "block", "places", "bounds").withColumn("group", (F.col("part") / GROUP).cast("int")), allowMissingColumns=True)
    negatives = met(sides).applyInArrow(mined, FOUND)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    kept = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    named = positives.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    pairs = named.select(F.col("row").alias("anchor"), "anchor_id", F.inline("of")).select(
        "anchor", "anchor_id", (F.col("place") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(pairs, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
