"""Benchmark decontamination: Wu-Manber search for all windows of all test items.

Texts are sequences of words, and words are the symbols of the search.  The windows of
an item are all runs of ``WINDOW`` of its words (an item of fewer words is one window).

* Windows of one length are searched together.  A table holds for each hash of a block
  of ``BLOCK`` symbols how far the search may jump: the least distance of such a block
  from the end of a window, or past all of them if no window has it.
* Where the distance is zero, the windows that end with this very block and begin with
  the block found at their start are picked from a bucket, and compared symbol by
  symbol with the text.
* The words of a slice are cut into lanes that jump together, so each step is an array
  operation; lanes overlap by a window, so none is lost.

Words of the documents that no window has share one symbol, which no window holds.

Windows are dealt to shards by their words.  One shard (``SHARD_WINDOWS`` windows at
most, counted before) travels with the function.  Beyond that nothing is broadcast:
runs of documents meet every shard by a co-grouping on (shard, deal), so a task holds
one shard and a bounded run of texts; what the shards found is merged by document.

Cases: null texts have no words (an item without words has no window); empty tables
give no rows, or documents without hits; any length of text is searched whole;
repeated documents are judged each by itself, repeated items count each as an item;
a null item_id is listed as an empty string; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import ASCII_LOWER, flat, numbered, slices, spread_index, written
from veilmark.llm.wordseq import word_numbers

WINDOW, BLOCK = 10, 2
#: Distinct windows in a shard (each about 100 bytes of words; a window of a billion items is one entry with their ids).
SHARD_WINDOWS = 200_000
#: Item ids (over all windows of a shard) that travel with it.
SHARD_ITEMS = 1_000_000
#: Bits of the shift table.
TABLE_BITS = 18
#: Ends of windows that one lane looks at.
LANE = 512
#: Characters of text in a deal of documents (many shards).
DEAL_CHARS = 32 << 20

_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: What a shard found in a document: merged hit stretches (start, end) and the items' numbers and ids.
FOUND = "row long, doc_id long, n_words long, stretches array<long>, items array<long>, item_ids array<string>"
SHARD_ROW = "words string, items array<long>, item_ids array<string>"


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, piece of each word, first word of each text and the end) of lower-cased texts."""
    data = _LOWER[data]
    distinct, number, _, first = word_numbers(data, off, _INSIDE[data])
    return distinct, number, first


# ---------------------------------------------------------------------------
# The search
# ---------------------------------------------------------------------------
class Length:
    """Tables of the windows of one length (rows of symbols, all different)."""

    def __init__(self, rows: np.ndarray, number: np.ndarray, symbols: int):
        n, self.length = rows.shape
        self.block = min(BLOCK, self.length)
        self.symbols = symbols
        self.jump = self.length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.jump, np.int64)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._hash(self._code(rows[:, end - self.block + 1], rows[:, end])), self.length - 1 - end)
        suffix = self._code(rows[:, -self.block], rows[:, -1])
        prefix = self._code(rows[:, 0], rows[:, self.block - 1])
        order = np.lexsort((prefix, suffix))
        self.rows, self.number = rows[order], number[order]
        self.suffix, self.prefix = suffix[order], prefix[order]
        self.suffixes, at = np.unique(self.suffix, return_index=True)
        self.bucket = np.append(at, n)
        # one key for the pair of blocks: (number of the suffix, prefix), ascending as the windows are
        self.span = symbols**self.block + 1
        self.key = np.repeat(np.arange(len(self.suffixes)), np.diff(self.bucket)) * self.span + self.prefix

    def _code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a if self.block == 1 else a * self.symbols + b

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window number) of every occurrence in a sequence of symbols; 0 occurs in no window."""
        m, found = self.length, []
        at = np.arange(m - 1, len(text), LANE)
        stop = np.minimum(at + LANE, len(text))
        while len(at):
            shift = self.shift[self._hash(self._code(text[at - self.block + 1], text[at]))]
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.concatenate(found)
        # suffix bucket, then the windows in it that begin like the text
        suffix = self._code(text[last - self.block + 1], text[last])
        which = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
        last, which = (x[self.suffixes[which] == suffix] for x in (last, which))
        key = which * self.span + self._code(text[last - m + 1], text[last - m + self.block])
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        row = spread_index(lo, hi - lo)
        last = np.repeat(last, hi - lo)
        # direct comparison
        for k in range(m):
            same = self.rows[row, k] == text[last - m + 1 + k]
            row, last = row[same], last[same]
        return last, self.number[row]


class Patterns:
    """The windows of a shard: space-joined words with the items that hold them."""

    def __init__(self, words: list[str], items: list[list[int]], item_ids: list[list[str]]):
        split = [w.encode().split(b" ") for w in words]
        lengths = np.array([len(w) for w in split], np.int64)
        self.vocabulary = pa.array([w for s in split for w in s], pa.large_binary()).unique()
        number = {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}
        self.lengths = [
            Length(np.array([[number[w] for w in split[i]] for i in at], np.int64), at, len(number) + 1)
            for at in (np.flatnonzero(lengths == m) for m in np.unique(lengths))
        ]
        self.size = lengths
        self.items, self.item_ids = items, item_ids

    def found(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, dict[int, str]]]:
        """(place, words, merged hit stretches, items) of each text of a batch with a column ``text``."""
        distinct, number, first = tokens(*flat(batch.column(batch.schema.get_field_index("text"))))
        n = len(first) - 1
        symbol = np.zeros(len(distinct), np.int64)
        if len(distinct):
            known = pa.compute.index_in(distinct, self.vocabulary)
            symbol = pa.compute.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # a symbol of no window after each text
        place = np.arange(len(number)) + np.repeat(np.arange(n), np.diff(first))
        stream = np.zeros(len(number) + n, np.int64)
        stream[place] = symbol[number]
        begin = first[:-1] + np.arange(n)
        counts = np.diff(first)
        last, window = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *(t.search(stream) for t in self.lengths), strict=True))
        text = np.searchsorted(begin, last, "right") - 1
        order = np.argsort(text, kind="stable")
        last, window, text = last[order], window[order], text[order]
        edge = np.searchsorted(text, np.arange(n + 1))
        for t in range(n):
            a, b = edge[t], edge[t + 1]
            ends = last[a:b] - begin[t] + 1
            items: dict[int, str] = {}
            for w in np.unique(window[a:b]).tolist():
                items.update(zip(self.items[w], self.item_ids[w], strict=True))
            yield t, int(counts[t]), merged(ends - self.size[window[a:b]], ends), items


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of stretches, as ascending rows (start, end)."""
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[new], end[np.append(new[1:], True)]], axis=1)


def _judged(doc_id: int, words: int, stretches: np.ndarray, items: dict[int, str]) -> tuple:
    hit = int((stretches[:, 1] - stretches[:, 0]).sum())
    listed = ",".join(sorted(items.values(), key=lambda x: x.encode()))
    return doc_id, words, hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), hit > 0


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# ---------------------------------------------------------------------------
# On Spark
# ---------------------------------------------------------------------------
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items (item, item_id, text): one row for each window."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            distinct, number, first = tokens(*flat(batch.column(batch.schema.get_field_index("text"))))
            spelled = [w.decode() for w in distinct.to_pylist()]
            rows = []
            for t, (item, item_id) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)):
                words = [spelled[i] for i in number[first[t]:first[t + 1]]]
                for a in range(max(1, len(words) - WINDOW + 1) if words else 0):
                    rows.append((item, item_id, " ".join(words[a:a + WINDOW])))
            yield from _table(rows, "item long, item_id string, words string").to_batches()


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows with the numbers and ids of their items (``words``, ``items``, ``item_ids``)."""
    work = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = numbered(work, "items", "item").select("item", "item_id", "text")
    cut = rows.mapInArrow(_cut, "item long, item_id string, words string").distinct()
    grouped = cut.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("item", "item_id"))).alias("of"))
    return written(grouped.select("words", F.col("of.item").alias("items"), F.col("of.item_id").alias("item_ids")), "leak-windows")


def _patterns(rows: list) -> Patterns:
    rows = sorted(rows, key=lambda r: r[0])
    return Patterns([r[0] for r in rows], [list(r[1]) for r in rows], [list(r[2]) for r in rows])


def _narrow(batches: Iterator[pa.RecordBatch], patterns: Patterns) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = batch.column(0).to_pylist()
            yield from _table([_judged(ids[t], *found) for t, *found in patterns.found(batch)], REPORT).to_batches()


def _of_shard(texts: pa.Table, shard: pa.Table) -> pa.Table:
    """What one shard finds in one deal of documents; each document gets a row, hit or not."""
    patterns = _patterns([tuple(r.values()) for r in shard.select(["words", "items", "item_ids"]).to_pylist()])
    rows = []
    for whole in texts.select(["row", "doc_id", "text"]).combine_chunks().to_batches():
        for batch in slices(whole, "text"):
            numbers, ids = (batch.column(i).to_pylist() for i in (0, 1))
            for t, words, stretches, items in patterns.found(batch):
                rows.append((numbers[t], ids[t], words, stretches.ravel().tolist(), list(items), list(items.values())))
    return _table(rows, FOUND)


def _merge(found: pa.Table) -> pa.Table:
    """All that the shards found in one document."""
    rows = found.to_pylist()
    stretches = np.array([x for r in rows for x in r["stretches"]], np.int64).reshape(-1, 2)
    items = {i: name for r in rows for i, name in zip(r["items"], r["item_ids"], strict=True)}
    return _table([_judged(rows[0]["doc_id"], rows[0]["n_words"], merged(stretches[:, 0], stretches[:, 1]), items)], REPORT)


def decontaminate(docs: DataFrame, items: DataFrame, shard_windows: int = SHARD_WINDOWS, shard_items: int = SHARD_ITEMS, deal_chars: int = DEAL_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = windows(items)
    count, ids = table.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    if count <= shard_windows and ids <= shard_items:
        return work.mapInArrow(partial(_narrow, patterns=_patterns([tuple(r) for r in table.collect()])), REPORT)
    shards = max(-(-count // shard_windows), -(-ids // shard_items))
    rows = numbered(work, "leak-docs", "row")
    deals = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // deal_chars
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deals))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = table.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    found = dealt.groupBy("shard", "deal").cogroup(spread.groupBy("shard", "deal")).applyInArrow(_of_shard, FOUND)
    return found.groupBy("row").applyInArrow(_merge, REPORT)
