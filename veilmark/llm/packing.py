"""Cost-balanced packing of documents into fixed-length training sequences.

A narrow, single pass: every task packs its own documents, so nothing is
shuffled and a lost executor only repeats its own partitions.  Within a task,
documents are taken in windows of a bounded number of tokens:

* a document is its subword ids and one closing id;
* whole multiples of the sequence length are cut off as full sequences;
* the rests, in descending order of length, go to the open sequence of lowest
  estimated cost that still has room.  A piece of n ids costs
  ``linear * n + quadratic * n * n`` (feed-forward and attention work);
* a rest that fits nowhere is cut: the fullest open sequences take what they have
  room for, the remaining part is placed in turn.

A window opens just as many sequences as its ids need, so all but the last are
full; the unfilled end of a window is carried into the next one.  What a task has
left at its end is cut into sequences whose lengths are powers of two, which need
no padding: the packing has none.

Cases: a null text is an empty document (its closing id alone); repeated rows are
packed each by itself; an empty table gives no pieces; a null doc_id stays null;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import slices
from veilmark.llm.subwords import BYTE_BPE, BYTE_BPE_RANKS, encoder

SEQUENCE = 1024
#: Id after the last id of each document.
CLOSING_ID = 0
#: Ids that a task packs at a time (held in memory as 4-byte numbers).
WINDOW_IDS = 2_000_000
#: Weights of the cost estimate of a piece of n ids.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Sequence numbers of one task start at its partition number times this.
TASK_SPAN = 1 << 36

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], room: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Place documents of ``lengths`` into open sequences with ``room`` ids left.

    Returns pieces (document, start in the document, length, sequence).  The sum
    of ``room`` must be the sum of ``lengths`` or more.
    """
    left = list(room)
    heap = [(0.0, s) for s in range(len(left))]
    heapq.heapify(heap)
    placed: list[tuple[int, int, int, int]] = []
    cost = [0.0] * len(left)

    def put(doc: int, start: int, n: int, s: int) -> None:
        placed.append((doc, start, n, s))
        left[s] -= n
        cost[s] += linear * n + quadratic * n * n

    short: list[tuple[int, int]] = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        n, skipped = lengths[doc], []
        while heap and left[heap[0][1]] < n:
            skipped.append(heapq.heappop(heap))
        if heap:
            _, s = heapq.heappop(heap)
            put(doc, 0, n, s)
            if left[s]:
                heapq.heappush(heap, (cost[s], s))
        else:
            short.append((doc, n))
        # a sequence passed over may still have room for shorter documents
        for x in skipped:
            if left[x[1]]:
                heapq.heappush(heap, x)
    if short:
        gaps = sorted((left[s], s) for s in range(len(left)) if left[s])
        for doc, n in short:
            start = 0
            while start < n:
                free, s = gaps.pop()
                take = min(free, n - start)
                put(doc, start, take, s)
                start += take
                if free > take:
                    gaps.append((free - take, s))
    return placed


def powers(n: int, size: int) -> list[int]:
    """``n`` as a sum of powers of two, ``size`` at most each, in descending order."""
    out = [size] * (n // size)
    n %= size
    while n:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


class Packer:
    """Packs the documents of one task, a window at a time."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # doc_id, ids, ids placed before, ids in all
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self.row(doc_id, ids[start:start + self.size], start, n, self.next, 0)
            self.next += 1
        if whole < n:
            self.docs.append((doc_id, ids[whole:].copy(), whole, n))
            self.held += n - whole

    def row(self, doc_id, ids: np.ndarray, start: int, n: int, sequence: int, offset: int) -> None:
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
        self.rows.append((doc_id, start, len(ids), crc, n, sequence, offset))

    def window(self, last: bool) -> None:
        """Fill sequences with what is held; keep the unfilled rest unless this is the last window."""
        sizes = powers(self.held, self.size) if last else [self.size] * (self.held // self.size)
        keep = self.held - sum(sizes)
        kept: list[tuple[object, np.ndarray, int, int]] = []
        docs = self.docs
        while keep:  # the ids that fill no sequence wait for the next window
            doc_id, ids, before, n = docs.pop()
            take = min(keep, len(ids))
            kept.append((doc_id, ids[len(ids) - take:], before + len(ids) - take, n))
            if take < len(ids):
                docs.append((doc_id, ids[:len(ids) - take], before, n))
            keep -= take
        used = [0] * len(sizes)
        for d, start, length, s in assign([len(x[1]) for x in docs], sizes):
            doc_id, ids, before, n = docs[d]
            self.row(doc_id, ids[start:start + length], before + start, n, self.next + s, used[s])
            used[s] += length
        self.next += len(sizes)
        self.docs, self.held = kept, sum(len(x[1]) for x in kept)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def _pack_task(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str, size: int, window: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, ranks_path)
    packer = Packer(size, TaskContext.get().partitionId() * TASK_SPAN)
    closing = np.array([CLOSING_ID], np.uint32)
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.concatenate([enc.ids(text or ""), closing]))
                if packer.held >= window:
                    packer.window(last=False)
            if packer.rows:
                yield packer.taken()
    packer.window(last=True)
    yield packer.taken()


def pack(
    docs: DataFrame, path: str = BYTE_BPE, ranks_path: str = BYTE_BPE_RANKS, size: int = SEQUENCE, window: int = WINDOW_IDS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_pack_task, path=path, ranks_path=ranks_path, size=size, window=window), PIECES)
