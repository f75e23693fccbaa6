"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers:

* the *normaliser* writes a meta space for each space and one before the text;
* the *pieces*: a trie over characters whose final states write a piece's id;
* the *byte fallback* writes the byte ids of a character that is no piece.

Composed with an input they give a lattice of ids, and the encoding is its
shortest path in the tropical semiring.  In a unigram model a piece weighs its
negative score.  In a BPE model the weights are on pairs: a pair of neighbours
weighs nothing if the merges of their joined text give just this pair, else
infinity; that leaves one path of finite weight, the one that the merges give.
Pair weights are computed when a lattice first needs them and kept.

Merges never cross a place between two characters that are adjacent in no piece.
Texts are cut at such places (a table over ASCII pairs, taken from the model), so
only the distinct strings of a block of texts go through the lattice.

Decoding runs the pieces backwards: ids to bytes, meta spaces to spaces, the first
one dropped; bytes that are not UTF-8 become U+FFFD.

Cases: a null or empty text has no ids; a literal meta space is read as a space;
ids outside the model are an error; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import flat, pieces_of, slices, spread_index

MODEL = public_tokenizers.path("piece_bpe_32k.model")
META = "▁"
#: Kinds of pieces and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs above the worst piece in a unigram model.
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's table of encoded strings; it is emptied when full.
CACHE_ENTRIES = 400_000
CACHE_BYTES = 48
#: First labels of the kept pair weights (each has a row of second labels).
CACHE_PAIRS = 40_000

_models: dict[str, "Model"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, raw[i:i + size]
        i += size


class Model:
    """The compiled transducers of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer, norm = (dict(_fields(next((v for n, v in top if n == k), b""))) for k in (2, 3))
        self.type = trainer.get(3, UNIGRAM)
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("only an identity normaliser that keeps white space is supported")
        self.prefix = bool(norm.get(3, 1))
        self.pieces, self.scores, self.kinds = [], [], []
        for v in (dict(_fields(v)) for n, v in top if n == 1):
            self.pieces.append(v.get(1, b"").decode())
            self.scores.append(struct.unpack("<f", v[2])[0] if 2 in v else 0.0)
            self.kinds.append(v.get(3, NORMAL))
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.worst = min((self.scores[i] for i in self.id_of.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie: dict = {}
        for p, i in self.id_of.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[None] = i
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(META, " ").encode()
                    for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.cut = self._cut_table()
        self.cache: dict[bytes, bytes] = {}
        self.pair: dict[int, dict[int, bool]] = {}

    def _cut_table(self) -> np.ndarray:
        """[a, b]: may a text be cut between the bytes a and b?  ASCII only, a space read as the meta space."""
        cut = np.zeros((256, 256), bool)
        cut[:128, :128] = True
        for p in self.id_of:
            p = p.replace(META, " ")
            for a, b in zip(p, p[1:]):  # noqa: B905
                if a < "\x80" and b < "\x80":
                    cut[ord(a), ord(b)] = False
        return cut

    # ------------------------------------------------------------ BPE pair weights
    def merged(self, text: str) -> list[str]:
        """The symbols that the merges leave of ``text``: best score first, then leftmost."""
        symbols = list(text)
        nxt, prv = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and nxt[i] < len(symbols):
                both = symbols[i] + symbols[nxt[i]]
                if both in self.id_of:
                    heapq.heappush(heap, (-self.scores[self.id_of[both]], i, both))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not symbols[i] or nxt[i] >= len(symbols) or symbols[i] + symbols[nxt[i]] != both:
                continue
            j = nxt[i]
            symbols[i], symbols[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(symbols):
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [s for s in symbols if s]

    def fits(self, a: int, b: int) -> bool:
        """Is the weight of a pair of arc labels finite?  (-1: the start of the text.)"""
        first, second = self.label_text(a), self.label_text(b)
        return self.merged(first + second) == ([first, second] if first else [second])

    def label_text(self, label: int) -> str:
        return "" if label == -1 else chr(-2 - label) if label < 0 else self.pieces[label]

    # --------------------------------------------------------------- shortest path
    def arcs(self, text: str, start: int) -> list[tuple[int, int]]:
        """(end, label) of the composed lattice's arcs at a position, the longest last.

        A label is a piece's id, or below -1 a character that is no piece (byte
        fallback, or the unknown piece).
        """
        out, node, n = [], self.trie, len(text)
        end = start
        while end < n:
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            label = node.get(None)
            if label is not None:
                out.append((end, label))
        if not out or out[0][0] != start + 1:
            out.insert(0, (start + 1, -2 - ord(text[start])))
        return out

    def path(self, text: str) -> list[int]:
        """Labels on the shortest path through the lattice of a normalised text."""
        return self.path_of_pairs(text) if self.type == BPE else self.path_of_scores(text)

    def path_of_scores(self, text: str) -> list[int]:
        """Piece weights: the tropical sums are relaxed position by position."""
        n, inf = len(text), float("inf")
        cost, via = [0.0] + [inf] * n, [(0, 0)] * (n + 1)
        for start in range(n):
            for end, label in self.arcs(text, start):
                c = cost[start] - (self.scores[label] if label >= 0 else self.worst)
                if c < cost[end]:
                    cost[end], via[end] = c, (start, label)
        out, at = [], n
        while at:
            at, label = via[at]
            out.append(label)
        return out[::-1]

    def path_of_pairs(self, text: str) -> list[int]:
        """Pair weights of zero or infinity: the first complete path of finite weight is the shortest.

        A position has one finite path to it, so a position from which none goes on
        is never tried again.
        """
        n, pair = len(text), self.pair
        labels, ends, open_arcs, closed = [-1], [0], [self.arcs(text, 0)] if n else [], set()
        while ends[-1] < n:
            arcs, prev = open_arcs[-1], labels[-1]
            row = pair.get(prev)
            if row is None:
                if len(pair) > CACHE_PAIRS:
                    pair.clear()
                row = pair[prev] = {}
            while arcs:
                end, label = arcs.pop()
                if end in closed:
                    continue
                fits = row.get(label)
                if fits is None:
                    fits = row[label] = self.fits(prev, label)
                if fits:
                    labels.append(label)
                    ends.append(end)
                    if end < n:
                        open_arcs.append(self.arcs(text, end))
                    break
            else:
                closed.add(ends.pop())
                labels.pop()
                open_arcs.pop()
        return labels[1:]

    def ids(self, normalised: str) -> list[int]:
        out: list[int] = []
        for label in self.path(normalised):
            if label >= 0:
                out.append(label)
            elif self.byte_id:
                out += [self.byte_id[c] for c in self.label_text(label).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    # -------------------------------------------------------------------- columns
    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        data, off = flat(column)
        n = len(off) - 1
        filled = np.diff(off) > 0
        if self.prefix:
            data = np.insert(data, off[:-1][filled], 32)
            off = off + np.concatenate([[0], np.cumsum(filled)])
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = self.cut[data[:-1], data[1:]]
        cut[off] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        distinct, index = pieces_of(data, cuts)
        cache, coded = self.cache, []
        for s in distinct.to_pylist():
            ids = cache.get(s)
            if ids is None:
                ids = np.array(self.ids(s.decode().replace(" ", META)), "<u4").tobytes()
                if len(s) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[s] = ids
            coded.append(ids)
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        every = np.frombuffer(b"".join(coded), "<u4")
        per = lens[index]
        out = every[spread_index((np.cumsum(lens) - lens)[index], per)]
        ends = np.concatenate([[0], np.cumsum(per)])
        return out, ends[np.searchsorted(cuts, off)]

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of a list of ids."""
        out = self.out
        raw = b"".join([out[i] for i in ids])
        return raw[1:] if self.prefix and raw[:1] == b" " else raw


def model(path: str = MODEL) -> Model:
    """The worker's compiled model (kept between tasks)."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, off = m.encode(batch.column(1))
            ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column(0), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_encode_batches, path=path), "doc_id long, ids array<int>")


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        texts = [m.decode(ids or []).decode(errors="replace") for ids in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    work = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return work.mapInArrow(partial(_decode_batches, path=path), "doc_id long, text string")


ROUND_TRIP = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _round_trip_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import hashlib

    m = model(path)
    is_byte = np.array([k == BYTE for k in m.kinds])
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, off = m.encode(batch.column(1))
            small = ids.astype("<u4")
            fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                a, b = int(off[i]), int(off[i + 1])
                back = m.decode(ids[a:b].tolist())
                rows.append((b - a, int(fallback[b] - fallback[a]), zlib.crc32(small[a:b].tobytes()), hashlib.sha256(back).hexdigest(),
                             back == (text or "").replace(META, " ").encode()))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [c.split()[0] for c in ROUND_TRIP.split(", ")])


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encode and decode every whole text: numbers of ids and byte ids, digests of the ids and of the decoded text."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(partial(_round_trip_batches, path=path), ROUND_TRIP)
