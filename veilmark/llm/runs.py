"""Periodic runs of words: an enhanced suffix array with the branching-tandem test.

Texts are taken in slices of a few MB; a word's symbol is its number together with
the number of its text, so that suffixes of different texts share nothing.

1. Suffix array by prefix doubling: each round sorts only the suffixes that are still
   tied.  The ranks of all rounds give the LCP of neighbours.
2. LCP intervals are the nearest smaller values to the left and right of each LCP
   entry; entries with equal interval are its child borders.  No tree is built.
3. Branching tandem repeats: in an interval of depth D, each suffix i of all children
   but the largest looks up ISA[i + D] and ISA[i - D].  Is that suffix in the interval
   but in another child, then a square of period D stands there that the next word
   breaks (n log n lookups in all).
4. A square is rotated to the left as long as words D apart are equal, which gives
   the run that it ends.  Squares of a power of a shorter period end the same run as
   their root and are left out before they are rotated; that keeps the rotations at
   n log n words.

Only runs of ``length >= max(MIN_LENGTH, MIN_POWER * period)`` are kept.

Cases: a null or empty text has no words, no run and the hashes of the empty string;
a text of any length is handled whole (its arrays live in one task); repeated rows
are handled each by itself; a null doc_id counts as the empty text for the planted
copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import flat, slices, spaces, spread_index
from veilmark.llm.wordseq import word_numbers

MIN_LENGTH, MIN_POWER = 6, 4
#: Words that a rotation compares at first; doubled at each step.
ROTATED = 64

REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


# ---------------------------------------------------------------------------
# Suffix array, LCP, intervals
# ---------------------------------------------------------------------------
def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... symbols); the last ranks are the inverse array."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.diff(symbols[sa], prepend=symbols[sa[:1]] - 1))
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(heads, sizes)
    levels = [rank]
    slot = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the suffix array that are still tied
    step = 1
    while len(slot):
        tied = sa[slot]
        after = tied + step
        beyond = after >= n
        after[beyond] = 0
        key = rank[after] + 1
        key[beyond] = 0
        key += rank[tied] * (n + 1)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        sa[slot] = tied
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(np.append(heads, len(key)))
        rank = rank.copy()
        rank[tied] = np.repeat(slot[heads], sizes)
        levels.append(rank)
        slot = slot[np.repeat(sizes > 1, sizes)]
        step *= 2
    return sa, levels


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Equal leading symbols of each suffix and the one before it in the array; 0 at both ends."""
    n = len(sa)
    out = np.zeros(n + 1, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    pairs, alive = [], np.arange(n - 1)
    for rank in levels:
        alive = alive[rank[a[alive]] == rank[b[alive]]]
        pairs.append(alive)
        if not len(alive):
            break
    for k in range(len(pairs) - 1, -1, -1):
        at = pairs[k]
        inside = at[np.maximum(a[at], b[at]) < n]
        equal = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[equal] += 1 << k
        b[equal] += 1 << k
        out[equal + 1] += 1 << k
    return out


def nearest_smaller(values: np.ndarray, at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the nearest place with a smaller value, in the direction of ``pointer``.

    ``pointer`` starts with the neighbour of every place; all values that a pointer
    has passed are no smaller, so following two pointers at a time stays right.
    """
    todo = at
    while len(todo):
        todo = todo[values[pointer[todo]] >= values[todo]]
        pointer[todo] = pointer[pointer[todo]]
    return pointer[at]


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that the word after it breaks."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    sa, levels = suffix_array(symbols)
    isa = levels[-1]
    lcp = neighbour_lcp(sa, levels)
    border = np.flatnonzero(lcp)
    if not len(border):
        return none, none
    place = np.arange(n + 1)
    left = nearest_smaller(lcp, border, np.maximum(place - 1, 0))
    right = nearest_smaller(lcp, border, np.minimum(place + 1, n))
    # borders of one interval together, in ascending order
    order = np.argsort(left * (n + 1) + right, kind="stable")
    border, left, right = border[order], left[order], right[order]
    first = np.flatnonzero((np.diff(left, prepend=-1) != 0) | (np.diff(right, prepend=-1) != 0))
    count = np.diff(np.append(first, len(border)))
    # children: one before each border and the last one after it
    total = len(border) + len(first)
    interval = np.repeat(np.arange(len(first)), count + 1)
    opening = np.zeros(total, bool)
    opening[first + np.arange(len(first))] = True
    begin = np.empty(total, np.int64)
    begin[opening], begin[~opening] = left[first], border
    end = np.append(begin[1:], 0)
    closing = np.append(opening[1:], True)
    end[closing] = right[first]
    size = end - begin
    # the largest child of each interval is not looked at
    largest = np.maximum.reduceat(size, np.flatnonzero(opening))
    is_largest = size == largest[interval]
    seen = np.flatnonzero(is_largest)
    keep = np.ones(total, bool)
    keep[seen[np.diff(interval[seen], prepend=-1) != 0]] = False
    child = np.flatnonzero(keep)
    depth = lcp[border[first]][interval[child]]
    per = size[child]
    suffix = sa[spread_index(begin[child], per)]
    owner = np.repeat(np.arange(len(child)), per)
    period = depth[owner]
    lo, hi = left[first][interval[child]], right[first][interval[child]]
    starts, periods = [], []
    for sign in (1, -1):
        other = suffix + sign * period
        inside = np.flatnonzero((other >= 0) & (other < n))
        found, of = isa[other[inside]], owner[inside]
        hit = inside[(found >= lo[of]) & (found < hi[of]) & ((found < begin[child][of]) | (found >= end[child][of]))]
        starts.append(suffix[hit] if sign > 0 else other[hit])
        periods.append(period[hit])
    both = np.unique(np.concatenate(periods) * n + np.concatenate(starts))
    return both % n, both // n


# ---------------------------------------------------------------------------
# Runs
# ---------------------------------------------------------------------------
def _rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """How many places to the left the square at ``start`` can be rotated."""
    done, width = 0, ROTATED
    while done < start:
        width = min(width, start - done)
        a = start - done - width
        differ = np.flatnonzero(symbols[a:a + width] != symbols[a + period:a + period + width])
        if len(differ):
            return done + width - 1 - int(differ[-1])
        done += width
        width *= 2
    return done


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``min_power`` of at least 2.

    Symbols of different texts must differ, then no run crosses texts.
    """
    start, period = branching_squares(symbols)
    # a run of min_power periods that ends with this square begins so far before it
    back = (min_power - 2) * period
    at = np.flatnonzero(start >= back)
    at = at[(symbols[start[at] - back[at]] == symbols[start[at] - back[at] + period[at]])]
    at = at[(back[at] == 0) | (symbols[np.maximum(start[at] - 1, 0)] == symbols[start[at] - 1 + period[at]])]
    start, period = start[at], period[at]
    end = start + 2 * period
    order = np.lexsort((period, end))
    out, here, last = [], [], -1
    for s, p, e in zip(start[order].tolist(), period[order].tolist(), end[order].tolist(), strict=True):
        if e != last:
            here, last = [], e
        # a multiple of a period whose run covers the square gives that run again
        if any(p % q == 0 and a <= s for a, q in here):
            continue
        a = s - _rotations(symbols, s, p)
        here.append((a, p))
        if e - a >= max(min_length, min_power * p):
            out.append((a, e - a, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word each of ``n`` words becomes."""
    at = np.arange(n)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = batch.column(0).to_pylist()
            data, off = flat(batch.column(1))
            distinct, number, _, first = word_numbers(data, off, ~spaces(data))
            counts = np.diff(first)
            source = np.concatenate([np.zeros(0, np.int64), *(planted(n, d) + a for n, d, a in zip(counts.tolist(), ids, first.tolist()))])
            number = number[source]
            text = np.repeat(np.arange(len(ids)), counts)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for a, length, period in runs_of(text * (len(distinct) + 1) + number):
                found.setdefault(int(text[a]), []).append((a - int(first[text[a]]), length, period))
            spelled = np.array(distinct.to_pylist() + [b""], object)
            rows = []
            for t, doc_id in enumerate(ids):
                runs = found.get(t, [])
                words = spelled[number[first[t]:first[t + 1]]]
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
                if runs:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, [a + p for a, _, p in runs], 1)
                    np.add.at(edges, [a + n for a, n, _ in runs], -1)
                    words = words[np.cumsum(edges[:-1]) == 0]
                listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()
                rows.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], _sha(listed), _sha(b" ".join(words.tolist()))))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period, and the hashes of all runs and of the collapsed text."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(_report, REPORT)
