"""Periodic runs against a period-by-period brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.cases import CLASHING, frame, odd_rows
from veilmark.llm import runs


def brute(s, min_length, min_power):
    n, out = len(s), {}
    for q in range(1, n // min_power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_power * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        s = [rng.randint(0, k) for _ in range(n)]
        if n > 6 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 5)
            s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert runs.runs_of(np.array(s, np.int64), *limits) == brute(s, *limits)


def test_suffix_array_and_lcp():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        sa, levels = runs.suffix_array(np.array(s, np.int64))
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert levels[-1][sa].tolist() == list(range(len(s)))
        lcp = runs.neighbour_lcp(sa, levels)
        for k in range(1, len(s)):
            a, b = s[sa[k - 1]:], s[sa[k]:]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_highly_periodic_texts_stay_near_linear():
    began = time.process_time()
    assert runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.runs_of(np.arange(300_000) % 70_000) == [(0, 300_000, 70_000)]
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    assert runs.runs_of(np.array(b)) == []  # no word of this kind has a fourth power
    assert time.process_time() - began < 60


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 6, 4)
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_report(spark, extra):
    rng = random.Random(3)
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    for i in range(60):
        unit = [rng.choice("a b c ä".split()) for _ in range(rng.randint(1, 5))]
        rows.append((1000 + i, " ".join(["x", "y"] + unit * rng.randint(1, 7) + unit[:2] + ["z"] * rng.randint(0, 9)), "en", "a", 1))
    got = [tuple(r) for r in runs.report(frame(spark, rows, extra)).collect()]
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 30
    assert runs.report(frame(spark, rows, extra).limit(0)).collect() == []


def test_query_equals_brute_force_on_the_small_table(spark, sf_small):
    from veilmark.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0]: r[1] for r in docs if len(r[1] or "") < 4000}
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_small).collect()]
    assert len(got) == len(docs)
    assert sorted(g for g in got if g[0] in short) == sorted(expected(d, t) for d, t in short.items())
