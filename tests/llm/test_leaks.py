"""Benchmark decontamination against a search of every window at every place."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.cases import CLASHING, frame, odd_rows
from veilmark.llm import leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item_id, text in items:
        w = words(text)
        windows.append(("" if item_id is None else str(item_id), {tuple(w[a:a + 10]) for a in range(max(1, len(w) - 9))} if w else set()))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), []
        for item_id, own in windows:
            at = {(i, len(x)) for x in own for i in range(len(w) - len(x) + 1) if tuple(w[i:i + len(x)]) == x}
            hit.update(j for i, m in at for j in range(i, i + m))
            found += [item_id] * bool(at)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed, odd=False):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "z9", "x-y", "cc", "ß", "語", "E"] + [f"w{i}" for i in range(rng.choice([1, 3, 40]))]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i if i % 7 else None, " ".join(pick(rng.choice([0, 1, 2, 9, 10, 11, 14])))) for i in range(12)]
    items += [(99, None), items[3], items[3], (100, "... --- ...")]
    docs = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 5000] if odd else []
    for i in range(40):
        w = pick(rng.choice([0, 3, 20, 60]))
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i % 30, ", ".join(w)))
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"shard_windows": 5, "deal_chars": 300}, {"shard_items": 7}])
def test_equals_brute_force(spark, limits):
    for seed in range(3):
        docs, items = tables(seed, odd=seed == 2)
        rows = [(d, t, None, None, None) for d, t in docs]
        got = leaks.decontaminate(frame(spark, rows, CLASHING if seed else ""), spark.createDataFrame(items, "item_id long, text string"), **limits)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.decontaminate(d.limit(0), i).collect() == []
    clean = leaks.decontaminate(d, i.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)


def test_clean_words_are_jumped_over():
    """In a text without a block of any window the search looks at every ninth word only."""
    patterns = leaks.Patterns([" ".join(f"p{i}" for i in range(10))], [[0]], [["0"]])
    (table,) = patterns.lengths
    assert table.jump == 9 and (table.shift == 0).sum() == 1
    seen = []
    hashed = table._hash
    table._hash = lambda code: seen.append(len(code)) or hashed(code)
    text = np.zeros(50_000, np.int64)
    text[7000:7010] = np.arange(1, 11)
    last, number = table.search(text)
    assert last.tolist() == [7009] and number.tolist() == [0]
    assert sum(seen) < 50_000 / 8


def test_one_bucket_of_many_windows():
    """Windows with the same last words are told apart by their first block, then word by word."""
    rows = [f"{a} {b} s s s s s s x y" for a in "abcdefgh" for b in "ijklmnop"]
    patterns = leaks.Patterns(rows, [[k] for k in range(len(rows))], [[str(k)] for k in range(len(rows))])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["q " + rows[5] + " z " + rows[60], "a i s s s s s x y", "s s x y"])], ["text"])
    assert [sorted(items) for _, _, _, items in patterns.found(batch)] == [[5, 60], [], []]


def test_stretches_are_merged():
    got = leaks.merged(np.array([5, 1, 2, 20]), np.array([9, 4, 6, 21]))
    assert got.tolist() == [[1, 9], [20, 21]]
    assert leaks.merged(np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 2)
