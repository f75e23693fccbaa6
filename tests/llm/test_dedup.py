"""Exact and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.cases import CLASHING, frame, odd_rows
from veilmark.llm import exact, neardup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((1, 10), (5, 8), (1000, 1 << 30), (3000, 1 << 45), (0, 5)):
        values = np.unique(rng.integers(0, span, n))
        k, unary, remainders = exact.rice_encode(values, span)
        assert (exact.rice_decode(len(values), k, unary, remainders) == values).all()


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_exact_decisions(spark, extra):
    rows = odd_rows()
    df = frame(spark, rows, extra)
    out, names = exact.decided(df)
    got = out.collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    kept = defaultdict(int)
    for r in got:
        ids = groups[norm(r["text"])]
        known = [i for i in ids if i is not None]
        assert r[names["keep_id"]] == (min(known) if known else None)
        assert r[names["group_size"]] == len(ids)
        assert r[names["text_sha256"]] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
        kept[norm(r["text"])] += r[names["kept"]]
        if r[names["kept"]]:
            assert r["doc_id"] == r[names["keep_id"]]
    assert set(kept.values()) == {1}
    left = exact.deduplicate(df)
    assert left.columns == df.columns and left.count() == len(groups)


def test_hashes_that_agree_by_chance_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(exact, "SPARE_BITS", 1)
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(800)]
    out, names = exact.decided(frame(spark, rows))
    assert out.where(f"NOT {names['kept']} OR {names['group_size']} > 1").count() == 0


def test_one_group_of_all_rows(spark):
    rows = [(i, "the same  text" if i % 2 else "the same text", "en", "a", 1) for i in range(1000)]
    out, names = exact.decided(frame(spark, rows))
    assert [tuple(r) for r in out.groupBy(names["keep_id"], names["group_size"]).count().collect()] == [(0, 1000, 1000)]


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rows = odd_rows()
    got = neardup.near_duplicates(frame(spark, rows, "component_id fingerprint")).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps, neardup.DISTANCE)
    least = defaultdict(list)
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c].append(r[0])
    want = sorted((str(r[0]), f"{f:016x}", min(least[c])) for r, f, c in zip(rows, fps, roots, strict=True))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def near_sets(seed, n, flips):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(x)
            for _ in range(rng.randint(1, flips)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize(("seed", "flips"), [(1, 4), (2, 7), (3, 2)])
def test_components_of_random_fingerprints(spark, seed, flips):
    fps = near_sets(seed, 400, flips)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long").repartition(4)
    found = {r[0]: r[1] for r in neardup.components(neardup.links(nodes, 4, bucket=4)).collect()}
    ours = defaultdict(set)
    for f, (s,) in zip(fps, signed, strict=True):
        ours[found.get(s, s)].add(f)
    theirs = defaultdict(set)
    for f, c in zip(fps, brute_components(fps, 4), strict=True):
        theirs[c].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_gray_forest_of_a_dense_group():
    rng = np.random.default_rng(0)
    fps = np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fps = np.unique(fps)
    fps = fps[np.argsort(neardup.gray_rank(fps), kind="stable")]
    member, root = neardup.GrayForest(fps, np.zeros(len(fps), np.int64)).forest(4)
    assert len(member) == len(fps) - 1 and (root == 0).all()


@pytest.mark.parametrize("extra", ["", CLASHING])
def test_near_dedup_keeps_one_of_each_group(spark, extra):
    rows = odd_rows()
    df = frame(spark, rows, extra)
    left = neardup.deduplicate(df)
    assert left.columns == df.columns
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert left.count() == len(set(brute_components(fps, neardup.DISTANCE)))


def test_empty_tables(spark):
    df = frame(spark, []).limit(0)
    assert exact.deduplicate(df).count() == 0
    assert neardup.deduplicate(df).count() == 0
    assert neardup.near_duplicates(df).count() == 0
