"""Spark span detection equals a pure-Python model of the semantics on random texts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veilmark.functions import rules as R
from veilmark.operators import detect as D


def _dup(item, existing, theta):
    for ex in existing:
        ov = min(item[2], ex[2]) - max(item[1], ex[1])
        if ov > 0:
            li, le = item[2] - item[1], ex[2] - ex[1]
            if li > 0 and le > 0 and ov / min(li, le) >= theta:
                return True
    return False


def _luhn(s):
    d = [int(c) for c in s if c in "0123456789"][::-1]
    return bool(d) and sum(x if i % 2 == 0 else (x * 2 - 9 if x * 2 > 9 else x * 2) for i, x in enumerate(d)) % 10 == 0


def _find(text, rules, strip):
    out = []
    for r in rules:
        for m in re.finditer(r.pattern, text, re.IGNORECASE):
            t = m.group()
            s = t.strip() if strip else t
            if not s:
                continue
            st_ = m.start() + t.find(s)
            if r.validator == "luhn" and not _luhn(s):
                continue
            out.append((r.type, st_, st_ + len(s), s))
    return out


def _greedy(items, theta, seed=()):
    kept = list(seed)
    for it in items:
        if not _dup(it, kept, theta):
            kept.append(it)
    return kept


def model(text):
    base = _greedy(sorted(_find(text, R.default_base_recognizers(), False), key=lambda x: x[2] - x[1], reverse=True), 0.1)
    rules = _greedy(sorted(_find(text, R.business_rules(), True), key=lambda x: x[2] - x[1], reverse=True), 0.1)
    merged = _greedy(rules, 0.5, seed=base)
    return sorted(merged, key=lambda x: (x[1], x[0]))


ALPHABET = "0123456789" * 6 + "   --+@.,:\nabcPLxyzóąę" + " " + "😀"
texts = st.text(alphabet=ALPHABET, min_size=0, max_size=80)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(texts, min_size=40, max_size=60))
def test_detect_matches_python_model(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string")
    got = {}
    for r in D.detect(df).collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.text))
    for i, t in enumerate(batch):
        assert sorted(got.get(i, []), key=lambda x: (x[1], x[0])) == model(t), repr(t)


spans_st = st.lists(
    st.tuples(st.integers(1, 4), st.integers(0, 300), st.integers(0, 90), st.sampled_from(["A", "B", "C"])),
    min_size=1, max_size=60,
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(spans_st)
def test_overlap_pairs_equal_all_pairs(spark, raw):
    rows = sorted({(d, t, s, s + ln, "x") for d, s, ln, t in raw})
    df = spark.createDataFrame(rows, "doc_id long, type string, start int, end int, text string")
    got = sorted((r.doc_id, r.a_type, r.a_start, r.a_end, r.b_type, r.b_start, r.b_end, r.is_duplicate)
                 for r in D.span_overlap_pairs(df, bin_size=8).collect())
    want = []
    for a in rows:
        for b in rows:
            if a[0] != b[0] or a[3] <= a[2] or b[3] <= b[2]:
                continue
            if not ((a[2], a[3], a[1]) < (b[2], b[3], b[1])):
                continue
            ov = min(a[3], b[3]) - max(a[2], b[2])
            if ov > 0:
                want.append((a[0], a[1], a[2], a[3], b[1], b[2], b[3], ov / min(a[3] - a[2], b[3] - b[2]) >= 0.5))
    assert got == sorted(want)


plain_spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 25), st.text(min_size=0, max_size=8)), max_size=25)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(st.tuples(st.text(alphabet="abc ąę😀\n-", min_size=0, max_size=70), plain_spans), min_size=20, max_size=30))
def test_any_spans_of_any_types_are_masked_and_restored(spark, batch):
    """Overlapping spans, odd types: covered characters leave the text, and reinjection restores it."""
    from pyspark.sql import functions as F

    from veilmark.operators import mask as M
    from veilmark.operators import reinject as RJ

    rows = []
    for i, (t, spans) in enumerate(batch):
        ok = [(t[a:a + n], k, a, min(len(t), a + n), 1.0, "g") for a, n, k in spans if a < len(t)]
        rows.append((i, t, ok))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<text:string,type:string,start:int,end:int,score:double,source:string>>")
    m = M.mask(df).cache()
    got = {r.doc_id: r for r in RJ.reinject(m.select("doc_id", F.col("masked_text").alias("text")), M.vault_rows(m), "doc_id", "doc_id").collect()}
    masked = {r.doc_id: r for r in m.collect()}
    for i, t, spans in rows:
        assert got[i].reinjected == t
        covered = set().union(set(), *(range(a, b) for _, _, a, b, _, _ in spans))
        left = masked[i].masked_text
        for s in masked[i].tspans:
            left = left.replace(s.token, "\x01")
        assert [c for c in left if c != "\x01" and not c.isspace()] == [c for j, c in enumerate(t) if j not in covered and not c.isspace()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(texts, min_size=30, max_size=40))
def test_mask_reinject_roundtrip(spark, batch):
    from pyspark.sql import functions as F

    from veilmark.operators import mask as M
    from veilmark.operators import reinject as RJ

    df = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string")
    m = M.mask(D.with_spans(df))
    vault = M.vault_rows(m)
    r = RJ.reinject(m.select("doc_id", F.col("masked_text").alias("text")), vault, "doc_id", "doc_id")
    got = {x.doc_id: x.reinjected for x in r.collect()}
    assert [got[i] for i in range(len(batch))] == batch


def test_detect_matches_python_model_on_whole_tables(spark):
    """Every document and every derived order text of sf0.001, whole texts."""
    from veilmark.sources import derived
    from veilmark.sources import tables as TB

    sf = "/root/testdata/sf0.001"
    for df in (TB.documents(spark, sf).select("doc_id", "text"), derived.order_texts(spark, sf)):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = {}
        for r in D.detect(df).collect():
            got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.text))
        n_spans = 0
        for k, t in texts.items():
            want = model(t)
            n_spans += len(want)
            assert sorted(got.get(k, []), key=lambda x: (x[1], x[0])) == want, k
        assert n_spans > 0
