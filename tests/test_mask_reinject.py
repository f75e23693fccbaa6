"""Masking/reinjection invariants over whole documents."""

from pyspark.sql import functions as F

from veilmark.operators import detect as D
from veilmark.operators import mask as M
from veilmark.operators import reinject as RJ
from veilmark.sources import tables as TB


def _masked(spark, sf):
    return M.mask(D.with_spans(TB.documents(spark, sf).select("doc_id", "text"))).cache()


def test_roundtrip_and_no_leak(spark, sf_small):
    m = _masked(spark, sf_small)
    vault = M.vault_rows(m)
    answers = m.select("doc_id", F.col("masked_text").alias("text"))
    r = RJ.reinject(answers, vault, "doc_id", "doc_id").join(m.select("doc_id", F.col("text").alias("orig")), "doc_id")
    assert r.filter(F.col("reinjected") != F.col("orig")).count() == 0
    assert r.filter(F.col("n_unresolved") != 0).count() == 0
    leak = m.select("doc_id", "masked_text", F.explode("tspans").alias("s")).filter(
        F.col("masked_text").contains(F.col("s.text")))
    assert leak.count() == 0
    assert M.token_collisions(vault).count() == 0
    assert m.filter(F.size("tspans") > 0).count() > 0


def test_spans_disjoint_sorted_and_exact(spark, sf_small):
    m = _masked(spark, sf_small)
    for row in m.select("text", "tspans").collect():
        prev_end = 0
        for s in row.tspans:
            assert s.start >= prev_end
            assert row.text[s.start:s.end] == s.text
            prev_end = s.end


def test_same_value_same_token(spark):
    df = spark.createDataFrame([(1, "a@b.pl i znowu a@b.pl.")], "doc_id long, text string")
    (r,) = M.mask(D.with_spans(df)).collect()
    toks = [s.token for s in r.tspans]
    assert len(toks) == 2 and toks[0] == toks[1] and r.masked_text.count(toks[0]) == 2
    assert toks[0].startswith("[EMAIL_")


def test_unresolved_and_empty_map(spark):
    tm = F.create_map(F.lit("[OSOBA_abcd]"), F.lit("Jan"))
    df = spark.createDataFrame([("Hi [OSOBA_abcd] and [PESEL_ffff] [PESEL_ffff]",)], "text string")
    (r,) = df.select(RJ.reinject_text(F.col("text"), tm).alias("t"), RJ.unresolved(F.col("text"), tm).alias("u"),
                     RJ.unresolved(F.col("text"), F.create_map().cast("map<string,string>")).alias("e")).collect()
    assert r.t == "Hi Jan and [PESEL_ffff] [PESEL_ffff]"
    assert r.u == ["[PESEL_ffff]", "[PESEL_ffff]"] and r.e == []


def test_remask_longest_first(spark):
    vault = spark.createDataFrame([("1", "[OSOBA_aaaa]", "PERSON", "Jan Kowalski"), ("1", "[OSOBA_bbbb]", "PERSON", "Jan")],
                                  "session_id string, token string, type string, value string")
    turns = spark.createDataFrame([(1, 0, "Jan Kowalski i Jan")], "conv_id long, turn long, text string")
    (r,) = M.remask(turns, vault, "conv_id").collect()
    assert r.text == "[OSOBA_aaaa] i [OSOBA_bbbb]"


def _given(spark, rows):
    """(doc_id, text, spans) with spans (start, end, type) cut from the text."""
    data = [(i, t, [(t[a:b], k, a, b, 1.0, "given") for a, b, k in spans]) for i, t, spans in rows]
    return spark.createDataFrame(data, "doc_id long, text string, spans array<struct<text:string,type:string,start:int,end:int,score:double,source:string>>")


def _tokens_in(row):
    return {s.token for s in row.tspans}


def test_overlapping_spans_leave_nothing_in_clear_text(spark):
    text = "ABCDEFGHIJKLMNOPQRST uvw"
    cases = [[(0, 10, "A"), (8, 20, "B")], [(5, 8, "A"), (0, 20, "B")], [(0, 3, "A"), (2, 6, "B"), (5, 9, "C"), (1, 20, "D")], [(0, 20, "A"), (3, 5, "B")]]
    rows = M.mask(_given(spark, [(i, text, c) for i, c in enumerate(cases)])).orderBy("doc_id").collect()
    for r, spans in zip(rows, cases, strict=True):
        rest = r.masked_text
        for t in _tokens_in(r):
            rest = rest.replace(t, "")
        covered = set().union(*(range(a, b) for a, b, _ in spans))
        assert rest == "".join(c for i, c in enumerate(text) if i not in covered)
    back = RJ.reinject(M.mask(_given(spark, [(i, text, c) for i, c in enumerate(cases)])).select("doc_id", F.col("masked_text").alias("text")),
                       M.vault_rows(M.mask(_given(spark, [(i, text, c) for i, c in enumerate(cases)]))), "doc_id", "doc_id").collect()
    assert all(b.reinjected == text for b in back)


def test_types_outside_the_token_grammar_are_restored(spark):
    kinds = ["IT-INFRA 2", "", "zażółć/9", "漢字", "a|b", "PERSON", "[X]"]
    df = _given(spark, [(i, "wartość tutaj", [(0, 7, k)]) for i, k in enumerate(kinds)])
    m = M.mask(df)
    r = RJ.reinject(m.select("doc_id", F.col("masked_text").alias("text")), M.vault_rows(m), "doc_id", "doc_id").collect()
    assert [(x.reinjected, x.n_tokens, x.n_unresolved) for x in r] == [("wartość tutaj", 1, 0)] * len(kinds)


def test_masking_many_spans(spark):
    n = 2000
    text = "".join(f"<{i:05d}> " for i in range(n))
    df = _given(spark, [(0, text, [(8 * i + 1, 8 * i + 6, "N") for i in range(n)])])
    (r,) = M.mask(df).collect()
    assert len(r.tspans) == n and r.masked_text == "".join(f"<{s.token}> " for s in r.tspans)


def test_remask_leaves_tokens_alone(spark):
    vault = spark.createDataFrame([("1", "[PROJEKT_TAJNY_aaaaaaaaaaaa]", "S", "10.0.0.5"), ("1", "[X_bbbbbbbbbbbb]", "X", "PROJEKT"),
                                   ("1", "[X_cccccccccccc]", "X", "IP"), ("2", "[X_dddddddddddd]", "X", "nie")],
                                  "session_id string, token string, type string, value string")
    turns = spark.createDataFrame([(1, 0, "IP 10.0.0.5 i [PROJEKT_abcd] PROJEKT nie"), (1, 1, "x"), (3, 0, "IP")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.text for r in M.remask(turns, vault, "conv_id").collect()}
    assert got == {(1, 0): "[X_cccccccccccc] [PROJEKT_TAJNY_aaaaaaaaaaaa] i [PROJEKT_abcd] [X_bbbbbbbbbbbb] nie", (1, 1): "x", (3, 0): "IP"}


def test_remask_takes_the_token_of_the_earliest_span(spark):
    vault = spark.createDataFrame([("1", "[A_aaaa]", "A", "Ola", 9), ("1", "[B_bbbb]", "B", "Ola", 2)],
                                  "session_id string, token string, type string, value string, first_start int")
    turns = spark.createDataFrame([(1, 0, "Ola")], "conv_id long, turn long, text string")
    assert [r.text for r in M.remask(turns, vault, "conv_id").collect()] == ["[B_bbbb]"]


def test_payload_leaks_are_seen(spark):
    from veilmark.operators import conversations as CV

    vault = spark.createDataFrame([("1", "[X_aaaaaaaaaaaa]", "X", "tajne słowo")], "session_id string, token string, type string, value string")
    lines = spark.createDataFrame([(1, 0, "user", "a tajne słowo b"), (1, 1, "user", "a [X_aaaaaaaaaaaa] b"), (2, 0, "user", "tajne słowo")],
                                  "conv_id long, seq long, role string, line string")
    assert [(r.conv_id, r.seq) for r in CV.payload_leaks(lines, vault).collect()] == [(1, 0)]
    turns = spark.createDataFrame([(1, 0, "user", "to tajne słowo")], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(1, "dokument [X_aaaaaaaaaaaa]")], "conv_id long, masked_text string")
    tasks = spark.createDataFrame([(1, "ollama")], "task_id long, provider string")
    out = CV.outbound_payload(turns, docs, vault, tasks)
    assert sorted((r.seq, r.role, r.line) for r in out.collect()) == [(0, "document", "dokument [X_aaaaaaaaaaaa]"), (1, "Użytkownik", "to [X_aaaaaaaaaaaa]")]
    assert CV.payload_leaks(out, vault).count() == 0


def test_missing_tokens(spark):
    vault = spark.createDataFrame([("1", f"[X_{i:012x}]", "X", str(i)) for i in range(5)], "session_id string, token string, type string, value string")
    answers = spark.createDataFrame([("a", 1, "[X_000000000001] [X_000000000003]"), ("b", 1, ""), ("c", 2, "")], "id string, sid long, text string")
    got = sorted((r.id, r.token[-2]) for r in RJ.missing_tokens(answers, vault, "id", "sid").collect())
    assert got == [("a", "0"), ("a", "2"), ("a", "4")] + [("b", str(i)) for i in range(5)]


def test_solution_extract(spark):
    df = spark.createDataFrame([("Intro <ROZWIAZANIE>\n wynik \n</ROZWIAZANIE> koniec",), ("<ROZWIAZANIE>x</ROZWIAZANIE>",),
                                ("bez tagów",)], "text string")
    sol, msg = RJ.solution_extract(F.col("text"))
    rows = df.select(sol.alias("s"), msg.alias("m")).collect()
    assert (rows[0].s, rows[0].m) == ("wynik", "Intro  koniec")
    assert rows[1].m.startswith("Plik został przetworzony")
    assert (rows[2].s, rows[2].m) == (None, "bez tagów")


def test_only_candidates_leave_the_texts(spark):
    """The session's filter is asked before anything is exploded: rows follow the values found, not the characters."""
    import random

    rng = random.Random(5)
    vault = spark.createDataFrame([(str(s), f"[P_{s:02x}{i:06x}]", f"Name{s}x{i}") for s in range(3) for i in range(40)], "session_id string, token string, value string")
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = [(t % 4, t, "".join(rng.choice(letters) for _ in range(3000)) + (f" Name{t % 4}x{t % 50} " if t % 5 == 0 else "")) for t in range(60)]
    turns = spark.createDataFrame(texts, "conv_id long, turn long, text string")
    values = M.value_keys(M.inverse_pairs(vault))
    got = M.candidate_grams(turns, values, "conv_id", "text").select("turn", F.size("_grams").alias("n")).collect()
    characters = sum(len(t) for _, _, t in texts)
    assert sum(r.n for r in got) < characters / 100
    out = {r.turn: r.text for r in M.remask(turns, vault, "conv_id").collect()}
    for s, t, text in texts:
        want = text
        if t % 5 == 0 and s < 3 and t % 50 < 40:
            want = text.replace(f"Name{s}x{t % 50}", f"[P_{s:02x}{t % 50:06x}]")
        elif t % 5 == 0 and s < 3:  # a shorter name inside a longer one
            want = text.replace(f"Name{s}x{t % 50 // 10}", f"[P_{s:02x}{t % 50 // 10:06x}]")
        assert out[t] == want


def test_filters_of_a_session_of_any_size(spark):
    many = spark.createDataFrame([("a", f"value number {i}", f"[X_{i:06x}]", 4, f"{i:04x}") for i in range(30_000)] + [("b", "é", "[X_1]", 1, "é")],
                                 "session_id string, value string, token string, n int, gram string")
    got = {r.session_id: r for r in M.session_filters(many).collect()}
    assert got["a"].bits == M.FILTER_MOST and len(got["a"].words) <= M.FILTER_MOST // 64
    assert got["b"].bits == 64 and got["b"].lengths == [1] and len(got["b"].words) == 1
    held = many.join(M.session_filters(many).select("session_id", "bits", "words"), "session_id")
    assert held.where(~M._may_hold(F.col("words"), F.col("bits"), F.col("gram"))).count() == 0


def test_sessions_of_few_values_take_no_detour(spark, monkeypatch):
    """Texts of small sessions are joined with their session's values; large sessions by runs of characters give the same."""
    vault = spark.createDataFrame([(str(s), f"[OSOBA_{s}{k:03x}]", "PERSON", f"Jan{k} Nowak{k * s}") for s in (1, 2) for k in range(20)] + [("3", "[OSOBA_abcd]", "PERSON", "")],
                                  "session_id string, token string, type string, value string")
    turns = spark.createDataFrame([(s, k, f"{k}: Jan{k} Nowak{k * 2} i Jan{k + 1} Nowak{k + 1}.") for s in (1, 2, 3, 4) for k in range(20)] + [(1, 99, None)], "conv_id long, turn int, text string")
    by_runs = sorted(map(tuple, M.remask_by_runs(turns, vault, "conv_id").collect()), key=repr)
    monkeypatch.setattr(M, "FEW_VALUES", 19)
    assert sorted(map(tuple, M.remask(turns, vault, "conv_id").collect()), key=repr) == by_runs
    monkeypatch.setattr(M, "FEW_VALUES", 64)
    monkeypatch.setattr(M, "candidate_grams", None)
    assert sorted(map(tuple, M.remask(turns, vault, "conv_id").collect()), key=repr) == by_runs
    assert any("[OSOBA_" in r[2] for r in by_runs if r[2])
