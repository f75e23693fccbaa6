"""Rule detection on short texts of each shape, overlap predicate, tie rules, rules of a caller."""

import random
import re

from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions import spans as S
from veilmark.operators import detect as D
from veilmark.operators.joins import hash_filter

CASES = [
    ("Faktura dla 987-654-32-10, kopia dla 9876543210!", [("NIP", 12, 25, "987-654-32-10"), ("NIP", 37, 47, "9876543210")]),
    ("kod 71040598765 w aktach", [("PESEL", 4, 15, "71040598765")]),
    ("+48 511 222 333 albo 511-222-333", [("PHONE_NUMBER", 0, 15, "+48 511 222 333"), ("PHONE_NUMBER", 21, 32, "511-222-333")]),
    ("wpłata: PL 77 1113 2222 3333 4444 5555 6666 dziś", [("IBAN_CODE", 8, 43, "PL 77 1113 2222 3333 4444 5555 6666")]),
    ("sygnatura 0000765432 tutaj", [("NIP", 10, 20, "0000765432")]),
    ("nr 246813579; dawny 24681357912345.", [("REGON", 3, 12, "246813579"), ("REGON", 20, 34, "24681357912345")]),
    ("(71040598765) na PL 77111322223333444455556666, 513-774-02-91",
     [("PESEL", 1, 12, "71040598765"), ("IBAN_CODE", 17, 46, "PL 77111322223333444455556666"), ("NIP", 48, 61, "513-774-02-91")]),
    ("x 511222333 y", [("REGON", 2, 11, "511222333")]),
    ("511 222 333 / ola@sklep.example.", [("PHONE_NUMBER", 0, 11, "511 222 333"), ("EMAIL_ADDRESS", 14, 31, "ola@sklep.example")]),
    ("ß246813579", [("PHONE_NUMBER", 1, 10, "246813579")]),
    ("a 511\u00a0222\u00a0333 b", [("PHONE_NUMBER", 2, 13, "511\u00a0222\u00a0333")]),
    ("🙂🙂 9876543210", [("NIP", 3, 13, "9876543210")]),
    ("host 10.20.30.40 i 300.20.30.40", [("IP_ADDRESS", 5, 16, "10.20.30.40")]),
]


def _found(spans):
    got = {}
    for r in spans.collect():
        got.setdefault(r.doc_id, []).append((r.type, r.start, r.end, r.text))
    return {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()}


def test_rule_fixtures(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = _found(D.detect(df))
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, []) == want, text
        for _, s, e, t in want:
            assert text[s:e] == t


def test_scores_and_sources(spark):
    df = spark.createDataFrame([(0, CASES[1][0])], "doc_id long, text string")
    (r,) = D.detect(df).collect()
    assert (r.score, r.source) == (0.85, "rule")


def test_digits_of_other_scripts_are_no_card(spark):
    eastern = "".join(chr(0x660 + int(c)) for c in "4539578763621486")
    df = spark.createDataFrame([(0, f"a@b.pl {eastern}"), (1, "4539 5787 6362 1486"), (2, None)], "doc_id long, text string")
    got = _found(D.detect(df))
    assert ("EMAIL_ADDRESS", 0, 6, "a@b.pl") in got[0] and not [x for x in got[0] if x[0] == "CREDIT_CARD"]
    assert got[1] == [("CREDIT_CARD", 0, 19, "4539 5787 6362 1486")] and 2 not in got


def test_rules_of_a_caller_need_no_digit(spark):
    rule = R.Rule("PERSON", r"\bOla Nowak\b", 0.9, "own")
    df = spark.createDataFrame([(0, "Umowa: Ola Nowak."), (1, "Umowa 1: Ola Nowak, ola@sklep.example")], "doc_id long, text string")
    assert _found(D.detect(df, rules=[rule])) == {
        0: [("PERSON", 7, 16, "Ola Nowak")], 1: [("PERSON", 9, 18, "Ola Nowak"), ("EMAIL_ADDRESS", 20, 37, "ola@sklep.example")]}


def test_gazetteer(spark):
    names = spark.createDataFrame([("Nowa Sól", "LOCATION"), ("Sól", "OTHER"), ("Ola", "PERSON"), ("Ola", "PERSON"), ("", "X"), (None, "X"), ("O'Hara", "PERSON")],
                                  "name string, type string")
    df = spark.createDataFrame([(0, "ola z NOWA SÓL, nowa, sól"), (1, "Olaf, Nowa-Sól i o'hara"), (2, None)], "doc_id long, text string")
    assert _found(D.gazetteer_spans(df, names)) == {
        0: [("PERSON", 0, 3, "ola"), ("LOCATION", 6, 14, "NOWA SÓL"), ("OTHER", 22, 25, "sól")],
        1: [("OTHER", 11, 14, "Sól"), ("PERSON", 17, 23, "o'hara")]}


def test_many_hits_in_one_text(spark):
    n = 3000
    text = " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(n))
    got = _found(D.detect(spark.createDataFrame([(0, text)], "doc_id long, text string"), rules=[]))[0]
    assert len(got) == n and all(text[s:e] == t for _, s, e, t in got)


def test_overlap_predicate(spark):
    rows = [((0, 8), (0, 8), True), ((3, 20), (5, 14), True), ((3, 9), (9, 20), False)]
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1], exp) for a, b, exp in rows],
                               "as_ int, ae int, bs int, be int, exp boolean")
    a = F.struct(F.col("as_").alias("start"), F.col("ae").alias("end"))
    b = F.struct(F.col("bs").alias("start"), F.col("be").alias("end"))
    for r in df.select(S.overlaps(a, b, 0.5).alias("got"), "exp").collect():
        assert r.got == r.exp


def test_overlap_pairs_binning_matches_all_pairs(spark):
    spans = spark.createDataFrame(
        [(1, "A", 0, 200, "x"), (1, "B", 150, 160, "y"), (1, "C", 199, 300, "z"), (1, "D", 300, 310, "w"),
         (2, "A", 5, 6, "q"), (2, "B", 5, 6, "q")],
        "doc_id long, type string, start int, end int, text string")
    got = {(r.doc_id, r.a_type, r.b_type) for r in D.span_overlap_pairs(spans, bin_size=16).collect()}
    assert got == {(1, "A", "B"), (1, "A", "C"), (2, "A", "B")}


def test_whole_text_is_searched(spark):
    text = ("lorem ipsum " * 5000) + "kontakt ola@sklep.example"
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    (r,) = D.detect(df).collect()
    assert r.text == "ola@sklep.example" and text[r.start:r.end] == r.text


def test_gazetteer_names_of_any_length_and_other_endings(spark):
    texts = spark.createDataFrame([
        (1, "Rada Nadzorcza Spółki Handlu Zbożem i Mąką Wschód 1 radzi"), (2, "o projekcie Apollem i Apollo nic"), (3, "z Apollem, z APOLLEM"),
        (4, "Nowy Apoll i nowym Apollami"), (5, "Apolliniusz"), (6, "Jan Kowalskim mówi"), (7, "Jan Kowalski i Jana Kowalskiego"), (8, "abc abcd abcde"), (9, None), (10, "Ewie"),
    ], "doc_id long, text string")
    names = spark.createDataFrame([("Rada Nadzorcza Spółki Handlu Zbożem i Mąką Wschód 1", "ORG"), ("Apollo", "PROJECT"), ("Jan Kowalski", "PERSON"), ("abc", "X"), ("Ewa", "PERSON"), ("", "X")],
                                  "name string, type string")
    literal = {(r.doc_id, r.text) for r in D.gazetteer_spans(texts, names).collect()}
    assert literal == {(1, "Rada Nadzorcza Spółki Handlu Zbożem i Mąką Wschód 1"), (2, "Apollo"), (7, "Jan Kowalski"), (8, "abc")}
    found = {(r.doc_id, r.text, r.start) for r in D.gazetteer_spans(texts, names, declined=True).collect()}
    # the fallback only where the text has no literal hit; up to three letters after all but the last one
    assert {x[:2] for x in found} - literal == {(3, "Apollem"), (3, "APOLLEM"), (4, "Apoll"), (4, "Apollami"), (6, "Jan Kowalskim")}
    assert {x[2] for x in found if x[0] == 3} == {2, 13}


def _by_hand(text, names, declined):
    """Hits (start, text, type) of single names in a text, by plain loops; no overlap rule."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+|#", text)]
    hits = set()
    for name, kind in names:
        n, low = len(re.findall(r"[^\W_]+|#", name)), name.lower()
        runs = [(words[i][1], text[words[i][1]:words[i + n - 1][2]]) for i in range(len(words) - n + 1)]
        got = {(s, r, kind) for s, r in runs if r.lower() == low}
        core = low[:-1] if len(low) > 4 else low
        if declined and not got and len(low) > 3:
            got = {(s, r, kind) for s, r in runs if re.fullmatch(re.escape(core) + "[a-ząęółńśćźż]{0,3}", r.lower())
                   and (n == 1 or r.lower().split()[0] == low.split()[0])}
        hits |= got
    return hits


def test_gazetteer_equals_plain_loops(spark):
    """Names of one stem, names of one first word, texts of few and of many words."""
    rng = random.Random(5)
    names = [("Anna", "P"), ("Annab", "P"), ("Annac", "P"), ("ab", "X"), ("Nowa Wieś", "L"), ("Nowa Wieść", "L"), ("Nowa Wieśy", "L"), ("Nowa Wola Dolna", "L"), ("Nowa", "Q")]
    vocabulary = ["anna", "ANNAB", "annaba", "annacie", "anne", "ab", "nowa", "Nowa", "wieś", "wieśami", "wieśc", "wieśabcd", "wola", "dolna", "dolnej", "dolnaj", "i", "na", "7"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 8, 9, 20, 60] * 4 + [D.FEW_WORDS, D.FEW_WORDS + 1, 900])]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    for each in ([n] for n in names):
        listed = spark.createDataFrame(each, "name string, type string")
        for declined in (False, True):
            got = {(r.doc_id, r.start, r.text, r.type) for r in D.gazetteer_spans(texts, listed, declined=declined).collect()}
            assert got == {(k, *hit) for k, t in rows for hit in _by_hand(t, each, declined)}, (each, declined)
    family = names[:3]
    listed = spark.createDataFrame(family, "name string, type string")
    got = {(r.doc_id, r.start, r.text, r.type) for r in D.gazetteer_spans(texts, listed, declined=True).collect()}
    assert got == {(k, *hit) for k, t in rows for hit in _by_hand(t, family, True)}
    none = spark.createDataFrame([], "name string, type string")
    assert D.gazetteer_spans(texts, none, declined=True).count() == 0


def test_only_names_leave_a_text(spark):
    """Forty names of one first word: what goes to the names is one run of words a text, not each word, nor forty rows."""
    texts = spark.createDataFrame([(k, f"Umowa {k} podpisuje rada {k} z gminy {k % 7} oraz inni {k}") for k in range(400)], "_key long, _text string")
    names = spark.createDataFrame([(f"Rada {k}", "ORG") for k in range(40)], "name string, type string")
    forms, firsts, lengths = D.name_forms(names, True)
    may = D.name_candidates(texts, hash_filter(forms.select("_h").unionByName(firsts), "_h"), lengths, True)
    assert {r.text.lower() for r in may.where("_cut = -1").collect()} >= {f"rada {k}" for k in range(40)}
    assert may.count() < 120


def test_offsets_of_pieces(spark):
    """Matches over line breaks, a long tail without any."""
    text = "a1\r\n22 🙂\n333" + " x" * 20000
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = df.select(S.extract_spans(F.col("text"), S.java_pattern("[0-9]+"), "N", score=1.0, source="rule").alias("s")).first().s
    assert [(s.start, s.end, s.text) for s in got] == [(1, 2, "1"), (4, 6, "22"), (9, 12, "333")]


def test_hashes_and_constants_do_not_travel(spark):
    """Between stages go a hit's place, words and type: no hash of it, no score, no source."""
    texts = spark.createDataFrame([(k, f"Umowa {k} podpisuje rada {k % 40} oraz inni {k}") for k in range(400)], "doc_id long, text string")
    names = spark.createDataFrame([(f"Rada {k}", "ORG") for k in range(40)], "name string, type string")
    forms, firsts, lengths = D.name_forms(names, False)
    t = texts.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    assert D.name_candidates(t, hash_filter(forms.select("_h").unionByName(firsts), "_h"), lengths, False).columns == ["_key", "start", "text", "_cut", "_n"]
    for declined in (False, True):
        got = D.gazetteer_spans(texts, names, declined=declined)
        assert {(r.doc_id, r.text, r.score, r.source) for r in got.collect()} == {(k, f"rada {k % 40}", R.DEEP_SCORE, "gazetteer") for k in range(400)}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression" if declined else "Aggregate"):].split("\n", 1)[1]
        assert "gazetteer" in plan and "gazetteer" not in below, declined


def test_matches_are_placed_by_one_walk(spark):
    """Offsets from marked texts: many, empty, adjacent and no matches, texts that hold the marks themselves, wide characters, null."""
    import re

    texts = ["", "a1b22c333", "x", "1", "😀7ż88", f"a1{S.MATCH_START}2{S.MATCH_END}33", S.MATCH_END + "5", "9" * 40, " ".join(map(str, range(60))), None, "12ab34\n56"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern in (r"[0-9]+", r"[0-9]", r"[0-9]*b?", r"b*(?=[0-9])"):
        got = [r[0] for r in df.select(S.extract_spans(F.col("text"), pattern, "N", score=1.0, source="s", strip=False)).collect()]
        for t, spans in zip(texts, got, strict=True):
            if t is not None and ("*" not in pattern or not {S.MATCH_START, S.MATCH_END, "\U0001f600"} & set(t)):
                # an empty match right after another one is Python's alone
                assert [(s.text, s.start, s.end) for s in spans if s.text] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t) if m.group()], (t, pattern)
    plan = df.select(S.extract_spans(F.col("text"), r"[0-9]+", "N", score=1.0, source="s"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plan


def test_a_stated_first_character_changes_no_match(spark):
    """Rules with and without ``begins`` on random digits, marks and spaces."""
    import dataclasses
    import random

    rng = random.Random(3)
    pieces = ["600", "100", "12", "1234", "0000", "48", "+48", "PL", "pl", "0048", "987", "54321", "4111111111111111", "123456789", "71040598765", "10.0.0.1", "\u0663", "\u0131k", "(", "\n"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", "", " ", " ", "-", "x", " \u2003"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["+48 600 100 200", "0048600100200", "PL 12 1234 1234 1234 1234 1234 1234", "x pl12123412341234123412341234", "(  600-100-200)", "a 12 1234 1234 1234 1234 1234 1234"]
    rules = [*R.default_base_recognizers(), *R.EXTRA_RECOGNIZERS, *R.business_rules()]
    assert sum(r.begins is not None for r in rules) >= 9
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = df.select(S.extract_rules(F.col("text"), rules).alias("a"), S.extract_rules(F.col("text"), [dataclasses.replace(r, begins=None) for r in rules]).alias("b")).collect()
    assert all(p.a == p.b for p in pairs) and sum(len(p.a) for p in pairs) > 300
