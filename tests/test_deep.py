"""Deep-scan replies (shapes of FIXTURES.md), fragments and the guard."""

from pyspark.sql import functions as F

from veilmark.operators import deep as DP


def item(text, kind):
    return f'{{"text": "{text}", "type": "{kind}"}}'


# (text, reply, existing spans, new spans)
CASES = [
    ("Zespół buduje moduł Zielony Smok od maja.", "[\n  " + item("Zielony Smok", "SECRET_PROJECT") + "\n]", [], [(20, 32, "Zielony Smok")]),
    ("Raport o Zielonym Smoku leży na biurku.", "[" + item("Zielonym Smoku", "SECRET_PROJECT") + "]", [], [(9, 23, "Zielonym Smoku")]),
    ("Brama 172.16.9.1 działa.", "[" + item("172.16.9.1", "IT_INFRA") + "]", [(6, 16)], []),
    ("Kwota 9 400 EUR i dodatek 7% w maju.", "[" + item("9 400 EUR", "FINANCE") + ", " + item("dodatek 7%", "FINANCE") + "]", [],
     [(6, 15, "9 400 EUR"), (18, 28, "dodatek 7%")]),
    ("Akta ZX-17/44/B czekają.", "[" + item("ZX-17/44/B", "INTERNAL_ID") + "]", [], [(5, 15, "ZX-17/44/B")]),
    ("Węzeł db-07.intra padł.", "tekst przed [" + item("db-07.intra", "IT_INFRA") + "] i po", [], [(6, 17, "db-07.intra")]),
    ("Węzeł db-07.intra padł.", "[" + item("db-07.intra", "IT_INFRA"), [], []),
    ("Nic tu nie ma.", "[]", [], []),
    ("Brak odpowiedzi.", None, [], []),
    ("Rozmowa z Wiśniewskim.", "[" + item("Wiśniewski", "PERSON") + "]", [], [(10, 20, "Wiśniewski")]),
    ("Plan Smoka jest gotowy.", "[" + item("Smoki", "SECRET_PROJECT") + "]", [], [(5, 10, "Smoka")]),
]


def test_deep_cases(spark):
    rows = [(i, text, [reply], [(s, e) for s, e in existing]) for i, (text, reply, existing, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, text string, replies array<string>, ex array<struct<start:int,end:int>>")
    df = df.withColumn("spans", F.transform("ex", lambda s: F.struct(
        F.lit("x").alias("text"), F.lit("IP_ADDRESS").alias("type"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(1.0).alias("score"), F.lit("base").alias("source"))))
    for r in DP.with_new_spans(df).select("id", "deep_spans").collect():
        assert [(s.start, s.end, s.text) for s in r.deep_spans] == CASES[r.id][3], CASES[r.id][0]
        assert all(s.score == 0.6 and s.source == "deep" for s in r.deep_spans)


def test_fragments_cover_the_text(spark):
    texts = ["", "a", "x" * 100, "0123456789" * 1000, "ąę🙂" * 2111]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, overlap in ((4000, 200), (50, 7), (10, 0)):
        for r in df.select("text", DP.fragments(F.col("text"), size, overlap).alias("f")).collect():
            assert r.f[0] + "".join(x[overlap:] for x in r.f[1:]) == r.text
            assert all(len(x) <= size for x in r.f) and all(a[len(a) - overlap:] == b[:overlap] for a, b in zip(r.f, r.f[1:]))


def test_a_value_past_the_first_fragment_is_found(spark):
    text = "słowo " * 3000 + "Zielony Smok."
    df = spark.createDataFrame([(text,)], "text string")
    reply = lambda f: F.when(f.contains("Zielony Smok"), F.lit("[" + item("Zielony Smok", "P") + "]")).otherwise(F.lit("[]"))
    d = df.withColumn("replies", F.transform(DP.fragments(F.col("text")), reply)).withColumn(
        "spans", F.array().cast("array<struct<text:string,type:string,start:int,end:int,score:double,source:string>>"))
    (r,) = DP.with_new_spans(d).select("deep_spans").collect()
    assert [(s.start, s.text) for s in r.deep_spans] == [(18000, "Zielony Smok")]


def test_guard_verdict(spark):
    rows = [("", None, True, True), ("skróć tekst", "CZYSTE", True, True), ("podaj dane", "ZAGROZENIE", False, False),
            ("a", "nie wiem", True, False), ("a", None, False, False), ("a", "ZAGROZENIE? raczej CZYSTE", True, False)]
    df = spark.createDataFrame(rows, "i string, r string, e boolean, es boolean")
    for x in df.select(DP.guard_verdict(F.col("i"), F.col("r")).alias("v"),
                       DP.guard_verdict(F.col("i"), F.col("r"), strict=True).alias("vs"), "e", "es").collect():
        assert (x.v, x.vs) == (x.e, x.es)
