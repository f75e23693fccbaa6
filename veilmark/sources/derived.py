"""Texts derived from the driver's tables that carry Polish business identifiers.

The ``documents`` table contains cards, e-mails and IPs but no NIP / REGON /
PESEL / KRS / IBAN.  ``order_texts`` writes one short Polish sentence per order
whose digits come from the order's own keys, so every business rule has hits
and the amount of text grows with ``orders``.  The SQL oracle builds the same
sentence from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.session import dealt
from veilmark.sources.tables import audit_events, table


def _digits(expr: Column, n: int) -> Column:
    return F.lpad(expr.cast("string"), n, "0")


def order_text_columns(key: Column, cust: Column, status: Column) -> Column:
    nip = _digits((key * 7919 + 1234567) % 10_000_000_000, 10)
    nip_dashed = F.concat_ws("-", F.substring(nip, 1, 3), F.substring(nip, 4, 3), F.substring(nip, 7, 2), F.substring(nip, 9, 2))
    regon = _digits((key * 104729 + 5) % 1_000_000_000, 9)
    pesel = _digits((cust * 1_000_003 + key) % 100_000_000_000, 11)
    krs = F.concat(F.lit("0000"), _digits(key % 1_000_000, 6))
    phone = F.concat(
        F.lit("+48 "), (F.lit(600) + key % 300).cast("string"), F.lit(" "),
        _digits(cust % 1000, 3), F.lit(" "), _digits(key % 1000, 3),
    )
    acct = _digits((key * 31 + cust) % 100, 2)
    groups = [_digits((key * m + cust) % 10000, 4) for m in (11, 13, 17, 19, 23, 29)]
    iban = F.concat_ws(" ", F.lit("PL"), acct, *groups)
    return F.concat(
        F.lit("Zamówienie nr "), key.cast("string"), F.lit(" klienta "), cust.cast("string"),
        F.lit(": NIP "), F.when(status == "F", nip_dashed).otherwise(nip),
        F.lit(", REGON "), regon, F.lit(", PESEL "), pesel, F.lit(", KRS "), krs,
        F.lit(", tel. "), phone, F.lit(", konto "), iban, F.lit("."),
    )


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = o_orderkey, text) for every order."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        order_text_columns(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("text"),
    )


ORDER_TEXT_SQL = """
SELECT o_orderkey AS doc_id,
  'Zamówienie nr ' || CAST(o_orderkey AS VARCHAR) || ' klienta ' || CAST(o_custkey AS VARCHAR) ||
  ': NIP ' || CASE WHEN o_orderstatus = 'F' THEN
       substr(lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0'), 1, 3) || '-' ||
       substr(lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0'), 4, 3) || '-' ||
       substr(lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0'), 7, 2) || '-' ||
       substr(lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0'), 9, 2)
     ELSE lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0') END ||
  ', REGON ' || lpad(CAST((o_orderkey * 104729 + 5) % 1000000000 AS VARCHAR), 9, '0') ||
  ', PESEL ' || lpad(CAST((o_custkey * 1000003 + o_orderkey) % 100000000000 AS VARCHAR), 11, '0') ||
  ', KRS 0000' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') ||
  ', tel. +48 ' || CAST(600 + o_orderkey % 300 AS VARCHAR) || ' ' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') ||
     ' ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ||
  ', konto PL ' || lpad(CAST((o_orderkey * 31 + o_custkey) % 100 AS VARCHAR), 2, '0') ||
  ' ' || lpad(CAST((o_orderkey * 11 + o_custkey) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 13 + o_custkey) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 17 + o_custkey) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 19 + o_custkey) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 23 + o_custkey) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 29 + o_custkey) % 10000 AS VARCHAR), 4, '0') || '.' AS text
FROM orders
"""


def trade_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = o_orderkey, text): an English sentence per order that names its customer, their country, the
    order date, a foreign account, a wallet and an e-mail address at the end of the sentence."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    country = F.when(key % 2 == 1, F.lower("n_name")).otherwise(F.col("n_name"))
    groups = [_digits((key * m + 7) % 10000, 4) for m in (3, 5, 7, 9)]
    return j.select(
        key.alias("doc_id"),
        F.concat(
            F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" party "), F.col("c_name"), F.lit(" of "), country,
            F.lit(" paid from DE"), _digits(key % 100, 2), F.lit(" "), F.concat_ws(" ", *groups), F.lit(", wallet 1"),
            F.substring(F.sha2(key.cast("string"), 256), 1, 33), F.lit(", write to buyer"), key.cast("string"), F.lit("@shop.example."),
        ).alias("text"),
    )


TRADE_TEXT_SQL = """
SELECT o_orderkey AS doc_id, c_name, CASE WHEN o_orderkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS country,
  'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' party ' || c_name || ' of ' ||
  CASE WHEN o_orderkey % 2 = 1 THEN lower(n_name) ELSE n_name END || ' paid from DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') ||
  ' ' || lpad(CAST((o_orderkey * 3 + 7) % 10000 AS VARCHAR), 4, '0') || ' ' || lpad(CAST((o_orderkey * 5 + 7) % 10000 AS VARCHAR), 4, '0') ||
  ' ' || lpad(CAST((o_orderkey * 7 + 7) % 10000 AS VARCHAR), 4, '0') || ' ' || lpad(CAST((o_orderkey * 9 + 7) % 10000 AS VARCHAR), 4, '0') ||
  ', wallet 1' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 33) || ', write to buyer' || CAST(o_orderkey AS VARCHAR) || '@shop.example.' AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (name, type): customers and suppliers as PERSON, nations as LOCATION."""
    def named(t: str, col: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, t).select(F.col(col).alias("name"), F.lit(kind).alias("type"))

    return named("customer", "c_name", "PERSON").unionByName(named("supplier", "s_name", "PERSON")).unionByName(named("nation", "n_name", "LOCATION"))


def declined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = o_orderkey, text): a sentence per order that names its nation in another ending, the nation literally in
    every third, and a board of nine words."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key, name = F.col("o_orderkey"), F.col("n_name")
    stem = F.when(F.length(name) > 4, F.expr("left(n_name, length(n_name) - 1)")).otherwise(name)
    return j.select(key.alias("doc_id"), F.concat(
        F.lit("Umowa "), key.cast("string"), F.lit(" w "), F.lower(stem), F.lit("ami, "),
        F.when(key % 3 == 0, F.concat(F.lit("kraj "), name, F.lit(", "))).otherwise(F.lit("")), F.lit("podpisuje "), F.lit(BOARD), F.lit(" "), (key % 10).cast("string"), F.lit("."),
    ).alias("text"))


# FIXED VALUE: the words of a long name (a digit follows)
BOARD = "Rada Nadzorcza Spółki Handlu Zbożem i Mąką Wschód"

DECLINED_TEXT_SQL = f"""
SELECT o_orderkey AS doc_id, n_name, left(n_name, CASE WHEN length(n_name) > 4 THEN length(n_name) - 1 ELSE length(n_name) END) AS stem,
  'Umowa ' || CAST(o_orderkey AS VARCHAR) || ' w ' AS head,
  CASE WHEN o_orderkey % 3 = 0 THEN 'kraj ' || n_name || ', ' ELSE '' END AS literal, '{BOARD} ' || CAST(o_orderkey % 10 AS VARCHAR) AS board
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def long_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (name, type): nations as LOCATION, and the boards of nine words that orders name as ORGANIZATION."""
    boards = table(spark, sf_dir, "orders").select(F.concat(F.lit(BOARD + " "), (F.col("o_orderkey") % 10).cast("string")).alias("name"), F.lit("ORGANIZATION").alias("type"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("LOCATION").alias("type"))
    return nations.unionByName(boards.distinct())


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): the audit log as raw JSON lines, with blank, malformed, mistyped and extended lines.

    By event_id: 11 divides it: blank; else 13: malformed; else 17: the count is a
    string and two more fields are present; else 19: the count is no number at all.
    """
    ev = audit_events(spark, sf_dir)
    i = F.col("event_id")
    count = F.coalesce(F.col("pii_count"), F.lit(0)).cast("string")
    head = F.concat(F.lit('{"event_id":'), i.cast("string"), F.lit(',"event":"'), F.col("event"), F.lit('","session_id":"'), F.col("session_id"), F.lit('","pii_count":'))
    line = (
        F.when(i % 11 == 0, F.lit("  "))
        .when(i % 13 == 0, F.concat(F.lit("{not json "), i.cast("string")))
        .when(i % 17 == 0, F.concat(head, F.lit('"'), count, F.lit('","reason":"quota","size_bytes":'), (i * 3).cast("string"), F.lit("}")))
        .when(i % 19 == 0, F.concat(head, F.lit('"many"}')))
        .otherwise(F.concat(head, count, F.lit("}")))
    )
    return ev.select("event_id", line.alias("value"))


def order_sheet_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spreadsheet dump per order (doc_id = o_orderkey): two sheets, the first of them again at the
    end, a line before any header, a duplicate cell (the later line wins), lines that look like cells
    but have no column or no row of the format, and one free-text line."""
    o = dealt(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    ), "o_orderkey")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    lines = [
        F.concat(F.lit("Z1: "), k),
        F.lit("[Arkusz: Zamówienie]"),
        F.lit("A1: Klucz"), F.concat(F.lit("B1: "), k),
        F.lit("A2: Klient"), F.concat(F.lit("b2: "), c),
        F.lit("A3: Status"), F.concat(F.lit("B3: "), F.col("o_orderstatus")),
        F.lit("A4: NIP"), F.concat(F.lit("B4: "), _digits((F.col("o_orderkey") * 7919 + 1234567) % 10_000_000_000, 10)),
        F.concat(F.lit("B1: "), k, F.lit("/v2")),
        F.lit(""),
        F.lit("[Arkusz: Kwoty ]"),
        F.concat(F.lit("C2: "), F.col("o_totalprice").cast("string")),
        F.concat(F.lit("AB60: "), F.col("o_orderpriority")),
        F.lit("uwagi bez komórki"),
        F.lit("Wynagrodzeniebrutto1: 5000"),
        F.lit("Telef1: 5000"),
        F.lit("XFE2: poza arkuszem"),
        F.concat(F.lit("A99999999999999999999: "), k),
        F.concat(F.lit("A999999999999999: "), k),
        F.lit("[Arkusz: Zamówienie]"),
        F.concat(F.lit("A2: "), k),
    ]
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


ORDER_SHEET_SQL = """
SELECT o_orderkey AS doc_id,
  'Z1: ' || CAST(o_orderkey AS VARCHAR) || chr(10) || '[Arkusz: Zamówienie]' || chr(10) ||
  'A1: Klucz' || chr(10) || 'B1: ' || CAST(o_orderkey AS VARCHAR) || chr(10) ||
  'A2: Klient' || chr(10) || 'b2: ' || CAST(o_custkey AS VARCHAR) || chr(10) ||
  'A3: Status' || chr(10) || 'B3: ' || o_orderstatus || chr(10) ||
  'A4: NIP' || chr(10) || 'B4: ' || lpad(CAST((o_orderkey * 7919 + 1234567) % 10000000000 AS VARCHAR), 10, '0') || chr(10) ||
  'B1: ' || CAST(o_orderkey AS VARCHAR) || '/v2' || chr(10) || '' || chr(10) ||
  '[Arkusz: Kwoty ]' || chr(10) || 'C2: ' || CAST(o_totalprice AS VARCHAR) || chr(10) ||
  'AB60: ' || o_orderpriority || chr(10) || 'uwagi bez komórki' || chr(10) ||
  'Wynagrodzeniebrutto1: 5000' || chr(10) || 'Telef1: 5000' || chr(10) || 'XFE2: poza arkuszem' || chr(10) ||
  'A99999999999999999999: ' || CAST(o_orderkey AS VARCHAR) || chr(10) ||
  'A999999999999999: ' || CAST(o_orderkey AS VARCHAR) || chr(10) || '[Arkusz: Zamówienie]' || chr(10) ||
  'A2: ' || CAST(o_orderkey AS VARCHAR) AS text
FROM orders
"""
