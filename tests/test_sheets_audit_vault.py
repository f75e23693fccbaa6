"""Sheets, audit JSONL, vault, retention, sanitisers, ingest."""

import datetime as dt
import io
import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from veilmark.functions import text as TX
from veilmark.operators import audit as AU
from veilmark.operators import sheets as SH
from veilmark.operators import vault as VT
from veilmark.sources import audit_json as AJ
from veilmark.sources import binary as BIN

DUMP = "[Arkusz: Lista]\nA1: Osoba\nB1: Numer\nA2: Ola Nowak\nB2: 71040598765"


def _scratch():
    return tempfile.mkdtemp(prefix="veilmark-test-", dir="/tmp")


def test_col_index(spark):
    df = spark.createDataFrame([("A",), ("Z",), ("AB",), ("zz",), ("XFD",), ("XFE",), ("Telef",), ("Wynagrodzeniebrutto",), ("",)], "c string")
    got = [r.i for r in df.select(SH.col_index(F.col("c")).alias("i")).collect()]
    assert got == [1, 26, 28, 702, 16384, None, None, None, None]
    back = [r.l for r in spark.range(1, 800).select(SH.col_letters(F.col("id")).alias("l")).collect()]
    assert back[0] == "A" and back[27] == "AB" and back[701] == "ZZ" and back[702] == "AAA"


def test_sheet_cells_and_grid(spark):
    df = spark.createDataFrame([(1, DUMP), (2, "x: y\nC3: a\nC3: b\n[Arkusz: S2]\nA1: q")], "doc_id long, text string")
    cells = {(r.doc_id, r.sheet, r.row, r.col): r.value for r in SH.sheet_cells(df).collect()}
    assert cells[(1, "Lista", 2, 2)] == "71040598765"
    assert cells[(2, "Arkusz1", 3, 3)] == "b"
    rows = SH.sheet_grid(SH.sheet_cells(df)).collect()
    grid = {(r.doc_id, r.sheet, r.row): r.cells for r in rows}
    assert len(grid) == len(rows) == 2 + 3 + 1
    assert grid[(1, "Lista", 1)] == "Osoba\tNumer"
    assert grid[(2, "Arkusz1", 1)] == "\t\t" and grid[(2, "Arkusz1", 3)] == "\t\tb"


def test_rows_beyond_the_format_are_dropped(spark):
    """A line with a huge row number neither ends the job nor fills the grid with empty rows."""
    df = spark.createDataFrame([(1, "A999999999999999: y\nB2: x\nA1048577: z"), (2, "A99999999: y"), (3, "A1048576: last")], "doc_id long, text string")
    cells = SH.sheet_cells(df)
    assert sorted((r.doc_id, r.row, r.col, r.value) for r in cells.collect()) == [(1, 2, 2, "x"), (3, 1048576, 1, "last")]
    grid = SH.sheet_grid(cells.where("doc_id < 3")).collect()
    assert [(r.doc_id, r.row, r.cells) for r in sorted(grid, key=lambda r: r.row)] == [(1, 1, "\t"), (1, 2, "\tx")]
    assert SH.sheet_grid(cells).count() == 2 + 1048576


def _rebuild_model(text):
    import re
    pat = re.compile(r"^([a-zA-Z]+)(\d+):\s*(.*)$")
    sheet, max_row, out = "Wynik", 1, {}
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if line.startswith("[Arkusz:") and line.endswith("]"):
            sheet = (line[8:-1].strip() or "Sheet1")[:31]
            max_row = 1
            continue
        m = pat.match(line)
        if m:
            col = 0
            for ch in m.group(1).upper():
                col = col * 26 + ord(ch) - 64
            r = int(m.group(2))
            if r < 10**18:
                max_row = max(max_row, r)
            if len(m.group(1)) <= 3 and col <= 16384 and 1 <= r <= 1048576:
                out[(sheet, r, col)] = m.group(3)
        else:
            max_row += 1
            if max_row <= 1048576:
                out[(sheet, max_row, 1)] = line
    return out


def _random_dumps():
    import random

    rng = random.Random(7)
    lines = ["free", "A{}: x", "zz{}: y", "[Arkusz: P]", "[Arkusz: ]", "  ", "Telef{}: z", "B{}:", "[Arkusz: Q]"]
    return ["\n".join(rng.choice(lines).format(rng.randint(0, 40)) for _ in range(rng.randint(0, 60))) for _ in range(30)]


def test_sections_keep_their_order(spark):
    df = spark.createDataFrame([(1, "A1: top\n[Arkusz: X]\nA1: a\nB3: b\n[Arkusz: Y]\nA1: c\n[Arkusz: X]\nA2: d\nTelef7: no\n[Arkusz: E]\nfree")], "doc_id long, text string")
    cells = sorted((r.section, r.sheet, r.row, r.col, r.value) for r in SH.sheet_cells(df).collect())
    assert cells == [(0, "Arkusz1", 1, 1, "top"), (1, "X", 1, 1, "a"), (1, "X", 3, 2, "b"), (2, "Y", 1, 1, "c"), (3, "X", 2, 1, "d")]
    grid = sorted((r.section, r.row, r.cells) for r in SH.sheet_grid(SH.sheet_cells(df)).collect())
    assert grid == [(0, 1, "top"), (1, 1, "a\t"), (1, 2, "\t"), (1, 3, "\tb"), (2, 1, "c"), (3, 1, ""), (3, 2, "d")]
    assert {r.row for r in SH.sheet_grid(SH.sheet_cells(df).where("section = 1"), row_cap=2).collect()} == {1, 2}


def test_a_long_sheet_gives_all_rows(spark):
    df = spark.createDataFrame([(1, "A1: a\nA9000: z")], "doc_id long, text string")
    rows = {r.row: r.cells for r in SH.sheet_grid(SH.sheet_cells(df)).collect()}
    assert len(rows) == 9000 and rows[1] == "a" and rows[9000] == "z" and rows[4500] == ""


def test_fallback_matches_model(spark):
    texts = ["plain\nA5: x\nmore\n[Arkusz: ]\nfree\nB2: y\n", DUMP + "\nnotes here\nC9: z\ntail", "only text\nand more",
             "", "Telef1: 5\nfree\nA0: zero\nXFE9: far\nfree\nA99999999999999999999: big\nend", "[Arkusz: X]\nA1: a\n[Arkusz: Y]\nb\n[Arkusz: X]\nc",
             "A1048576: last\nbelow\n[Arkusz: Z]\nfree"] + _random_dumps()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in SH.sheet_cells(df, fallback=True).collect():
        got.setdefault(r.doc_id, {})[(r.sheet, r.row, r.col)] = r.value
    for i, t in enumerate(texts):
        assert got.get(i, {}) == _rebuild_model(t)


def test_audit_jsonl_scan_count_page(spark):
    d = _scratch()
    lines = [json.dumps({"timestamp": f"2026-01-0{i}T10:00:00+00:00", "event": f"e{i}", "data_left_boundary": False,
                         "event_id": i}) for i in range(1, 4)]
    with open(os.path.join(d, "audit.jsonl"), "w") as f:
        f.write(lines[0] + "\n\n{not json\n" + lines[1] + "\n   \n" + lines[2] + "\n")
    ev = AJ.read_audit(spark, d)
    assert ev.count() == 3
    assert AJ.count_lines(spark, d) == 4
    page = [r.event for r in AU.audit_page(ev, 0, 2).collect()]
    assert page == ["e3", "e2"]
    for bad in ({"limit": 1001}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            AU.audit_page(ev, **bad)
    assert [r.corrupt for r in AJ.read_corrupt(spark, d).collect()] == ["{not json"]


def test_audit_fields_of_any_kind(spark):
    lines = ['{"event":"a","pii_count":"3","pii_types":["X","Y"],"reason":"quota","details":{"k":[1]}}', '{"event":"b","pii_count":"many","data_left_boundary":"true"}',
             '[1]', '"text"', '7', '{"event":5}', "{}", "null", '{"event":"c","pii_types":"no list"}']
    df = AJ.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).cache()
    ok = {r.event: r for r in df.where("corrupt IS NULL").collect()}
    assert df.where("corrupt IS NULL").count() == 5 and df.count() == 9
    assert ok["a"].pii_count == 3 and ok["a"].pii_types == ["X", "Y"] and ok["a"].extra == {"reason": "quota", "details": '{"k":[1]}'}
    assert ok["b"].pii_count is None and ok["b"].extra == {"pii_count": "many"} and ok["b"].data_left_boundary is True
    assert "5" in ok and None in ok
    assert sorted(r.corrupt for r in df.where("corrupt IS NOT NULL").collect()) == sorted(['[1]', '"text"', "7", "null"])


def test_csv_lines_are_numbered_newest_first(spark):
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i // 3), f"e{i}") for i in range(500)] + [(900, None, "none")]
    ev = spark.createDataFrame(rows, "event_id long, timestamp timestamp, event string").repartition(5)
    got = [r for r in AU.audit_csv_lines(ev, columns=["timestamp", "event"]).orderBy("line_no").collect()]
    assert [r.line_no for r in got] == list(range(502)) and got[0].line == "timestamp,event"
    assert [r.event_id for r in got[1:]] == [*range(499, -1, -1), 900]


def test_dashboard_of_nothing_is_zero(spark):
    ev = spark.createDataFrame([], "event string, pii_count long")
    assert tuple(AU.dashboard_stats(ev).first()) == (0, 0, 0, 0, 0, 0)


def test_csv_quoting(spark):
    df = spark.createDataFrame([('a,b', 'say "hi"', "x")], "a string, b string, c string")
    (r,) = df.select(F.concat_ws(",", *[AU._csv_field(F.col(c)) for c in "abc"]).alias("l")).collect()
    assert r.l == '"a,b","say ""hi""",x'


def test_vault_roundtrip_wrong_key_and_erase(spark):
    v = spark.createDataFrame([("session-1", "[OSOBA_aaaa]", "Ola Nowak"), ("session-1", "[PESEL_bbbb]", "71040598765"),
                               ("session-2", "[OSOBA_cccc]", "Anna")], "session_id string, token string, value string")
    sealed = VT.seal(v, "secret")
    ok = VT.session_entries(VT.open_vault(sealed, "secret")).collect()
    assert {(r.token, r.value) for r in ok if r.session_id == "session-1"} == {("[OSOBA_aaaa]", "Ola Nowak"), ("[PESEL_bbbb]", "71040598765")}
    assert {r.session_id: r.n_tokens for r in VT.session_sizes(v).collect()} == {"session-1": 2, "session-2": 1}
    assert VT.session_entries(VT.open_vault(sealed, "wrong")).count() == 0
    erased = VT.erase(v, spark.createDataFrame([("session-1",)], "session_id string"))
    assert [r.session_id for r in erased.collect()] == ["session-2"]


def test_upsert_and_ttl(spark):
    now = dt.datetime(2026, 4, 23, 12, 0, 0)
    v = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, ver int, val string")
    assert {r.key: r.val for r in VT.upsert_latest(v, "key", "ver").collect()} == {"k": "new", "j": "only"}
    files = spark.createDataFrame([("old", now - dt.timedelta(hours=2)), ("new", now), ("none", None)],
                                  "key string, uploaded_at timestamp")
    kept, removed = VT.ttl_split(files, F.col("uploaded_at"), "2026-04-23 12:00:00", 3600)
    assert sorted(r.key for r in kept.collect()) == ["new", "none"] and [r.key for r in removed.collect()] == ["old"]


def test_sanitizers(spark):
    df = spark.createDataFrame([("plan_na_maj.docx",), ("a.b.XLSX",), ("bez_rozszerzenia",)], "f string")
    assert [r.s for r in df.select(TX.sanitize_filename(F.col("f")).alias("s")).collect()] == ["***.docx", "***.xlsx", "***"]
    e = spark.createDataFrame([("zapis 71040598765 odrzucony, autor ola@sklep.example",), ("x" * 500,)], "e string")
    a, b = [r.s for r in e.select(TX.sanitize_error(F.col("e"), 200).alias("s")).collect()]
    assert "[PESEL]" in a and "[EMAIL]" in a and "71040598765" not in a and "ola@sklep.example" not in a
    assert len(b) < 250 and b.endswith("[truncated]")
    assert [len(r.s) for r in e.select(TX.sanitize_error(F.col("e")).alias("s")).collect()][1] == 500


def _docx_bytes():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = (f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ola Nowak, numer 71040598765, Nowa Sól.</w:t>'
           f'</w:r></w:p><w:p><w:r><w:t>tel. 511 222 333, ola@sklep.example</w:t></w:r></w:p></w:body></w:document>')
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", doc)
    return b.getvalue()


def _xlsx_bytes():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    wb = f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Lista" sheetId="1" r:id="rId1"/></sheets></workbook>'
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
    sst = f'<sst xmlns="{s}"><si><t>Osoba</t></si><si><t>Numer</t></si><si><t>Ola Nowak</t></si></sst>'
    ws = (f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
          f'<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>71040598765</v></c></row></sheetData></worksheet>')
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/worksheets/sheet1.xml", ws)
    return b.getvalue()


def test_office_ingest(spark):
    d = _scratch()
    with open(os.path.join(d, "umowa.docx"), "wb") as f:
        f.write(_docx_bytes())
    with open(os.path.join(d, "dane.xlsx"), "wb") as f:
        f.write(_xlsx_bytes())
    with open(os.path.join(d, "list.eml"), "wb") as f:
        f.write(b"Subject: Umowa\r\nFrom: a@b.pl\r\nTo: c@d.pl\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nTresc listu\r\n")
    with open(os.path.join(d, "bad.exe"), "wb") as f:
        f.write(b"MZ")
    docs, rejects = BIN.read_office_files(spark, d)
    got = {os.path.basename(r.path): r.text for r in docs.collect()}
    assert got["umowa.docx"].split("\n")[1] == "tel. 511 222 333, ola@sklep.example"
    assert got["dane.xlsx"] == DUMP
    assert got["list.eml"].startswith("Temat: Umowa\nOd: a@b.pl\nDo: c@d.pl\n\nTresc listu")
    assert [os.path.basename(r.path) for r in rejects.collect()] == ["bad.exe"]
    ok, bad = BIN.ingest_text(spark.createDataFrame([("  \n",), ("abc",)], "text string"))
    assert ok.count() == 1 and bad.count() == 1


def test_parse_store_and_legacy_import(spark):
    rows = spark.createDataFrame([("key1", '{"name":"test","value":42}'), ("bad", "{not json"), ("nullv", None)],
                                 "key string, value string")
    ok, bad = VT.parse_store(rows, "value", "name string, value int")
    assert sorted(r.key for r in ok.collect()) == ["key1", "nullv"] and [r.key for r in bad.collect()] == ["bad"]
    d = _scratch()
    blob = b"Hello, binary world! \x00\xff\xfe"
    with open(os.path.join(d, "legacy-docx-1.original_bytes"), "wb") as f:
        f.write(blob)
    kv = spark.createDataFrame([("legacy-docx-1", '{"filename":"umowa.docx","ext":".docx"}'),
                                ("legacy-xlsx-1", '{"filename":"raport.xlsx","ext":".xlsx"}')], "key string, value string")
    got = {r.key: r.original_bytes for r in BIN.legacy_import(spark, kv, d).collect()}
    assert bytes(got["legacy-docx-1"]) == blob and got["legacy-xlsx-1"] is None


def test_audit_append_sink_defaults_and_partitions(spark):
    d = _scratch()
    out = os.path.join(d, "audit")
    ev = spark.createDataFrame([("file_uploaded", "s1", None), ("task_created", "s2", True)],
                               "event string, session_id string, data_left_boundary boolean")
    AJ.append_audit(ev, out)
    AJ.append_audit(ev.limit(1), out)
    back = AJ.read_audit(spark, out)
    rows = back.select("event", "session_id", "data_left_boundary", "timestamp").collect()
    assert len(rows) == 3 and all(r.timestamp is not None for r in rows)
    assert sorted((r.session_id, r.data_left_boundary) for r in rows) == [("s1", False), ("s1", False), ("s2", True)]
    assert any(name.startswith("day=") for name in os.listdir(out))


def test_legacy_values_are_opened_or_passed(spark):
    """Sealed, sealed with another key, plain and damaged session maps; raw and base64 blobs; two imports of one session."""
    rows = spark.createDataFrame([("s1", '{"[P_1]":"Jan"}', 1), ("s2", '{"[P_2]":"Ewa","[P_3]":"Ola"}', 2), ("s3", "not json", 3), ("s4", "{}", 4), ("s5", '{"[P_5]":"x"}', 5), (None, None, 6)],
                                 "session_id string, token_map string, n int")
    sealed = F.when(F.col("n") == 2, F.base64(VT.encrypt(F.col("token_map"), "key"))).when(F.col("n") == 5, F.base64(VT.encrypt(F.col("token_map"), "other"))).otherwise(F.col("token_map"))
    t = rows.select("session_id", sealed.alias("token_map"), F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    got = {(r.session_id, r.token, r.value) for r in BIN.legacy_vault(t, "key").collect()}
    assert got == {("s1", "[P_1]", "Jan"), ("s2", "[P_2]", "Ewa"), ("s2", "[P_3]", "Ola"), ("s3", None, None), ("s5", None, None), (None, None, None)}
    plain = BIN.legacy_vault(t.where("session_id = 's1'"), None)
    assert [r.value for r in plain.collect()] == ["Jan"]
    later = plain.withColumn("value", F.lit("Anna")).withColumn("created_at", F.lit("2026-02-01").cast("timestamp"))
    current = plain.withColumn("value", F.lit("old")).unionByName(plain.withColumn("session_id", F.lit("s9")))
    merged = BIN.merge_sessions(current, plain.unionByName(later))
    assert {(r.session_id, r.value) for r in merged.collect()} == {("s1", "Anna"), ("s9", "Jan")}
    d = _scratch()
    raw = spark.range(1).select(VT.encrypt(F.lit("tajne"), "key").alias("b")).first().b
    for name, data in (("a", bytes(raw)), ("b", b"\x00\xff plain"), ("c", b"")):
        with open(os.path.join(d, f"{name}.original_bytes"), "wb") as f:
            f.write(data)
    kv = spark.createDataFrame([(k, "{}") for k in "abcd"], "key string, value string")
    got = {r.key: None if r.original_bytes is None else bytes(r.original_bytes) for r in BIN.legacy_import(spark, kv, d, "key").collect()}
    assert got == {"a": b"tajne", "b": b"\x00\xff plain", "c": None, "d": None}


def test_legacy_import_of_packed_blobs_equals_that_of_files(spark):
    """Blobs as (path, content) rows: sealed, plain and empty ones, a key with none; the folder gives the same."""
    d = tempfile.mkdtemp()
    sealed = spark.range(1).select(F.base64(VT.encrypt(F.lit("umowa"), "key")).alias("v")).first().v
    blobs = {"a": sealed.encode() + b"\n", "b": b"plain \x00\xff", "c": b""}
    for k, v in blobs.items():
        with open(os.path.join(d, f"{k}.original_bytes"), "wb") as f:
            f.write(v)
    kv = spark.createDataFrame([(k, "{}") for k in "abcd"], "key string, value string")
    packed = spark.createDataFrame([(f"old/{k}.original_bytes", bytearray(v)) for k, v in blobs.items()], "path string, content binary")
    got = {r.key: r.original_bytes and bytes(r.original_bytes) for r in BIN.legacy_import(spark, kv, packed, "key").collect()}
    assert got["a"] == b"umowa" and got["b"] == blobs["b"] and got["d"] is None
    assert got == {r.key: r.original_bytes and bytes(r.original_bytes) for r in BIN.legacy_import(spark, kv, d, "key").collect()}


def test_cells_are_not_shuffled_and_a_grid_once(spark):
    """Duplicates within a section, and over sections of one name in the rebuild grammar: the last line, with no exchange."""
    df = spark.createDataFrame([(1, "[Arkusz: A]\nB1: x\nB1: y\nA1: 1\n[Arkusz: A]\nB1: z\nluzem"), (2, ""), (3, None)], "doc_id long, text string")
    preview, rebuilt = SH.sheet_cells(df), SH.sheet_cells(df, fallback=True)
    assert {tuple(r) for r in preview.collect()} == {(1, 1, "A", 1, 2, "y"), (1, 1, "A", 1, 1, "1"), (1, 2, "A", 1, 2, "z")}
    assert {tuple(r) for r in rebuilt.collect()} == {(1, "A", 1, 2, "z"), (1, "A", 1, 1, "1"), (1, "A", 2, 1, "luzem")}
    exchanges = [d._jdf.queryExecution().executedPlan().toString() for d in (preview, rebuilt, SH.sheet_grid(preview))]
    assert [e.count("Exchange hashpartitioning") for e in exchanges] == [0, 0, 1]


def test_preview_cells_equal_the_parsing_expression(spark):
    """Odd dumps, many in one run: the cells read from bytes are those of ``parse_dump``, the last line of equal ones."""
    import random

    rng = random.Random(11)
    parts = ["A1: x", "a1:y", "zz7:\t z", "XFD1: end", "XFE1: no", "ABCD1: no", "B000000000000000000000003: zeros", "A10000000: no", "A99999999999999999999: no", "A1048577: no",
             "A0: null", "A: no", "1: no", ": no", "A1", "A1 : no", "A1x: no", "A12x345678: no", "\u01411: no", "A\u0663: no", "B2:", "C3::", "C4: a: b", "D1:\u00a0wide", "E1: \u3000", "F1: \u017c", "free", "[Arkusz: P]",
             "[Arkusz:]", "[Arkusz: \u00a0Q\u2003 ]", "[Arkusz: R] x", "[Arkusz: A1: x]", " [Arkusz:S]\t", "[arkusz: T]", "A1: [Arkusz: U]", "A2: \U0001f600 \u00e9", "]", "[", "A1: \x1c", "A3:\x0bq", "A4: x\u200by"]
    breaks = ["\n", "\r\n", "\r", "\n\n", " \n\t", "\x0b", "\f", "\x85", "\u2028", "\u2029 ", "\u00a0\n\u3000", " ", "\u2003"]
    texts = ["", " ", "\n", "A1: x", "\u3000A1: x\u3000", "[Arkusz: only]", None, "A1: " + " " * 5000 + "far"] + [
        "".join(rng.choice(["", " ", "\n", "\u2028"]) if not i else rng.choice(parts) + rng.choice(breaks) for i in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    by = ["section", "sheet", "row", "col"]
    want = df.select("doc_id", F.explode(SH.last_lines(SH.parse_dump(F.col("text")), by)).alias("c")).select("doc_id", "c.*")
    got = SH.sheet_cells(df)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert got == want and len(got) > 1000


def test_cells_are_read_from_bytes_in_small_runs(spark, monkeypatch):
    """No expression takes a dump apart line by line; dumps that begin and end a run keep their own lines."""
    from veilmark.functions import dumps as DU

    import pyarrow as pa

    plan = SH.sheet_cells(spark.createDataFrame([(1, DUMP)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["A1: a", None, "A1: b\n[Arkusz: X]", "B1: c"])], ["doc_id", "text"])
    monkeypatch.setattr(DU, "RUN_BYTES", 8)
    rows = [r for b in DU.preview_cells(iter([batch, batch.slice(2)]), "S") for r in b.to_pylist()]
    assert [(r["doc_id"], r["sheet"], r["row"], r["col"], r["value"]) for r in rows] == [
        (1, "S", 1, 1, "a"), (3, "S", 1, 1, "b"), (4, "S", 1, 2, "c"), (3, "S", 1, 1, "b"), (4, "S", 1, 2, "c")]
