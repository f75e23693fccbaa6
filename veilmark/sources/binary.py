"""Office files as a distributed source.

``binaryFile`` lists and reads the files; routing by extension is a column
expression; the parsing of each format runs in ``mapInPandas`` with the
standard library only (``email``, ``zipfile``, ``xml.etree``), one file per
row, so the work is spread over all tasks.  PDF and Outlook .msg need
libraries that are not available and are routed to ``rejects``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators import vault as VT

PARSED_SCHEMA = "path string, ext string, kind string, text string, error string"

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# FIXED VALUES: e-mail header labels in output order, with the header they come from
EMAIL_HEADERS = [("Temat", "subject"), ("Od", "from"), ("Do", "to"), ("DW", "cc"), ("Data", "date")]
DOCX_HEADER_LABEL = "[Nagłówek]"
DOCX_FOOTER_LABEL = "[Stopka]"
PARSED_EXTS = [".docx", ".xlsx", ".eml", ".txt"]


def extension(path: Column) -> Column:
    """Lower-cased suffix including the dot ('' when none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by supported extension."""
    f = files.withColumn("ext", extension(F.col("path")))
    ok = F.col("ext").isin(*R.SUPPORTED_EXTENSIONS)
    return f.filter(ok), f.filter(~ok)


# -- per-format parsers (plain functions, unit-testable without Spark) ----------


def parse_eml(data: bytes) -> str:
    """S3: present headers as ``Label: value`` lines, blank line, text/plain parts joined by newlines."""
    from email import policy
    from email.parser import BytesParser

    msg = BytesParser(policy=policy.default).parsebytes(data)
    lines = [f"{label}: {msg[h]}" for label, h in EMAIL_HEADERS if msg[h]]
    parts: list[str] = []
    for part in msg.walk() if msg.is_multipart() else [msg]:
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            payload = part.get_payload(decode=True) or b""
            charset = part.get_content_charset() or "utf-8"
            try:
                parts.append(payload.decode(charset, errors="replace"))
            except LookupError:
                parts.append(payload.decode("utf-8", errors="replace"))
    body = "\n".join(parts)
    return "\n".join(lines) + "\n\n" + body if lines else body


def _docx_par_text(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{W_NS}t"))


def parse_docx(data: bytes) -> str:
    """Non-blank body paragraphs, then table rows (non-blank cells joined by ' | '),
    then header/footer paragraphs labelled."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        doc = ET.fromstring(z.read("word/document.xml"))
        body = doc.find(f"{W_NS}body")
        out: list[str] = []
        tables: list[str] = []
        if body is not None:
            for child in body:
                if child.tag == f"{W_NS}p":
                    t = _docx_par_text(child)
                    if t.strip():
                        out.append(t)
                elif child.tag == f"{W_NS}tbl":
                    for row in child.iter(f"{W_NS}tr"):
                        cells = []
                        for cell in row.iter(f"{W_NS}tc"):
                            ct = "\n".join(_docx_par_text(p) for p in cell.iter(f"{W_NS}p")).strip()
                            if ct:
                                cells.append(ct)
                        if cells:
                            tables.append(" | ".join(cells))
        out.extend(tables)
        for kind, label in (("header", DOCX_HEADER_LABEL), ("footer", DOCX_FOOTER_LABEL)):
            for name in sorted(n for n in z.namelist() if re.match(rf"word/{kind}\d*\.xml$", n)):
                part = ET.fromstring(z.read(name))
                for p in part.iter(f"{W_NS}p"):
                    t = _docx_par_text(p)
                    if t.strip():
                        out.append(f"{label} {t}")
    return "\n".join(out)


def parse_xlsx(data: bytes) -> str:
    """Per sheet a ``[Arkusz: name]`` line then ``A1: value`` for non-empty stripped cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{S_NS}t")) for si in sst.iter(f"{S_NS}si")]
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in rels.iter(f"{PKG_REL}Relationship")}
        out: list[str] = []
        for sh in wb.iter(f"{S_NS}sheet"):
            name = sh.get("name")
            tgt = target.get(sh.get(f"{R_NS}id"), "")
            path = tgt.lstrip("/") if tgt.startswith("/") else "xl/" + tgt
            out.append(f"[Arkusz: {name}]")
            ws = ET.fromstring(z.read(path))
            for c in ws.iter(f"{S_NS}c"):
                ref, typ = c.get("r"), c.get("t")
                v = c.find(f"{S_NS}v")
                if typ == "s" and v is not None:
                    val = shared[int(v.text)]
                elif typ == "inlineStr":
                    val = "".join(t.text or "" for t in c.iter(f"{S_NS}t"))
                else:
                    val = v.text if v is not None else None
                if val is not None and str(val).strip():
                    out.append(f"{ref}: {str(val).strip()}")
    return "\n".join(out)


PARSERS = {".eml": ("email", parse_eml), ".docx": ("document", parse_docx), ".xlsx": ("spreadsheet", parse_xlsx),
           ".txt": ("document", lambda b: b.decode("utf-8", errors="replace"))}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
            kind, fn = PARSERS.get(ext, (None, None))
            if fn is None:
                rows.append((path, ext, None, None, "unsupported"))
                continue
            try:
                rows.append((path, ext, kind, fn(bytes(content)), None))
            except Exception as exc:  # a broken file is a reject, not a job failure
                rows.append((path, ext, kind, None, f"{type(exc).__name__}"))
        yield pd.DataFrame(rows, columns=["path", "ext", "kind", "text", "error"])


def read_office_files(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from a folder of office files; documents(path, ext, kind, text)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    accepted, rejected = route(files)
    parsable = accepted.filter(F.col("ext").isin(*PARSED_EXTS))
    parsed = parsable.select("path", "ext", "content").mapInPandas(_parse_batches, PARSED_SCHEMA)
    docs = parsed.filter(F.col("error").isNull()).drop("error")
    rejects = (
        rejected.select("path", "ext", F.lit("unsupported extension").alias("reason"))
        .unionByName(accepted.filter(~F.col("ext").isin(*PARSED_EXTS)).select("path", "ext", F.lit("no parser").alias("reason")))
        .unionByName(parsed.filter(F.col("error").isNotNull()).select("path", "ext", F.col("error").alias("reason")))
    )
    return docs, rejects


def ingest_text(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) — whitespace-only texts are rejected."""
    blank = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s", "") == ""
    return df.filter(~blank), df.filter(blank)


#: Key of a blob file by its path.
BLOB_KEY = r"([^/]+)\.original_bytes$"


def opened(content: Column, passphrase: str | None) -> Column:
    """The content of a legacy value: decrypted if it is a sealed one of this passphrase, else as it stands."""
    if not passphrase:
        return content.cast("binary")
    sealed = F.try_to_binary(F.regexp_replace(content.cast("string"), r"\s", ""), F.lit("base64"))
    plain = F.try_aes_decrypt(sealed, VT.vault_key(passphrase), F.lit("GCM"))
    return F.coalesce(plain, F.try_aes_decrypt(content.cast("binary"), VT.vault_key(passphrase), F.lit("GCM")), content.cast("binary"))


def blob_files(spark: SparkSession, blob_dir: str, glob: str = "*.original_bytes") -> DataFrame:
    """(path, content) of the blob files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(blob_dir).select("path", "content")


def legacy_import(spark: SparkSession, kv: DataFrame, blobs: str | DataFrame, passphrase: str | None = None, glob: str = "*.original_bytes",
                  key_of: str = BLOB_KEY, schema: str | None = None) -> DataFrame:
    """key/value rows joined with blob files whose path names the key (no such file, or an empty one: null).

    ``blobs`` is a folder with a file per blob or, for more than some thousands of
    them, a table (path, content) of packed files, which needs no listing and no
    opening of each.  Blobs sealed with the passphrase are opened, others pass as they
    are.  With ``schema`` the values are parsed (S15): ``payload`` is null and
    ``corrupt`` true where one is no JSON.  Files are read once, by all tasks; rows and
    files meet on the key.
    """
    files = blob_files(spark, blobs, glob) if isinstance(blobs, str) else blobs
    b = files.select(F.regexp_extract("path", key_of, 1).alias("_key"), F.when(F.length("content") > 0, opened(F.col("content"), passphrase)).alias("original_bytes"))
    j = kv.join(b, F.col("key") == F.col("_key"), "left").drop("_key")
    if schema is None:
        return j
    corrupt = F.col("value").isNotNull() & F.get_json_object("value", "$").isNull()
    return j.withColumn("corrupt", corrupt).withColumn("payload", F.when(~corrupt, F.from_json("value", schema)))


def legacy_vault(rows: DataFrame, passphrase: str | None = None) -> DataFrame:
    """Legacy sessions (session_id, token_map, created_at, expires_at) as vault rows (session_id, token, value, ...).

    ``token_map`` is a JSON object, sealed or plain; one that is neither gives a row
    with a null token and value, so that the session is not lost silently.
    """
    text = opened(F.col("token_map"), passphrase).cast("string")
    parsed = rows.withColumn("_map", F.from_json(text, "map<string,string>"))
    each = parsed.select("session_id", F.explode_outer("_map").alias("token", "value"), "created_at", "expires_at", F.size("_map").alias("_n"))
    return each.where((F.col("_n") != 0) | F.col("_n").isNull()).drop("_n")


def merge_sessions(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Upsert of whole sessions: a session that is imported replaces the one that is there, of two imports the later one."""
    last = imported.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    latest = imported.join(last, "session_id").where(F.col("created_at").eqNullSafe(F.col("_last"))).drop("_last")
    kept = current.join(imported.select("session_id").distinct(), "session_id", "left_anti")
    return kept.unionByName(latest.select(*current.columns))
