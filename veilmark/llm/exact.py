"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Every row gets the SHA-256 of its normalised text; the table is written once
   with a row number.
2. Senders (runs of rows of one task) sort the leading bits of their hashes, cut
   them by owner (the first bits) and code the gaps by Golomb-Rice: about two bits
   more than the entropy of the gaps, where a hash takes 32 bytes.  Only these
   codes go to the owners; the row numbers stay in the senders' written rows, which
   the answers are joined with.  A hash that one sender has many times is sent once.
3. Owners decode what all senders sent them and answer each with a bitmap: which
   of its hashes did another sender send too?
4. Rows so marked (and those that repeat within their sender) are suspects.  Only
   their texts are shuffled, aggregated by the text itself, so equal means equal
   byte for byte; partial aggregation sends a text once from each task, however
   often it occurs there.  What the suspects get back are thin rows.

Leading bits that agree by chance only make a suspect that step 4 clears.

Cases: a null text is the empty text; of rows that agree in text and doc_id (or
have a null doc_id, which comes after every number) the one written first stays;
an empty table gives no rows; extra columns are carried unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import SPACE_CLASS, free_name, marked, numbered, written

#: Most rows whose hashes one sender sorts at a time.
SENDER_ROWS = 1 << 18
#: Hashes that an owner is meant to hold.
OWNER_HASHES = 1 << 19
#: Bits of a hash beyond those that number all rows: two hashes agree by chance at 2**-SPARE.
SPARE_BITS = 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS + "+", " ")


# ------------------------------------------------------------------ Golomb-Rice
def rice_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """(k, unary quotients, k-bit remainders) of the gaps of ascending distinct ``values`` below ``span``."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(math.log2(max(1.0, span / max(1, len(values)) * math.log(2)))))
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    if not k:
        return k, np.packbits(unary).tobytes(), b""
    bits = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        gaps |= bits.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


# -------------------------------------------------------------------- exchange
SENT = "sender long, owner long, n int, k int, unary binary, remainders binary, numbers binary, firsts binary"


def _send(batches: Iterator[pa.RecordBatch], bits: int, owner_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (number, hash) of a task to one coded message for each sender and owner."""
    low = bits - owner_bits
    sender = TaskContext.get().partitionId() << 24
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        numbers = np.concatenate([x for x, _ in held])
        prints = np.concatenate([x for _, x in held])
        held.clear()
        order = np.lexsort((numbers, prints))
        numbers, prints = numbers[order], prints[order]
        firsts = np.diff(prints, prepend=-1) != 0
        owners = prints >> low
        rows: dict[str, list] = {c.split()[0]: [] for c in SENT.split(", ")}
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(owners)), strict=True):
            values = prints[a:b][firsts[a:b]] & ((1 << low) - 1)
            k, unary, remainders = rice_encode(values, 1 << low)
            for name, v in (("sender", sender), ("owner", int(owners[a])), ("n", len(values)), ("k", k), ("unary", unary),
                            ("remainders", remainders), ("numbers", numbers[a:b].astype("<i8").tobytes()),
                            ("firsts", np.packbits(firsts[a:b]).tobytes())):
                rows[name].append(v)
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.record_batch([pa.array(rows[c.split()[0]], types[c.split()[1]]) for c in SENT.split(", ")], list(rows))

    count = 0
    for batch in batches:
        digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, 4)[:, 0]
        held.append((batch.column(0).to_numpy(zero_copy_only=False), (digests >> np.uint64(64 - bits)).astype(np.int64)))
        count += batch.num_rows
        if count >= SENDER_ROWS:
            yield flush()
            sender, count = sender + 1, 0
    if count:
        yield flush()


def _own(messages: pa.Table) -> pa.Table:
    """One owner's answer to each of its senders: a bitmap over the hashes it sent."""
    rows = messages.to_pylist()
    values = np.concatenate([rice_decode(r["n"], r["k"], r["unary"], r["remainders"]) for r in rows])
    order = np.argsort(values, kind="stable")
    same = np.diff(values[order]) == 0
    shared = np.zeros(len(values), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    ends = np.cumsum([r["n"] for r in rows])
    return pa.table({
        "sender": pa.array([r["sender"] for r in rows], pa.int64()),
        "owner": pa.array([r["owner"] for r in rows], pa.int64()),
        "shared": pa.array([np.packbits(shared[e - r["n"]:e]).tobytes() for e, r in zip(ends, rows, strict=True)], pa.binary()),
    })


def _suspects(batches: Iterator[pa.RecordBatch], rid: str) -> Iterator[pa.RecordBatch]:
    """Row numbers whose hash another sender has, or their own sender has twice."""
    for batch in batches:
        out = [np.zeros(0, np.int64)]
        for r in batch.to_pylist():
            numbers = np.frombuffer(r["numbers"], "<i8")
            firsts = np.unpackbits(np.frombuffer(r["firsts"], np.uint8), count=len(numbers)).astype(bool)
            group = np.cumsum(firsts) - 1
            shared = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]).astype(bool)
            out.append(numbers[(shared | (np.bincount(group, minlength=r["n"]) > 1))[group]])
        yield pa.record_batch([pa.array(np.concatenate(out), pa.int64())], [rid])


def suspects(rows: DataFrame, rid: str, digest: str) -> DataFrame:
    """Numbers of the rows of the written table ``rows`` whose hash may occur twice."""
    n = max(1, rows.count())
    owner_bits = max(6, math.ceil(math.log2(max(1.0, n / OWNER_HASHES))))
    bits = min(62, max(owner_bits + 8, math.ceil(math.log2(n)) + SPARE_BITS))
    sent = written(rows.select(rid, digest).mapInArrow(partial(_send, bits=bits, owner_bits=owner_bits), SENT), "sent")
    answers = sent.select("sender", "owner", "n", "k", "unary", "remainders").groupBy("owner").applyInArrow(
        _own, "sender long, owner long, shared binary")
    back = sent.select("sender", "owner", "n", "numbers", "firsts").join(answers, ["sender", "owner"])
    return back.select("n", "numbers", "firsts", "shared").mapInArrow(partial(_suspects, rid=rid), f"{rid} long")


# -------------------------------------------------------------------- decisions
def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(rows, found, names): the written rows with number, digest and suspicion; for each suspect the class it is in.

    ``found`` has thin rows: the suspect's number, the row that stays (``keep``) and
    ``class_size``.  Texts are shuffled once, as grouping keys; a suspect finds its
    class by digest, length and a second hash, whatever number of rows the class has.
    """
    names = {c: free_name(docs, c) for c in ("rid", "digest", "suspect", "dropped", "of", "keep", "size", "keep_id", "group_size", "kept", "text_sha256")}
    rid, digest, suspect = (names[c] for c in ("rid", "digest", "suspect"))
    rows = numbered(docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256))), "exact", rid)
    rows = marked(rows, rid, suspects(rows, rid, digest), suspect)
    doc_id, text = F.col("doc_id").cast("long"), normalised(F.col("text"))
    again = rows.where(F.col(suspect))
    classes = (
        again.select(F.col(digest).alias("class_digest"), text.alias("class_text"),
                     F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col(rid).alias("rid")).alias("row"))
        .groupBy("class_digest", "class_text")
        .agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("class_size"))
        .select("class_digest", F.xxhash64("class_text").alias("class_hash"), F.length("class_text").alias("class_length"), "keep", "class_size")
    )
    thin = again.select(F.col(rid).alias("row_number"), F.col(digest).alias("row_digest"), F.xxhash64(text).alias("row_hash"), F.length(text).alias("row_length"))
    met = (F.col("row_digest") == F.col("class_digest")) & (F.col("row_hash") == F.col("class_hash")) & (F.col("row_length") == F.col("class_length"))
    return rows, thin.join(classes, met).select("row_number", "keep", "class_size"), names


def decided(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with four more columns; the dictionary has their names.

    keep_id (doc_id of the row that stays), group_size, kept, text_sha256.
    """
    rows, found, names = _classed(docs)
    rid, digest, suspect = (names[c] for c in ("rid", "digest", "suspect"))
    doc_id = F.col("doc_id").cast("long")
    hexed = F.lower(F.hex(F.col(digest))).alias(names["text_sha256"])
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = rows.where(~F.col(suspect)).select(
        *own, doc_id.alias(names["keep_id"]), F.lit(1).cast("long").alias(names["group_size"]), F.lit(True).alias(names["kept"]), hexed)
    # joined on the row number: no key is hot, and columns that are not asked for stay where they are
    of, keep, size = (names[c] for c in ("of", "keep", "size"))
    thin = found.select(F.col("row_number").alias(of), F.col("keep").alias(keep), F.col("class_size").alias(size))
    several = rows.where(F.col(suspect)).select(*own, rid, digest).join(thin, F.col(rid) == F.col(of)).select(
        *own, F.col(keep)["doc_id"].alias(names["keep_id"]), F.col(size).alias(names["group_size"]),
        (F.col(keep)["rid"] == F.col(rid)).alias(names["kept"]), hexed)
    return single.unionByName(several), names


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another kept row has; only the numbers of dropped rows meet the table."""
    rows, found, names = _classed(docs)
    rid, dropped = names["rid"], names["dropped"]
    gone = found.where(F.col("keep")["rid"] != F.col("row_number")).select(F.col("row_number").alias(rid))
    return marked(rows, rid, gone, dropped).where(~F.col(dropped)).select(*[F.col(f"`{c}`") for c in docs.columns])
