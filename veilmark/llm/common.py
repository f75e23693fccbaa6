"""Helpers shared by the operators of this subpackage.

Row identity: no operator relies on ``doc_id`` being unique or non-null.  Where
rows have to find each other again after a shuffle, the table is written once
with a row number (:func:`numbered`), so that a task that is run again after a
lost executor reads the same numbers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.session import ensure_checkpoint_dir

#: ASCII white space, as every contract of this subpackage defines it.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Bytes of text that a Python task holds in work arrays at a time.
SLICE_BYTES = 4 << 20
#: Longest text that may be in a training sample collected to the driver (its rows are bounded too).
SAMPLE_CHARS = 200_000
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a copy that outlives any executor; columnar, so later
    steps read only the columns they use.  ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veilmark-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, col: str) -> DataFrame:
    """``df`` written once, with a unique row number ``col``."""
    return written(df.withColumn(col, F.monotonically_increasing_id()), name)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def hash_sample(df: DataFrame, stratum: str, bound: int, key: list[str]) -> list:
    """At most ``bound`` rows of each stratum, picked by a hash of ``key``.

    One count per stratum, then one filtered scan: the threshold of a stratum
    lets about ``0.9 * bound`` of its rows through.  No sort, no window; the
    rows returned to the driver are bounded by strata x bound.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    space = 1 << 30
    h = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(7)), F.lit(space))
    keep = F.lit(False)
    for s, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        keep = keep | (F.col(stratum).eqNullSafe(F.lit(s)) & (h < F.lit(int(space * min(1.0, 0.9 * bound / n)))))
    picked = df.where(keep).withColumn("sample_key", h).limit(2 * bound * max(1, len(sizes))).collect()
    out, seen = [], {}
    for r in sorted(picked, key=lambda r: (r["sample_key"], hashlib.md5(repr(tuple(r)).encode()).digest())):
        if seen.setdefault(r[stratum], 0) < bound:
            seen[r[stratum]] += 1
            out.append(r)
    return out


# ---------------------------------------------------------------------------
# Arrow text columns as flat byte arrays
# ---------------------------------------------------------------------------
def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``limit`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def pieces_of(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings between ascending ``cuts`` and, for each string, its index."""
    off = pa.py_buffer(np.ascontiguousarray(cuts, np.int64))
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, off, pa.py_buffer(np.ascontiguousarray(data))])
    d = arr.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spread_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------------------
# Marking single rows of a written table without shuffling its texts
# ---------------------------------------------------------------------------
#: Most 64-row marks that are broadcast (16 bytes of data each).
BROADCAST_MARKS = 1_000_000


def marked(rows: DataFrame, rid: str, flagged: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: is its number among those of ``flagged``?

    The numbers (column ``rid`` of both) are packed into one 64-bit mask for each
    64 consecutive rows.  The masks are counted first: up to ``BROADCAST_MARKS``
    of them (64 million rows with at least one flagged row in each 64) are
    broadcast, so the wide table stays where it is; beyond that it is joined on
    the block number.
    """
    masks = written(
        flagged.groupBy(F.shiftright(F.col(rid), 6).alias("mark_block"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({rid} & 63 as int))")).alias("mark_mask")),
        "marks",
    )
    if masks.count() <= BROADCAST_MARKS:
        masks = F.broadcast(masks)
    # the numbers of one writer's rows are dense, so a block is 64 rows at most
    block = F.shiftright(rows[rid], 6)
    joined = rows.join(masks, block == masks["mark_block"], "left")
    bit = F.coalesce(F.col("mark_mask"), F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1L, cast({rid} & 63 as int))"))
    return joined.withColumn(name, bit != 0).drop("mark_block", "mark_mask")
