"""Joins whose left side may have a hot key, and digests of a table's hashes to ask before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.session import written

#: Parts into which the rows of one key are dealt.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) on the key, the left rows of a key dealt to ``salts`` tasks.

    ``spread`` is a hash of what tells the left rows of a key apart.  The right side
    is repeated ``salts`` times, so it should be the smaller one; the join's key
    columns are those of ``left`` only.
    """
    l = left.withColumn("_key", left_key).withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    r = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed(right_key, "_rkey")
    return l.join(r, (F.col("_key") == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), how).drop("_key", "_rkey", "_salt", "_rsalt")


#: A filter's bits for each hash; words of 64 bits in a block, blocks at most; bits that a hash sets.
BITS_EACH, BLOCK_WORDS, MOST_BLOCKS, PROBES = 16, 64, 1 << 15, 3


def _probe(h: Column, k: int) -> Column:
    """Bit of a block that probe ``k`` of a hash sets."""
    return F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK_WORDS * 64))


def hash_filter(hashes: DataFrame, col: str) -> DataFrame:
    """(blocks, block, words): a Bloom filter of a column of hashes, cut into blocks of 4,096 bits.

    A hash lies in one block, so the filter is a table with a row per block: at most
    16 MB however many hashes there are (beyond eight million it only lets more pass).
    """
    each = hashes.select(F.col(col).alias("h")).distinct()
    n = each.count()
    blocks = min(MOST_BLOCKS, max(1, 1 << (n * BITS_EACH // (BLOCK_WORDS * 64)).bit_length()))
    marks = each.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(F.array(*[_probe(F.col("h"), k) for k in range(PROBES)])).alias("bit"))
    masks = marks.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    # at most BLOCK_WORDS entries a block
    filled = masks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return written(filled.select(F.lit(blocks).cast("bigint").alias("blocks"), "block", words.alias("words")), "filter").withColumn("blocks", F.lit(blocks).cast("bigint"))


def may_hold(df: DataFrame, keys: DataFrame, h: Column) -> DataFrame:
    """The rows whose hash a ``hash_filter`` may hold (all that it holds, and a few others), and those with no hash."""
    head = keys.select("blocks").first()
    blocks = head[0] if head else 1
    asked = df.withColumn("_ask", h.cast("bigint")).withColumn("_block", F.pmod("_ask", F.lit(blocks)))
    met = asked.join(F.broadcast(keys.select(F.col("block").alias("_block"), F.col("words").alias("_filter"))), "_block", "left")
    held = F.lit(True)
    for k in range(PROBES):
        bit = _probe(F.col("_ask"), k)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
        held = held & (F.get("_filter", F.floor(bit / 64).cast("int")).bitwiseAND(mask) != 0)
    return met.where(F.col("_ask").isNull() | held).select(*df.columns)
