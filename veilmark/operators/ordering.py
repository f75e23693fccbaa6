"""Ordered numbers and deep pages without one task that sorts everything.

* :func:`numbered_in_order`: a range partitioning of thin keys gives runs, each is
  numbered in its own task, and the sizes of the runs before give the offset.
* :func:`page`: the cell of the key space that holds an offset is found by counts per
  cell, narrowed until it is small; only that cell's rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.operators.joins import salted_join
from veilmark.session import written

#: Rows of a run, about.
RUN_ROWS = 1_000_000
#: Cells into which a key range is counted, and rows that are few enough to sort.
CELLS, RANGE_ROWS = 1024, 100_000


def numbered_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """``df`` numbered from 1 in the order ``order`` (sort expressions over the columns ``keys``).

    Rows of equal keys are told apart by a row number that is written with the table,
    so any number of them is cut into runs too.  There are as many runs as the count
    of rows asks for, and at least the session's shuffle partitions.  Only keys are
    shuffled by range and sorted; the numbers are joined to the rows afterwards.
    """
    spark = df.sparkSession
    rows = written(df.withColumn("_rid", F.monotonically_increasing_id()), "ordered")
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // run_rows))
    by = [*order, F.col("_rid")]
    dealt = written(rows.select(*keys, "_rid").repartitionByRange(runs, *by).withColumn("_run", F.spark_partition_id()), "runs")
    # a row per run
    before = F.coalesce(F.sum("count").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_run").count().select("_run", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_run").orderBy(*by))
    numbers = dealt.join(offsets, "_run").select("_rid", (F.col("_before") + place).alias(name))
    return rows.join(numbers, "_rid").drop("_rid")


def ranked_in_groups(df: DataFrame, group: str, keys: Sequence[str], order: Sequence[Column], name: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """``df`` ranked from 1 within each group, the rows of a large group dealt to many tasks.

    The whole table is numbered by group and order; a group's smallest number (a
    mergeable aggregate) gives its ranks.  Rows of a null group are a group.
    """
    every = numbered_in_order(df, [group, *keys], [F.col(group).asc_nulls_first(), *order], "_number", run_rows)
    marked = every.withColumn("_group", F.struct(F.col(group).alias("g")))
    first = marked.groupBy("_group").agg(F.min("_number").alias("_first"))
    j = salted_join(marked, first.withColumnRenamed("_group", "_of"), F.col("_group"), "_of", F.xxhash64("_number"))
    return j.withColumn(name, (F.col("_number") - F.col("_first") + 1)).drop("_number", "_first", "_group")


# ---------------------------------------------------------------------------
# Deep pages
# ---------------------------------------------------------------------------
Bounds = list[tuple[str, int | None, int | None]]


def _whole(df: DataFrame, key: str) -> Column:
    """A key as a whole number (times: microseconds)."""
    kind = dict(df.dtypes)[key]
    return F.unix_micros(F.col(key).cast("timestamp")) if kind.startswith("timestamp") else F.col(key).cast("bigint")


def _value(df: DataFrame, key: str, x: int) -> Column:
    """A whole number as a value of the key, so that comparisons reach the scan."""
    kind = dict(df.dtypes)[key]
    return F.timestamp_micros(F.lit(x)).cast(kind) if kind.startswith("timestamp") else F.lit(x).cast(kind)


def locate(df: DataFrame, keys: Sequence[str], rank: int, range_rows: int = RANGE_ROWS) -> tuple[Bounds, int]:
    """The part of the key space that holds the row of a rank (from 0, descending, nulls last).

    Returns bounds, all but the last of them a single value (None: null), and the number
    of rows before that part.  Each step is one count by cells of the key; cells narrow
    until one has few rows, or a single value whose rows the next key tells apart.
    """
    part, before, bounds = df, 0, []
    for key in keys:
        x = _whole(df, key)
        low, high = part.agg(F.min(x), F.max(x)).first()
        while True:
            if low is None:
                bounds.append((key, None, None))
                part = part.where(F.col(key).isNull())
                break
            width = -(-(high - low + 1) // CELLS)
            counts = dict(tuple(r) for r in part.groupBy(F.floor((x - low) / width).alias("c") if width > 1 else (x - low).alias("c")).count().collect())
            missing = counts.pop(None, 0)
            for c in sorted(counts, reverse=True):
                if rank < before + counts[c]:
                    break
                before += counts[c]
            else:
                # after all values come the rows without one
                low = None
                if not missing:
                    raise ValueError("rank beyond the table")
                continue
            low, high = low + c * width, min(high, low + (c + 1) * width - 1)
            part = part.where((F.col(key) >= _value(df, key, low)) & (F.col(key) <= _value(df, key, high)))
            if low == high or counts[c] <= range_rows:
                bounds.append((key, low, high))
                break
        if bounds[-1][1] != bounds[-1][2]:
            return bounds, before
    return bounds, before


def _beyond(df: DataFrame, bounds: Bounds, later: bool) -> Column:
    """Rows in the located part or later in the descending order (or earlier)."""
    out, same = F.lit(False), F.lit(True)
    for key, low, high in bounds:
        c = F.col(key)
        if low is None:
            past, here = (F.lit(False) if later else c.isNotNull()), c.isNull()
        else:
            past = (c < _value(df, key, low)) | c.isNull() if later else c > _value(df, key, high)
            here = c.between(_value(df, key, low), _value(df, key, high))
        out, same = out | (same & past), same & here
    return out | same


def page(df: DataFrame, keys: Sequence[str], offset: int, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows [offset, offset + limit) in descending order of ``keys`` (times or whole numbers; nulls last)."""
    order = [F.col(k).desc_nulls_last() for k in keys]
    if offset + limit <= range_rows:
        top = df.orderBy(*order)
        return (top.offset(offset) if offset else top).limit(limit)
    n = df.count()
    if offset >= n:
        return df.limit(0)
    first, before = locate(df, keys, offset, range_rows)
    last, _ = locate(df, keys, min(n, offset + limit) - 1, range_rows)
    (key, _, high), (_, low, _) = first[0], last[0]
    near = df
    if high is not None and low is not None:  # plain bounds, by which the scan skips files and row groups
        near = df.where((F.col(key) <= _value(df, key, high)) & (F.col(key) >= _value(df, key, low)))
    part = near.where(_beyond(df, first, later=True) & _beyond(df, last, later=False)).orderBy(*order)
    return (part.offset(offset - before) if offset > before else part).limit(limit)
