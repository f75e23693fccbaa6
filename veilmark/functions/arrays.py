"""Array helpers.

``explode`` of a *computed* array makes Catalyst infer ``size(arr) > 0`` and
push that filter down — with the whole array expression inside it — below
projections and even below a repartition, so an expensive expression (span
detection) runs twice, once in the scan stage.  ``explode_outer`` followed by a
null filter on the generator output keeps the expression where it was written.

Higher-order functions do not keep the value of an expression that a lambda
refers to; :func:`let` binds it once.  A fold that appends to an array copies it
at every step; :func:`prefix_scan` instead works in blocks of about sqrt(n), so
running sums and maxima over n elements cost n * sqrt(n) small steps at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays up to this size are handled without blocks or clusters (same results, less overhead).
FEW = 16
#: Characters in a block of ``text_blocks``.
BLOCK_CHARS = 4096


def explode_kept(arr: Column) -> Column:
    """Like ``explode`` (for arrays without null elements) but without filter inference."""
    return F.explode_outer(arr)


def posexplode_kept(arr: Column) -> Column:
    return F.posexplode_outer(arr)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """0 .. n-1 (for n > 0)."""
    return F.sequence(F.lit(0), n - 1)


def prefix_scan(values: Column, op: str) -> Column:
    """Exclusive running ``sum`` (from 0) or ``max`` (from null) of a non-empty array, as bigint.

    ``values`` should be a column or a lambda's parameter (see :func:`let`).
    """
    zero = F.lit(0).cast("bigint") if op == "sum" else F.lit(None).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        return acc + x if op == "sum" else F.greatest(acc, x.cast("bigint"))

    def fold(a: Column, start: Column) -> Column:
        return F.aggregate(a, start, step)

    def over(blocks: Column) -> Column:
        return let(
            F.transform(blocks, lambda b: fold(b, zero)),
            lambda totals: F.flatten(F.transform(blocks, lambda b, k: let(
                fold(F.slice(totals, F.lit(1), k), zero),
                lambda start: F.transform(b, lambda _, j: fold(F.slice(b, F.lit(1), j), start)),
            ))),
        )

    def blocks_of(width: Column) -> Column:
        n = F.size(values)
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(values, k * width + 1, width))

    few = F.transform(values, lambda _, j: fold(F.slice(values, F.lit(1), j), zero))
    many = let(F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)), lambda width: let(blocks_of(width), over))
    return F.when(F.size(values) <= FEW, few).otherwise(many)


def text_blocks(text: Column) -> Column:
    """A text as an array of runs of ``BLOCK_CHARS`` characters."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def cut(blocks: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text given by ``text_blocks``: work follows b - a, not a."""
    first, last = F.floor(a / BLOCK_CHARS).cast("int"), F.floor(b / BLOCK_CHARS).cast("int")
    head = F.coalesce(F.get(blocks, first), F.lit(""))
    from_a = (a % BLOCK_CHARS + 1).cast("int")
    across = F.concat(
        F.substring(head, from_a, F.lit(BLOCK_CHARS)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), (b % BLOCK_CHARS).cast("int")),
    )
    return F.when(first == last, F.substring(head, from_a, F.greatest(b - a, F.lit(0)).cast("int"))).otherwise(across)


def neighbours_distinct(sorted_array: Column) -> Column:
    """A sorted array without repeated neighbours."""
    return let(sorted_array, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
