"""Running totals inside an array, in column expressions.

A fold that appends to its own result copies that result at every step, so its cost is the square of the
array's length. Here an array is cut into blocks of ``BLOCK``; totals are folded within each block and over
the blocks' sums, and a third level does the same over blocks of blocks. A fold therefore never holds more than ``BLOCK``
values, but for the last one, which has one value for ``BLOCK * BLOCK`` of the array's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(sizes: Column) -> Column:
    """[0, first, first + second, ...]: one element more than ``sizes``."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(sizes, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _cut(values: Column) -> Column:
    """The array in blocks; none of an empty array."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(values, (b - 1) * BLOCK + 1, BLOCK))
    return F.when(F.size(values) == 0, F.array().cast("array<array<bigint>>")).otherwise(blocks)


def _level(sizes: Column, above: Callable[[Column], Column]) -> Column:
    def totals(blocks: Column) -> Column:
        before = above(F.transform(blocks, lambda b: F.element_at(b, -1)))
        # The last total of a block is the first of the next, so it is left out here.
        shift = lambda b, at: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + at)
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), shift))

    return bound(sizes, lambda s: bound(F.transform(_cut(s), _folded), totals))


def totals_before(sizes: Column) -> Column:
    """For an array<long> the array, of the same length, of the sums of all elements before each; ``sizes`` may not
    hold nulls. An empty array gives an empty one, a null array null."""
    return _level(sizes, lambda sums: _level(sums, _folded))
