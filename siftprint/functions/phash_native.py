"""64-bit perceptual hashes of small grids as expressions: nothing leaves the JVM.

A grid is an array of integers 0 to 255, row by row, of the algorithm's target size for
side 8.  Bit k of the word is set where the comparison of position k holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

S = 8
BITS = S * S


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(bit: Callable[[Column], Column], n: int = BITS) -> Column:
    """The word whose bit k is ``bit(k)``, for k under n."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.lit(0).cast("long"),
        lambda acc, k: acc.bitwiseOR(F.when(bit(k), F.call_function("shiftleft", one, k)).otherwise(F.lit(0).cast("long"))),
    )


def _at(p: Column, i: Column) -> Column:
    return F.get(p, i.cast("int"))


def _div(k: Column, n: int) -> Column:
    return F.floor(k / n)


def mean(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0), lambda a, x: a + x)
    return let(total, lambda t: pack(lambda k: _at(p, k) * F.size(p) >= t))


def median(p: Column) -> Column:
    return let(F.get(F.sort_array(p), _div(F.size(p), 2).cast("int")), lambda m: pack(lambda k: _at(p, k) > m))


def gradient(p: Column) -> Column:
    """Grid of width 8 and height 9; the last bit has no comparison."""
    at = lambda k: _div(k, S - 1) * S + k % (S - 1)
    return pack(lambda k: _at(p, at(k) + 1) > _at(p, at(k)), BITS - 1)


def vert_gradient(p: Column) -> Column:
    """Grid of width 9 and height 8, column by column; the last bit has no comparison."""
    w = S + 1
    at = lambda k: (k % (S - 1)) * w + _div(k, S - 1)
    return pack(lambda k: _at(p, at(k) + w) > _at(p, at(k)), BITS - 1)


def double_gradient(p: Column) -> Column:
    """Grid of 9 by 9: half of the bits across, row by row, the others down, column by column."""
    w, half = S + 1, BITS // 2
    across = lambda k: _div(k, S) * w + k % S
    down = lambda j: (j % S) * w + _div(j, S)
    return pack(
        lambda k: F.when(k < half, _at(p, across(k) + 1) > _at(p, across(k))).otherwise(_at(p, down(k - half) + w) > _at(p, down(k - half)))
    )


def block_means(p: Column, side: int) -> Column:
    """Truncated means of the 8 by 8 blocks of a square grid."""
    b = side // S
    cells = [(i, j) for i in range(b) for j in range(b)]

    def cell(m: Column) -> Column:
        first = _div(m, S) * (b * side) + (m % S) * b
        total = F.lit(0)
        for i, j in cells:
            total = total + _at(p, first + i * side + j)
        return F.floor(total / len(cells)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), cell)


def block(p: Column, side: int = S) -> Column:
    """Neighbours across, row by row, then the first row of blocks against the second."""
    n = S * (S - 1)
    at = lambda k: _div(k, S - 1) * S + k % (S - 1)

    def bits(m: Column) -> Column:
        return pack(lambda k: F.when(k < n, _at(m, at(k) + 1) > _at(m, at(k))).otherwise(_at(m, k - n + S) > _at(m, k - n)))

    return let(block_means(p, side) if side > S else p, bits)


#: By name; each takes an array of integers of the target size for side 8.
NATIVE: dict[str, Callable[[Column], Column]] = {"mean": mean, "median": median, "gradient": gradient, "vert_gradient": vert_gradient, "double_gradient": double_gradient, "block": block}
