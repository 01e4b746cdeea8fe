"""Hamming distance of 64-bit words kept as BIGINT bit patterns, and of arrays of them."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digest import _col


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two words differ, 0 to 64."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b))).cast("int")


def hamming_wide(a: Column | str, b: Column | str) -> Column:
    """Bits in which two arrays of words differ; null if their lengths do."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def hash_hex(h: Column | str) -> Column:
    """Sixteen hex digits; their order is that of the unsigned words."""
    return F.lpad(F.lower(F.hex(_col(h))), 16, "0")


def band_edges(bands: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``bands`` parts of a word."""
    edges = [i * 64 // bands for i in range(bands + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def band_value(h: Column | str, lo: int, width: int) -> Column:
    """``width`` bits of a word from bit ``lo`` on."""
    h = _col(h)
    return h if width == 64 else F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def masks(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` ones, as signed 64-bit values."""
    out = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def n_masks(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))
