"""Batches from values in memory, and values from batches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput


def messages(spark: SparkSession, payloads: Iterable[bytes | str | None]) -> DataFrame:
    """A message batch: id (the place), payload."""
    rows = [(i, p.encode() if isinstance(p, str) else p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id bigint, payload binary")


def images(spark: SparkSession, pixels: Sequence[bytes], sizes: Sequence[tuple[int, int]]) -> DataFrame:
    """An image batch: id (the place), width, height, pixels."""
    if len(pixels) != len(sizes):
        raise InvalidInput(f"{len(pixels)} images but {len(sizes)} sizes")
    rows = [(i, w, h, bytes(p)) for i, (p, (w, h)) in enumerate(zip(pixels, sizes, strict=True))]
    return spark.createDataFrame(rows, "id bigint, width int, height int, pixels binary")


def hashes(spark: SparkSession, words: Iterable[int]) -> DataFrame:
    """An index: id (the place), hash. Words may be unsigned."""
    return spark.createDataFrame([(i, signed(w)) for i, w in enumerate(words)], "id bigint, hash bigint")


def signed(word: int) -> int:
    """An unsigned 64-bit word as the BIGINT of the same bits."""
    if not -(1 << 63) <= word < 1 << 64:
        raise InvalidInput(f"{word} has more than 64 bits")
    return word - (1 << 64) if word >> 63 > 0 else word


def unsigned(word: int) -> int:
    return word & (1 << 64) - 1


def overwrite(data: Column | str, offset: int, new: bytes) -> Column:
    """Binary values with ``new`` in place of the bytes from ``offset`` (0-based) on."""
    data = F.col(data) if isinstance(data, str) else data
    return F.overlay(data, F.lit(new), offset + 1)


def to_lists(df: DataFrame) -> dict[str, list]:
    """All columns of a small frame, through Arrow."""
    return df.toArrow().to_pydict()


def report(title: str, checks: Iterable[tuple[str, bool]], seconds: Iterable[tuple[str, float]] = ()) -> str:
    """Passed and failed checks, and times, as Markdown tables."""
    out = [f"# {title}", "", "| check | result |", "|---|---|"]
    out += [f"| {name} | {'passed' if ok else 'failed'} |" for name, ok in checks]
    times = [f"| {name} | {s * 1000:.1f} |" for name, s in seconds]
    return "\n".join(out + (["", "| step | ms |", "|---|---|", *times] if times else [])) + "\n"
