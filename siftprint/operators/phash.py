"""Perceptual hashes of image batches.

An image batch is a frame (id, width, height, pixels): gray, a byte a pixel, row by row.
Images may differ in size.  Null pixels have a null hash.  Rows whose pixels don't match
their size are an error, or null with ``strict=False``.  Resizing and hashing are one step
per Arrow batch, over all images of one size at a time, so no resized pixels are written.
Batches are bounded by bytes: rows alone don't bound what a worker holds of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions import phash_native, pixels
from ..session import bound_batches

ALGORITHMS = tuple(pixels.KERNELS)
#: Pixels of a stack of images, about.
STACK = 1 << 20


@dataclass(frozen=True)
class PHashConfig:
    """How to hash: the algorithm, the side (side * side bits), and whether to resize first."""

    algorithm: str = "mean"
    hash_size: int = 8
    resize: bool = True
    strict: bool = True

    def __post_init__(self) -> None:
        pixels.target_size(self.algorithm, self.hash_size)

    @classmethod
    def from_bits(cls, algorithm: str, bits: int) -> PHashConfig:
        """By the number of bits: 64 or 256. 128 is no square of a side."""
        if bits not in (64, 256):
            raise InvalidInput("bits are 64 or 256; other sizes by hash_size")
        return cls(algorithm, 8 if bits == 64 else 16)

    @property
    def target_size(self) -> tuple[int, int]:
        return pixels.target_size(self.algorithm, self.hash_size)

    @property
    def n_words(self) -> int:
        return pixels.n_words(self.hash_size)


def _by_size(width: pd.Series, height: pd.Series, data: pd.Series, strict: bool, fn: Callable[[np.ndarray], object]) -> pd.Series:
    """``fn`` of stacks of images of one size; its results by row."""
    out: list[object] = [None] * len(data)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (w, h, d) in enumerate(zip(width, height, data, strict=True)):
        if d is None or pd.isna(w) or pd.isna(h):
            continue
        if w <= 0 or h <= 0 or len(d) != w * h:
            if strict:
                raise InvalidInput(f"{len(d)} pixels are not {w} by {h}")
            continue
        groups.setdefault((int(w), int(h)), []).append(i)
    for (w, h), rows in groups.items():
        most = max(1, STACK // (w * h))
        for at in range(0, len(rows), most):
            part = rows[at : at + most]
            stack = np.frombuffer(b"".join(bytes(data.iloc[i]) for i in part), np.uint8).reshape(len(part), h, w)
            for i, v in zip(part, fn(stack), strict=True):
                out[i] = v
    return pd.Series(out, dtype=object)


def phash_column(config: PHashConfig, width: Column | str = "width", height: Column | str = "height", data: Column | str = "pixels") -> Column:
    """The hash's words (array of BIGINT, low word first) of each image.  For a session with bounded batches."""
    w, h = config.target_size

    @F.pandas_udf("array<bigint>")
    def run(ws: pd.Series, hs: pd.Series, ds: pd.Series) -> pd.Series:
        def words(stack: np.ndarray) -> np.ndarray:
            if config.resize:
                stack = pixels.resize_box(stack, w, h)
            return pixels.hash_words(stack, config.algorithm, config.hash_size)

        return _by_size(ws, hs, ds, config.strict, words)

    return run(width, height, data)


def resize_column(width: int, height: int, strict: bool = True, w: Column | str = "width", h: Column | str = "height", data: Column | str = "pixels") -> Column:
    """Box-filtered pixels (binary) of a given size.  For a session with bounded batches."""
    if width < 1 or height < 1:
        raise InvalidInput("a target has at least one pixel")

    @F.pandas_udf("binary")
    def run(ws: pd.Series, hs: pd.Series, ds: pd.Series) -> pd.Series:
        return _by_size(ws, hs, ds, strict, lambda stack: [x.tobytes() for x in pixels.resize_box(stack, width, height)])

    return run(w, h, data)


def phash(images: DataFrame, config: PHashConfig | None = None, out: str = "hash", **more: object) -> DataFrame:
    """``images`` with the hash of each: its words, and with 64 bits the word as ``<out>64``.

    more: fields of PHashConfig, in place of config.
    """
    config = config or PHashConfig(**more)
    bound_batches(images.sparkSession)
    df = images.withColumn(out, phash_column(config))
    return df.withColumn(f"{out}64", F.col(out)[0]) if config.n_words == 1 else df


def phash_resized(images: DataFrame, config: PHashConfig | None = None, out: str = "hash", **more: object) -> DataFrame:
    """Hashes of images as they are: a larger image has true block means, and more rows to compare."""
    config = config or PHashConfig(**more)
    return phash(images, PHashConfig(config.algorithm, config.hash_size, False, config.strict), out)


def phash_grid(grids: DataFrame, algorithm: str, grid_col: str = "p", out: str = "hash") -> DataFrame:
    """64-bit hashes of small grids (arrays of target size for side 8) without leaving the JVM."""
    if algorithm not in phash_native.NATIVE:
        raise InvalidInput(f"no algorithm {algorithm!r}")
    return grids.withColumn(out, F.when(F.col(grid_col).isNotNull(), phash_native.NATIVE[algorithm](F.col(grid_col))))


def resize(images: DataFrame, width: int, height: int, strict: bool = True) -> DataFrame:
    """``images`` at one size."""
    bound_batches(images.sparkSession)
    return images.withColumn("pixels", resize_column(width, height, strict)).withColumns({"width": F.lit(width), "height": F.lit(height)})


def square(images: DataFrame, data_col: str = "pixels") -> DataFrame:
    """Width and height of square images that have pixels only; other lengths are an error when they are hashed."""
    side = F.floor(F.sqrt(F.octet_length(data_col))).cast("int")
    return images.withColumns({"width": side, "height": side})


def to_grid(data: Column | str = "pixels") -> Column:
    """Pixels as an array of integers."""
    hx = F.hex(F.col(data) if isinstance(data, str) else data)
    return F.transform(F.regexp_extract_all(hx, F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def histogram(images: DataFrame, id_col: str = "id", data_col: str = "pixels") -> DataFrame:
    """Pixels of each value that an image has: id, value, n.  Counted image by image: no pixel becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values, counts = [], [], []
            for i, data in enumerate(b.column(1)):
                n = np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256) if data.is_valid and len(data.as_buffer()) else np.zeros(256, np.int64)
                at = np.flatnonzero(n)
                rows.append(np.full(len(at), i))
                values.append(at)
                counts.append(n[at])
            flat = [pa.array(np.concatenate(x) if x else np.empty(0), t) for x, t in ((rows, pa.int64()), (values, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(flat[0]), *flat[1:]], names=["id", "value", "n"])

    ids = images.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, value int, n long")
