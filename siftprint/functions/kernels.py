"""Vectorised user kernels: NumPy functions under names, as columns or whole-frame maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput

_registered: dict[str, Callable[..., Column]] = {}


def register_kernel(name: str, fn: Callable[..., object], returns: str) -> Callable[..., Column]:
    """Make ``fn`` of one NumPy array for each input column a column function, and keep it under ``name``.

    fn gets whole Arrow batches and gives back one value a row.
    """
    if not name or not callable(fn):
        raise InvalidInput("a kernel needs a name and a function")

    def call(*series: pd.Series) -> pd.Series:
        return pd.Series(list(fn(*[s.to_numpy() for s in series])), dtype=None if len(series[0]) else object)

    call.__annotations__ = {"series": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(call, returnType=returns)
    _registered[name] = lambda *cols: udf(*cols)
    return _registered[name]


def kernel(name: str) -> Callable[..., Column]:
    if name not in _registered:
        raise InvalidInput(f"no kernel {name!r} is registered")
    return _registered[name]


def clear_kernels() -> None:
    _registered.clear()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` of each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def as_arrays(binary: pd.Series) -> list[np.ndarray | None]:
    """Each value's bytes as an array, without a copy; None for null."""
    return [None if b is None else np.frombuffer(b, np.uint8) for b in binary]
