"""Several batches in one action: frames are submitted, and run together when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidInput


class BatchBuilder:
    """Frames of one schema, in order of submission."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def submit(self, df: DataFrame) -> int:
        """Add a frame, without running it; its number."""
        if self._frames and df.columns != self._frames[0].columns:
            raise InvalidInput("the frames of a builder have the same columns")
        self._frames.append(df)
        return len(self._frames) - 1

    def pending_count(self) -> int:
        return len(self._frames)

    def clear(self) -> None:
        self._frames.clear()

    def union(self) -> DataFrame | None:
        """All rows, with their frame's number as ``batch_id``; None without frames."""
        out = None
        for i, df in enumerate(self._frames):
            tagged = df.select(F.lit(i).alias("batch_id"), "*")
            out = tagged if out is None else out.unionByName(tagged)
        return out

    def wait_all(self) -> list[list[Row]]:
        """Run all frames in one action and forget them; the rows of each. For results that fit the driver."""
        df, n = self.union(), len(self._frames)
        self.clear()
        out: list[list[Row]] = [[] for _ in range(n)]
        if df is not None:
            names = df.columns[1:]
            for r in df.collect():
                out[r["batch_id"]].append(Row(**{c: r[c] for c in names}))
        return out
