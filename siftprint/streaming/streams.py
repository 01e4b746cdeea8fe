"""Fingerprints over streams. An extension: the operators are row-wise, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.digest import digests
from ..operators.phash import PHashConfig, phash
from ..operators.similarity import HashIndex, range_join


def stream_digests(messages: DataFrame, message_col: str = "payload", out: str = "digest") -> DataFrame:
    """A stream of messages with their digests."""
    return digests(messages, message_col, out)


def stream_phash(images: DataFrame, config: PHashConfig | None = None) -> DataFrame:
    """A stream of images with their hashes."""
    return phash(images, config)


def match_stream(hashes: DataFrame, index: DataFrame | HashIndex, t: int, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives ``sink`` the matches (see range_join) of each micro-batch in a stored index.

    hashes, index: id, hash; or an index, of which an opened one is searched as stored.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(index.find_many(batch, t) if isinstance(index, HashIndex) else range_join(batch, index, t), number)

    return hashes.writeStream.foreachBatch(each)
