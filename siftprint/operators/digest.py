"""Digests of message batches, and what follows from equal digests.

A batch is a frame with an id and a message (string or binary).  Null messages have null
digests; an empty frame gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digest as fn


def digests(messages: DataFrame, message_col: str = "payload", out: str = "digest", binary: bool = False) -> DataFrame:
    """``messages`` with the SHA-256 of each message, in hex or as bytes."""
    return messages.withColumn(out, (fn.sha256_bytes if binary else fn.sha256_hex)(message_col))


def by_blocks(messages: DataFrame, message_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Messages that fit a single block, and the others."""
    size = F.octet_length(F.col(message_col))
    return messages.where(size <= fn.SINGLE_BLOCK), messages.where(size > fn.SINGLE_BLOCK)


def exact_duplicates(messages: DataFrame, id_col: str = "id", message_col: str = "payload", least: int = 2) -> DataFrame:
    """digest, copies and first_id of each message that occurs ``least`` times or more.

    Counts are partial before the shuffle, so a message with many copies costs a row a task.
    """
    d = messages.where(F.col(message_col).isNotNull()).select(F.col(id_col).alias("id"), fn.sha256_hex(message_col).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where(F.col("copies") >= least)


def drop_exact_duplicates(messages: DataFrame, id_col: str = "id", message_col: str = "payload") -> DataFrame:
    """``messages`` without the later copies (by id) of a message; null messages all stay."""
    again = exact_duplicates(messages, id_col, message_col).select(F.col("digest").alias("_digest"), F.col("first_id").alias("_first"))
    d = messages.withColumn("_digest", fn.sha256_hex(message_col)).join(again, "_digest", "left")
    return d.where(F.col("_first").isNull() | (F.col(id_col) == F.col("_first"))).drop("_digest", "_first")
