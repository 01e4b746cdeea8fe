"""SHA-256 of strings (as UTF-8) and binaries; null for null. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest message that fits one 64-byte block with its padding and length.
SINGLE_BLOCK = 55


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(message: Column | str) -> Column:
    """Digest in lower-case hex."""
    return F.sha2(_col(message).cast("binary"), 256)


def sha256_bytes(message: Column | str) -> Column:
    """Digest as 32 bytes."""
    return F.unhex(sha256_hex(message))


def n_blocks(message: Column | str) -> Column:
    """64-byte blocks that the padded message takes."""
    return ((F.octet_length(_col(message)) + 8) / 64).cast("int") + 1
