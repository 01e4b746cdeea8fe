import hashlib

import pytest
from pyspark.sql import functions as F

from siftprint import InvalidInput
from siftprint.functions.digest import n_blocks, sha256_bytes
from siftprint.operators.batch import BatchBuilder
from siftprint.operators.digest import by_blocks, digests, drop_exact_duplicates, exact_duplicates
from siftprint.sources import frames

LENGTHS = [0, 1, 55, 56, 57, 63, 64, 65, 119, 120, 1024, 10_000]
KNOWN = {b"": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", b"abc": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}


def test_known_and_boundaries(spark):
    messages = [*KNOWN, *[bytes([i % 256]) * n for i, n in enumerate(LENGTHS)], None]
    rows = digests(frames.messages(spark, messages)).orderBy("id").collect()
    assert [r.digest for r in rows] == [hashlib.sha256(m).hexdigest() if m is not None else None for m in messages]
    assert [r.digest for r in rows[:2]] == list(KNOWN.values())


def test_bytes_blocks_and_empty(spark):
    df = frames.messages(spark, [b"x" * n for n in LENGTHS])
    for r in df.select("payload", sha256_bytes("payload").alias("d"), n_blocks("payload").alias("n")).collect():
        assert bytes(r.d) == hashlib.sha256(r.payload).digest() and r.n == (len(r.payload) + 8) // 64 + 1
    short, long_ = by_blocks(df)
    assert short.count() == 3 and long_.count() == len(LENGTHS) - 3
    assert digests(df.where("false")).count() == 0


def test_stays_in_the_jvm(spark, small):
    plan = digests(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "digest")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_duplicates(spark):
    df = frames.messages(spark, ["a", "b", "a", None, "a", None, ""])
    got = {(r.digest, r.copies, r.first_id) for r in exact_duplicates(df).collect()}
    assert got == {(hashlib.sha256(b"a").hexdigest(), 3, 0)}
    assert sorted(r.id for r in drop_exact_duplicates(df).collect()) == [0, 1, 3, 5, 6]


def test_builder(spark):
    b = BatchBuilder()
    assert b.union() is None and b.wait_all() == []
    for part in (["a", "b"], [], ["c"]):
        b.submit(digests(frames.messages(spark, part)).select("id", "digest"))
    assert b.pending_count() == 3
    got = b.wait_all()
    assert [[r.digest for r in sorted(x)] for x in got] == [[hashlib.sha256(m).hexdigest() for m in x] for x in ([b"a", b"b"], [], [b"c"])]
    assert b.pending_count() == 0
    b.submit(spark.range(1))
    with pytest.raises(InvalidInput):
        b.submit(spark.range(1).select(F.col("id").alias("other")))
    b.clear()
    assert b.pending_count() == 0


def test_frames(spark):
    assert frames.signed((1 << 64) - 1) == -1 and frames.unsigned(-1) == (1 << 64) - 1
    with pytest.raises(InvalidInput):
        frames.signed(1 << 64)
    with pytest.raises(InvalidInput):
        frames.images(spark, [b"x"], [])
    df = frames.messages(spark, [b"abcdef"]).select(frames.overwrite("payload", 2, b"XY").alias("p"))
    assert bytes(df.first().p) == b"abXYef"
    assert frames.to_lists(frames.hashes(spark, [1, (1 << 64) - 1]))["hash"] == [1, -1]
    text = frames.report("Run", [("digest", True), ("hash", False)], [("all", 0.0123)])
    assert "| digest | passed |" in text and "| hash | failed |" in text and "| all | 12.3 |" in text
