import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftprint import InvalidInput
from siftprint.functions.hamming import band_edges, band_value, hamming, hamming_wide, hash_hex, masks, n_masks
from siftprint.operators import similarity
from siftprint.sources import frames
from siftprint.streaming import streams

from . import oracle


def clustered(seed, clusters=12, each=10):
    rng, out = random.Random(seed), []
    for _ in range(clusters):
        base = rng.getrandbits(64)
        for _ in range(each):
            h = base
            for _ in range(rng.randint(0, 5)):
                h ^= 1 << rng.randrange(64)
            out.append(frames.signed(h))
    return out + [0, -1, -(1 << 63), out[0], out[0]]


def brute(queries, hashes, t):
    return sorted((i, j, h, d) for i, q in enumerate(queries) for j, h in enumerate(hashes) if (d := oracle.hamming(q, h)) <= t)


@pytest.mark.parametrize("t", [0, 1, 3, 5, 8, 12, 20, 64])
@pytest.mark.parametrize("method", ["auto", "banded", "brute"])
def test_range_join(spark, t, method):
    hashes = clustered(t, 6, 6)
    queries = hashes[::7] + [5, -7]
    got = sorted(map(tuple, similarity.range_join(frames.hashes(spark, queries), frames.hashes(spark, hashes), t, method).collect()))
    assert got == brute(queries, hashes, t)


@pytest.mark.parametrize("bands,t", [(1, 2), (2, 5), (3, 5), (4, 11), (6, 5), (11, 10)])
def test_any_cut_is_exact(spark, monkeypatch, bands, t):
    monkeypatch.setattr(similarity.Bands, "choose", classmethod(lambda cls, *a: cls(bands, t // bands)))
    hashes = clustered(bands, 8, 8)
    got = sorted(map(tuple, similarity.range_join(frames.hashes(spark, hashes[:9]), frames.hashes(spark, hashes), t).collect()))
    assert got == brute(hashes[:9], hashes, t)


def test_choice_follows_size():
    choose = similarity.Bands.choose
    assert choose(5, 10, 10) is None  # comparing all is less work
    few, many = choose(5, 10**5, 10**5), choose(5, 10**9, 10**9)
    assert few.bands > many.bands and many.radius >= 1
    assert choose(40, 10**6, 10**6) is None


@given(st.integers(1, 64), st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=60, deadline=None)
def test_edges_cover(bands, h):
    edges = band_edges(bands)
    assert edges[0][0] == 0 and sum(w for _, w in edges) == 64
    assert all(a + w == b for (a, w), (b, _) in zip(edges, edges[1:], strict=False))


def test_masks():
    assert len(masks(16, 2)) == n_masks(16, 2) == 1 + 16 + 120 == len(set(masks(16, 2)))
    assert -(1 << 63) in masks(64, 1)


def test_distances(spark):
    df = spark.createDataFrame([(0, -1, [1, 2], [3, 2]), (5, 5, [0], [0, 0]), (-(1 << 63), 0, [-1], [0])], "a bigint, b bigint, x array<bigint>, y array<bigint>")
    rows = df.select(hamming("a", "b").alias("d"), hamming_wide("x", "y").alias("w"), hash_hex("a").alias("h"), band_value("a", 60, 4).alias("v")).collect()
    assert [(r.d, r.w, r.h, r.v) for r in rows] == [(64, 1, "0" * 16, 0), (0, None, "0" * 15 + "5", 0), (1, 64, "8" + "0" * 15, 8)]


def test_nearest(spark):
    hashes = clustered(3)
    queries = [h ^ 3 for h in hashes[:10]] + [random.Random(9).getrandbits(63) for _ in range(10)]
    got = {r.query_id: (r.match_id, r.hash, r.distance) for r in similarity.nearest(frames.hashes(spark, queries), frames.hashes(spark, hashes)).collect()}
    for i, q in enumerate(queries):
        d, _, j = min((oracle.hamming(q, h), frames.unsigned(h), j) for j, h in enumerate(hashes))
        assert got[i] == (j, hashes[j], d)
    assert similarity.nearest(frames.hashes(spark, queries), frames.hashes(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("last", [3, 11, 19])
def test_nearest_further_out(spark, monkeypatch, last):
    monkeypatch.setattr(similarity.Bands, "choose", classmethod(lambda cls, t, q, h: cls(t + 1, 0) if t <= last else None))
    hashes = clustered(4)
    rng = random.Random(last)
    queries = [h ^ (2**n - 1) for n, h in enumerate(hashes[:30])] + [frames.signed(rng.getrandbits(64)) for _ in range(5)]
    got = {r.query_id: (r.match_id, r.hash, r.distance) for r in similarity.nearest(frames.hashes(spark, queries), frames.hashes(spark, hashes), 3).collect()}
    want = [min((oracle.hamming(q, h), frames.unsigned(h), j) for j, h in enumerate(hashes)) for q in queries]
    assert got == {i: (j, hashes[j], d) for i, (d, _, j) in enumerate(want)}


def test_nearest_plan_of_many(spark):
    df = spark.range(100_000).select("id", F.xxhash64("id").alias("hash"))
    near = similarity.nearest(df.where("id % 10 = 0").select("id", F.col("hash").bitwiseXOR(F.lit(0x3F0)).alias("hash")), df)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert near.where("query_id = match_id AND distance = 6").count() == 10_000


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 7)
    hashes = clustered(4, 4, 6)
    got = sorted(map(tuple, similarity.range_join(frames.hashes(spark, hashes), frames.hashes(spark, hashes), 9, "brute").collect()))
    assert got == brute(hashes, hashes, 9)


def test_pairs_and_semi_joins(spark):
    hashes = clustered(5, 5, 5)
    df = frames.hashes(spark, hashes)
    got = sorted(map(tuple, similarity.near_pairs(df, 6).collect()))
    assert got == sorted((i, j, d) for i, j, _, d in brute(hashes, hashes, 6) if i < j)
    queries = frames.hashes(spark, [hashes[0] ^ 1, 12345])
    assert [r.id for r in similarity.near_duplicates_of(queries, df, 3).collect()] == [0]
    assert [r.id for r in similarity.near_duplicates_of(queries, df, 3, False).collect()] == [1]
    m = similarity.distance_matrix(df.limit(6))
    assert m.count() == 36 and all(r.distance == oracle.hamming(hashes[r.id_a], hashes[r.id_b]) for r in m.collect())


def test_index(spark, tmp_path):
    hashes = [0, 1, 0x11, (1 << 64) - 1, 42, 42]
    index = similarity.HashIndex(frames.hashes(spark, hashes), 5)
    assert len(index) == 6 and not index.is_empty()
    assert sorted((r.hash, r.distance) for r in index.find(0, 1).collect()) == [(0, 0), (1, 1)]
    assert sum(r.hash == 42 for r in index.find(42, 0).collect()) == 2  # copies are kept
    assert index.find_nearest(0x10) == (0, 1) and index.find_nearest(-2) == (-1, 1)
    assert index.insert(frames.hashes(spark, [7])).find(7, 0).count() == 1
    assert index.find_many(frames.hashes(spark, [40])).count() == len(brute([40], [frames.signed(h) for h in hashes], 5))
    index.write(str(tmp_path / "index"), 2)
    assert spark.read.parquet(str(tmp_path / "index" / "entries")).count() == 5 * 6
    again = similarity.HashIndex.open(spark, str(tmp_path / "index"))
    assert len(again) == 6 and again.t == 5 and again.find_nearest(0x10) == (0, 1)
    signed = [frames.signed(h) for h in hashes]
    for t in (0, 3, 5, 9):  # within what is stored, and beyond
        queries = [0, 40, 42, signed[3] ^ 7]
        assert sorted(map(tuple, again.find_many(frames.hashes(spark, queries), t).collect())) == brute(queries, signed, t)
    plan = again.find_many(frames.hashes(spark, [40]))._jdf.queryExecution().optimizedPlan().toString()
    assert "entries" in again.stored.inputFiles()[0] and "band" in plan and "Cross" not in plan
    none = similarity.HashIndex(frames.hashes(spark, [1]).where("false"))
    assert none.is_empty() and none.find_nearest(1) is None
    for bad in (-1, 1.5):
        with pytest.raises(InvalidInput):
            similarity.find(frames.hashes(spark, [1]), 1, bad)
    with pytest.raises(InvalidInput):
        similarity.range_join(frames.hashes(spark, [1]), frames.hashes(spark, [1]), 1, "other")


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id bigint, hash bigint")
    assert [tuple(r) for r in similarity.range_join(df, df, 2).collect()] == [(2, 2, 5, 0)]


def test_plan_has_no_pairwise_join(spark):
    df = spark.range(100_000).select("id", F.xxhash64("id").alias("hash"))
    plan = similarity.near_pairs(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entries_are_not_broadcast(spark):
    df = spark.range(100_000).select("id", F.xxhash64("id").alias("hash"))
    one = spark.range(1).select("id", F.lit(5).cast("bigint").alias("hash"))
    for found in (similarity.near_pairs(df, 5), similarity.range_join(df, df, 8), similarity.nearest(df.where("id % 10 = 0"), df).drop("hash")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if "band#" in x and "Join" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)
    plan = similarity.range_join(one, df, 5, "banded")._jdf.queryExecution().executedPlan().toString()
    assert any("BroadcastHashJoin" in x and "band#" in x for x in plan.splitlines())  # few rows still go to every task


@pytest.mark.parametrize("rows", [0, 200, 10**6])
def test_broadcast_or_not_is_exact(spark, monkeypatch, tmp_path, rows):
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", rows)
    hashes = clustered(7, 8, 8)
    queries, index = frames.hashes(spark, hashes[:9]), frames.hashes(spark, hashes)
    assert sorted(map(tuple, similarity.range_join(queries, index, 6, "banded").collect())) == brute(hashes[:9], hashes, 6)
    similarity.HashIndex(index, 5).write(str(tmp_path / "index"), 2)
    assert sorted(map(tuple, similarity.HashIndex.open(spark, str(tmp_path / "index")).find_many(queries).collect())) == brute(hashes[:9], hashes, 5)


def test_stream(spark, tmp_path):
    hashes = clustered(6, 3, 4)
    frames.hashes(spark, hashes).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, hash bigint").parquet(str(tmp_path / "in"))
    got = []
    q = streams.match_stream(stream, frames.hashes(spark, hashes[:3]), 4, lambda df, n: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == brute(hashes, hashes[:3], 4)
