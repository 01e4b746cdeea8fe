import random
import struct
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftprint import InvalidInput
from siftprint.functions import kernels, phash_native, pixels
from siftprint.operators import phash
from siftprint.session import BATCH_BYTES
from siftprint.sources import frames, images

from . import oracle

SIDES = (1, 2, 8, 9, 16, 32, 33, 64)


def stack_of(p, w, h):
    return np.array(p, np.uint8).reshape(1, h, w)


@pytest.mark.parametrize("algorithm", phash.ALGORITHMS)
@pytest.mark.parametrize("side", SIDES)
def test_kernels(algorithm, side):
    w, h = pixels.target_size(algorithm, side)
    for p in (oracle.lcg(w * h, side), [0] * (w * h), [255] * (w * h), [i % 256 for i in range(w * h)]):
        assert pixels.hash_words(stack_of(p, w, h), algorithm, side)[0].tolist() == oracle.words(algorithm, p, w, h, side)


@pytest.mark.parametrize("algorithm", phash.ALGORITHMS)
def test_other_grids_than_the_target(algorithm):
    rng = random.Random(1)
    for _ in range(20):
        w, h = rng.randint(8, 40), rng.randint(8, 40)
        p = oracle.lcg(w * h, rng.randrange(10**6))
        assert pixels.hash_words(stack_of(p, w, h), algorithm, 8)[0].tolist() == oracle.words(algorithm, p, w, h, 8)


@given(st.integers(1, 60), st.integers(1, 60), st.integers(1, 40), st.integers(1, 40), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_resize(w, h, tw, th, seed):
    p = oracle.lcg(w * h, seed)
    got = pixels.resize_box(stack_of(p, w, h), tw, th)[0]
    assert got.reshape(-1).tolist() == oracle.resize(p, w, h, tw, th)
    assert (w, h) != (tw, th) or got.reshape(-1).tolist() == p


@pytest.mark.parametrize("src,dst", [(45, 33), (78, 33), (10, 8), (100, 9), (3, 8), (130, 65)])
def test_resize_where_rounding_matters(src, dst):
    p = oracle.lcg(src * src, src)
    assert pixels.resize_box(stack_of(p, src, src), dst, dst)[0].reshape(-1).tolist() == oracle.resize(p, src, src, dst, dst)


def batch(spark, n=40, seed=3):
    rng = random.Random(seed)
    sizes = [(rng.choice([3, 8, 9, 16, 40, 45]), rng.choice([3, 8, 9, 16, 40])) for _ in range(n)]
    data = [bytes(oracle.lcg(w * h, i)) for i, (w, h) in enumerate(sizes)]
    return frames.images(spark, data, sizes), data, sizes


@pytest.mark.parametrize("algorithm", phash.ALGORITHMS)
@pytest.mark.parametrize("side", (8, 16))
def test_frames_of_mixed_sizes(spark, algorithm, side):
    df, data, sizes = batch(spark)
    got = phash.phash(df, algorithm=algorithm, hash_size=side).orderBy("id").collect()
    tw, th = pixels.target_size(algorithm, side)
    want = [oracle.words(algorithm, oracle.resize(d, w, h, tw, th), tw, th, side) for d, (w, h) in zip(data, sizes, strict=True)]
    assert [list(r.hash) for r in got] == want
    if side == 8:
        assert [r.hash64 for r in got] == [w[0] for w in want]


@pytest.mark.parametrize("algorithm", phash.ALGORITHMS)
def test_native_is_the_kernel(spark, algorithm):
    w, h = pixels.target_size(algorithm, 8)
    grids = [oracle.lcg(w * h, i) for i in range(40)] + [[v] * (w * h) for v in (0, 7, 255)] + [[i % 256 for i in range(w * h)], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(grids)], "id int, p array<int>")
    out = phash.phash_grid(df, algorithm)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r.id: r.hash for r in out.collect()}
    assert got == {i: None if p is None else oracle.words(algorithm, p, w, h, 8)[0] for i, p in enumerate(grids)}


def test_native_block_means(spark):
    p = oracle.lcg(256, 5)
    df = spark.createDataFrame([(p,)], "p array<int>").select(phash_native.block(F.col("p"), 16).alias("h"))
    assert df.first().h == oracle.words("block", p, 16, 16, 8)[0]
    resized = phash.phash_resized(frames.images(spark, [bytes(p)], [(16, 16)]), algorithm="block").first()
    assert resized.hash64 == df.first().h


def test_nulls_empties_and_errors(spark):
    df = spark.createDataFrame([(0, 2, 2, b"abcd"), (1, 2, 2, None), (2, None, 2, b"abcd"), (3, 2, 2, b"abc")], "id bigint, width int, height int, pixels binary")
    got = {r.id: r.hash for r in phash.phash(df, strict=False).collect()}
    assert got[0] is not None and got[1] is got[2] is got[3] is None
    with pytest.raises(Exception, match="are not 2 by 2"):
        phash.phash(df).collect()
    assert phash.phash(df.where("false")).count() == 0
    for bad in (dict(hash_size=0), dict(hash_size=65), dict(algorithm="other")):
        with pytest.raises(InvalidInput):
            phash.PHashConfig(**bad)
    with pytest.raises(InvalidInput):
        phash.PHashConfig.from_bits("mean", 128)
    assert phash.PHashConfig.from_bits("mean", 256).hash_size == 16
    with pytest.raises(InvalidInput):
        pixels.hash_words(np.zeros((1, 4, 4), np.uint8), "block", 8)
    with pytest.raises(InvalidInput):
        phash.resize_column(0, 1)


def test_memory_is_bounded(spark):
    own = spark.newSession()  # as a caller's: without session()'s bound of rows
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = own.range(3000, numPartitions=1).selectExpr("id", "50 AS width", "100 AS height", "CAST(repeat(concat('w', id % 7, ' '), 2000) AS BINARY) AS pixels").selectExpr("id", "width", "height", "substring(pixels, 1, 5000) AS pixels")

    @F.pandas_udf("bigint")
    def held(d: pd.Series) -> pd.Series:
        return pd.Series([sum(map(len, d))] * len(d))

    for make in (phash.phash, lambda x: phash.resize(x, 8, 8)):
        own.conf.unset(key)
        make(df)
        assert int(own.conf.get(key)) == BATCH_BYTES
        r = df.select(held("pixels").alias("n")).agg(F.max("n"), F.count("n")).first()
        assert r[1] == 3000 and r[0] < 1.5 * BATCH_BYTES  # of 15 MB
    own.conf.set(key, "12345")
    phash.phash(df)
    assert own.conf.get(key) == "12345"  # a bound of the caller's stays


@pytest.mark.parametrize("name", ["hash_index_bands", "hash_index_len", "hamming_pairs", "resize_box_16", "pixel_histogram", "phash_block_16"])
def test_queries_bound_their_batches(spark, small, name):
    from siftprint.plans import queries

    own = spark.newSession()
    queries.queries()[name](own, small)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == str(BATCH_BYTES)


def test_stacks_are_bounded():
    seen = []
    n = 3 * phash.STACK // 10_000
    data = pd.Series([bytes([i % 256]) * 10_000 for i in range(n)])
    out = phash._by_size(pd.Series([100] * n), pd.Series([100] * n), data, True, lambda stack: seen.append(stack.size) or stack[:, 0, 0].tolist())
    assert out.tolist() == [i % 256 for i in range(n)] and max(seen) <= phash.STACK


def test_resize_keeps_no_wide_number_a_pixel():
    stack = np.zeros((1, 2000, 1000), np.uint8)
    tracemalloc.start()
    pixels.resize_box(stack, 8, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < stack.size


def test_square_resize_histogram(spark):
    p = bytes(oracle.lcg(81, 2))
    df = phash.square(spark.createDataFrame([(1, p)], "id bigint, pixels binary"))
    small = phash.resize(df, 4, 4)
    r = small.first()
    assert (r.width, r.height) == (4, 4) and list(r.pixels) == oracle.resize(p, 9, 9, 4, 4)
    got = {x.value: x.n for x in phash.histogram(df).collect()}
    assert got == {v: p.count(v) for v in set(p)}
    assert df.select(phash.to_grid().alias("g")).first().g == list(p)


def test_gray_and_lanczos():
    rgb = np.zeros((2, 2, 3), np.uint8)
    rgb[0, 0] = (10, 20, 30)
    assert pixels.to_gray(rgb, "RGB")[0, 0] == (2126 * 10 + 7152 * 20 + 722 * 30) // 10000
    assert pixels.to_gray(rgb, "BGR")[0, 0] == (2126 * 30 + 7152 * 20 + 722 * 10) // 10000
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (pixels.resize_lanczos(flat, 8, 8) == 77).all()
    ramp = np.tile(np.arange(0, 240, 4, dtype=np.uint8), (10, 1))
    out = pixels.resize_lanczos(ramp, 12, 5).astype(int)
    assert (np.diff(out, axis=1) > 0).all() and out.shape == (5, 12)
    assert pixels.resize_lanczos(ramp, 60, 10) is ramp


def png(path, rows):
    """rows: lists of (r, g, b)."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in r for v in px) for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    rng = random.Random(1)
    pictures = {"a.png": 20, "deep/B.PNG": 12}
    data = {n: [[tuple(rng.randrange(256) for _ in range(3)) for _ in range(s)] for _ in range(s)] for n, s in pictures.items()}
    for n, rows in data.items():
        png(tmp_path / n, rows)
    (tmp_path / "broken.png").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_text("no picture")
    gray = images.to_gray(images.read_images(spark, f"file://{tmp_path}"))
    got = {r.path.split(f"{tmp_path.name}/")[1]: r for r in gray.collect()}
    assert got.keys() == pictures.keys()
    for n, s in pictures.items():
        want = [(2126 * r + 7152 * g + 722 * b) // 10000 for row in data[n] for r, g, b in row]
        assert (got[n].width, got[n].height) == (s, s) and list(got[n].pixels) == want
    hashed = phash.phash(images.to_gray(images.read_images(spark, f"file://{tmp_path}"), (8, 8))).collect()
    assert len(hashed) == 2 and all(r.width == 8 and r.hash64 is not None for r in hashed)


def test_custom_kernels(spark):
    total = kernels.register_kernel("total", lambda data: [None if d is None else sum(d) for d in data], "bigint")
    df = frames.messages(spark, [b"\1\2", b"", None])
    assert [r.t for r in df.orderBy("id").select(total("payload").alias("t")).collect()] == [3, 0, None]
    assert kernels.kernel("total") is total
    out = kernels.map_batches(df.select("id"), lambda b: b, "id bigint")
    assert out.count() == 3
    kernels.clear_kernels()
    with pytest.raises(InvalidInput):
        kernels.kernel("total")
    with pytest.raises(InvalidInput):
        kernels.register_kernel("", None, "int")
