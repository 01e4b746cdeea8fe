"""A query for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import sha256_hex
from ..functions.hamming import hamming
from ..operators import digest, phash, similarity
from ..operators.batch import BatchBuilder
from ..session import bound_batches
from ..streaming.streams import stream_digests
from . import fixtures
from .fixtures import table

Query = Callable[[SparkSession, str], DataFrame]


def sha256_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sha256_hex("text").alias("digest"))


def sha256_hex_pages(spark, sf_dir):
    return digest.digests(table(spark, sf_dir, "pages"), "html").select("page_id", "digest")


def sha256_short(spark, sf_dir):
    short, _ = digest.by_blocks(table(spark, sf_dir, "documents"), "text")
    return digest.digests(short, "text").select("doc_id", "digest")


def sha256_long(spark, sf_dir):
    _, long_ = digest.by_blocks(table(spark, sf_dir, "documents"), "text")
    return digest.digests(long_, "text").select("doc_id", "digest")


def sha256_batched(spark, sf_dir):
    batches = BatchBuilder()
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text")):
        t = table(spark, sf_dir, name)
        batches.submit(t.select(F.col(key).cast("long").alias("row_id"), sha256_hex(text).alias("digest")))
    return batches.union()


def exact_dup_groups(spark, sf_dir):
    return digest.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def exact_dedup(spark, sf_dir):
    return digest.drop_exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id")


def stream_sha256(spark, sf_dir):
    """The digests of a stream of the documents' files, run until it has caught up."""
    static = table(spark, sf_dir, "documents")
    # a file source watches folders or patterns
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parque*")
    out = f"{fixtures.work_folder(spark)}/stream-sha256-{uuid.uuid4().hex}"
    digests = stream_digests(stream, "text").select("doc_id", "digest")
    digests.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(digests.schema).parquet(f"{out}/rows")


def _hash(algorithm: str, side: int = 8) -> Query:
    def run(spark, sf_dir):
        h = phash.phash(fixtures.documents(spark, sf_dir), algorithm=algorithm, hash_size=side)
        if side == 8:
            return h.select(F.col("id").alias("doc_id"), F.col("hash64").alias("hash"))
        return h.select(F.col("id").alias("doc_id"), F.posexplode("hash").alias("word", "hash"))

    return run


def _native(algorithm: str) -> Query:
    def run(spark, sf_dir):
        if algorithm in ("mean", "median", "block"):
            grids = fixtures.embedding_grids(spark, sf_dir)
        else:
            w, h = phash.PHashConfig(algorithm).target_size
            grids = phash.resize(fixtures.documents(spark, sf_dir), w, h).select("id", phash.to_grid().alias("p"))
        return phash.phash_grid(grids, algorithm).select("id", "hash")

    return run


def phash_block_16to8(spark, sf_dir):
    """Images of 16 by 16, hashed as they are: true block means."""
    images = phash.resize(fixtures.documents(spark, sf_dir), 16, 16)
    return phash.phash_resized(images, algorithm="block").select(F.col("id").alias("doc_id"), F.col("hash64").alias("hash"))


def resize_box_16(spark, sf_dir):
    r = phash.resize(fixtures.documents(spark, sf_dir), 16, 16)
    return r.select(F.col("id").alias("doc_id"), F.lower(F.hex("pixels")).alias("pixels"))


def resize_box_16to8(spark, sf_dir):
    r = phash.resize(phash.resize(fixtures.documents(spark, sf_dir), 16, 16), 8, 8)
    return r.select(F.col("id").alias("doc_id"), F.lower(F.hex("pixels")).alias("pixels"))


def pixel_histogram(spark, sf_dir):
    h = phash.histogram(phash.resize(fixtures.documents(spark, sf_dir), 16, 16))
    return h.select(F.col("id").alias("doc_id"), "value", "n")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' hashes, kept: a search reads them several times, 16 bytes a row."""
    return phash.phash(fixtures.documents(spark, sf_dir)).select("id", F.col("hash64").alias("hash")).persist()


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fixtures.text_images(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return phash.phash(images).select("id", F.col("hash64").alias("hash")).persist()


def hamming_pairs(spark, sf_dir):
    """How far each document's mean and median hashes are apart."""
    bound_batches(spark)
    images = fixtures.documents(spark, sf_dir)
    h = images.select("id", phash.phash_column(phash.PHashConfig("mean"))[0].alias("a"), phash.phash_column(phash.PHashConfig("median"))[0].alias("b"))
    return h.select(F.col("id").alias("doc_id"), hamming("a", "b").alias("distance"))


def hash_index_bands(spark, sf_dir):
    return similarity.HashIndex(_index(spark, sf_dir), 5).entries().select("hash", "n", "band", "value")


def hash_index_stored(spark, sf_dir):
    """An index that is written, opened and searched: queries are the documents whose id is divisible by 100."""
    hashes = _index(spark, sf_dir)
    path = f"{fixtures.work_folder(spark)}/hash-index-{uuid.uuid4().hex}"
    similarity.HashIndex(hashes, 5).write(path)
    return similarity.HashIndex.open(spark, path).find_many(hashes.where("id % 100 = 0"))


def hash_index_len(spark, sf_dir):
    return _index(spark, sf_dir).agg(F.count("hash").alias("n"))


def hamming_find(spark, sf_dir):
    """All documents near the one word whose every other bit is set."""
    return similarity.find(_index(spark, sf_dir), 0x5555555555555555, 28).select(F.col("id").alias("doc_id"), "hash", "distance")


def hamming_find_multi(spark, sf_dir):
    """Queries: every document whose id is divisible by 100."""
    index = _index(spark, sf_dir)
    return similarity.range_join(index.where("id % 100 = 0"), index, 8)


def hamming_find_brute(spark, sf_dir):
    index = _index(spark, sf_dir)
    return similarity.range_join(index.where("id % 100 = 0"), index, 8, "brute")


def hamming_nearest(spark, sf_dir):
    """The document that is nearest to each benchmark item."""
    return similarity.nearest(_benchmark(spark, sf_dir), _index(spark, sf_dir)).select(F.col("query_id").alias("item_id"), F.col("match_id").alias("doc_id"), "hash", "distance")


def hamming_matrix(spark, sf_dir):
    images = fixtures.text_images(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    return similarity.distance_matrix(phash.phash(images).select("id", F.col("hash64").alias("hash")))


def near_dup_pairs(spark, sf_dir):
    """Flagship: documents whose mean hashes differ in at most 5 bits."""
    return similarity.near_pairs(_index(spark, sf_dir), 5)


def near_dup_free(spark, sf_dir):
    """Benchmark items without a document within 10 bits."""
    return similarity.near_duplicates_of(_benchmark(spark, sf_dir), _index(spark, sf_dir), 10, False).select(F.col("id").alias("item_id"))


def queries() -> dict[str, Query]:
    plain = (sha256_documents, sha256_short, sha256_long, sha256_batched, exact_dup_groups, exact_dedup, stream_sha256, phash_block_16to8, resize_box_16, resize_box_16to8, pixel_histogram, hamming_pairs, hash_index_bands, hash_index_stored, hash_index_len, hamming_find, hamming_find_multi, hamming_find_brute, hamming_nearest, hamming_matrix, near_dup_pairs, near_dup_free)
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out["sha256_hex"] = sha256_hex_pages
    for a in phash.ALGORITHMS:
        out[f"phash_{a}_8"] = _hash(a)
        out[f"phash_{a}_8_native"] = _native(a)
    for a in ("mean", "median", "block", "gradient", "vert_gradient", "double_gradient"):
        out[f"phash_{a}_16"] = _hash(a, 16)
    return out
