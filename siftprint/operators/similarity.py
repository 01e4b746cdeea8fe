"""Exact search by Hamming distance over 64-bit hashes.

An index is a frame (id, hash).  Equal hashes are one entry while searching and are
expanded at the end, so copies cost nothing.

``range_join`` cuts words into bands: if two words differ in at most t bits, then in one
of m bands they differ in at most t // m.  The queries' band values are spread to all
values within that distance, and an equi-join on (band, value) finds all candidates, which
are then confirmed.  The number of bands follows the number of hashes: few wide bands for
many hashes, so that lists stay short.  Results of one pair from several bands are kept
from the first of them only, so no distinct is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.hamming import band_edges, band_value, hamming, hash_hex, masks, n_masks

#: Rows of the smaller side up to which the whole side goes to every task.
BROADCAST_ROWS = 100_000
#: Bits by which a search for the nearest goes further out.
STEP = 4
#: Values that one band value is spread to, at most.
SPREAD = 5000


def _check(t: int) -> None:
    if not isinstance(t, int) or t < 0:
        raise InvalidInput(f"a distance is a whole number from 0 on, not {t!r}")


@dataclass(frozen=True)
class Bands:
    """A cut of words into bands, and the distance to look at within each."""

    bands: int
    radius: int

    @classmethod
    def choose(cls, t: int, n_queries: int, n_hashes: int) -> Bands | None:
        """The cut with the least work; None if comparing all is less."""
        _check(t)
        best, least = None, float(n_queries) * n_hashes
        for m in range(1, min(t + 1, 64) + 1):
            width, radius = -(-64 // m), t // m
            if radius >= width or n_masks(width, radius) > SPREAD:
                continue
            probes = m * n_masks(width, radius)
            work = 30.0 * (n_hashes * m + n_queries * probes) + n_queries * probes * n_hashes / 2.0 ** (64 // m)
            if work < least:
                best, least = cls(m, radius), work
        return best

    def entries(self, df: DataFrame, hash_col: str, spread: bool) -> DataFrame:
        """A row for each band (and for each value near the band's, if spread): band, value."""
        rows = []
        for i, (lo, width) in enumerate(band_edges(self.bands)):
            v = band_value(hash_col, lo, width)
            if spread and self.radius:
                near = F.array(*[F.lit(x).cast("long") for x in masks(width, self.radius)])
                values = F.transform(near, v.bitwiseXOR)
            else:
                values = F.array(v)
            rows.append(F.struct(F.lit(i).alias("band"), values.alias("values")))
        d = df.select("*", F.explode(F.array(*rows)).alias("_b"))
        return d.select(*df.columns, F.col("_b.band").alias("band"), F.explode("_b.values").alias("value"))

    @property
    def probes(self) -> int:
        """Values that a query is spread to, over all bands."""
        return sum(n_masks(width, self.radius) for _, width in band_edges(self.bands))

    def first(self, a: Column | str, b: Column | str) -> Column:
        """The first band in which two words are near enough."""
        near = [F.bit_count(band_value(a, lo, w).bitwiseXOR(band_value(b, lo, w))) <= self.radius for lo, w in band_edges(self.bands)]
        return F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(near)])


def _join_hashes(q: DataFrame, h: DataFrame, t: int, method: str) -> DataFrame:
    """q: qh; h: hh; both distinct. qh, hh and distance of all pairs within t."""
    if t == 0:
        return q.join(h, F.col("qh") == F.col("hh")).withColumn("distance", F.lit(0))
    distance = hamming("qh", "hh")
    bands = None
    if method != "brute":
        n_q, n_h = q.count(), h.count()
        bands = Bands.choose(t, n_q, n_h)
        if bands is None and method == "banded":
            bands = Bands(min(t + 1, 64), t // min(t + 1, 64))
    if bands is None:
        return _compare_all(q, h).withColumn("distance", distance).where(F.col("distance") <= t)
    return _banded(q, h, t, bands, n_q, n_h)


def _banded(q: DataFrame, h: DataFrame, t: int, bands: Bands, n_q: int, n_h: int) -> DataFrame:
    """qh, hh and distance of all pairs within t, by an equi-join on bands. n_q, n_h: rows of q and h."""
    return _meet(bands.entries(q, "qh", True), bands.entries(h, "hh", False), t, bands, n_q * bands.probes, n_h * bands.bands)


def _meet(e: DataFrame, f: DataFrame, t: int, bands: Bands, n_e: int, n_f: int) -> DataFrame:
    """qh, hh and distance of all pairs within t whose entries e (spread) and f meet. n_e, n_f: their rows.

    Spark takes an exploded frame to be as large as what it was exploded from, and would broadcast
    tens of millions of entries through the driver. So a side goes to every task only if its rows are few.
    """
    if min(n_e, n_f) > BROADCAST_ROWS:
        f = f.hint("merge")
    elif n_e <= n_f:
        e = F.broadcast(e)
    else:
        f = F.broadcast(f)
    met = e.join(f, ["band", "value"]).withColumn("distance", hamming("qh", "hh"))
    return met.where((F.col("distance") <= t) & (bands.first("qh", "hh") == F.col("band"))).select("qh", "hh", "distance")


def _members(near: DataFrame, q: DataFrame, h: DataFrame) -> DataFrame:
    """Pairs of rows for pairs of hashes. Both joins are shuffled: no index passes through the driver."""
    return near.join(q.hint("merge"), "qh").join(h.hint("merge"), "hh").select("query_id", "match_id", F.col("hh").alias("hash"), "distance")


def _compare_all(q: DataFrame, h: DataFrame) -> DataFrame:
    """All pairs, the queries in blocks that are small enough to go to every task."""
    n = q.count()
    blocks = max(1, -(-n // BROADCAST_ROWS))
    out = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("qh"), F.lit(blocks)) == i)
        pairs = h.join(F.broadcast(part))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def range_join(queries: DataFrame, index: DataFrame, t: int, method: str = "auto") -> DataFrame:
    """All pairs of a query and an index row within ``t`` bits: query_id, match_id, hash, distance.

    queries and index: id, hash.  method: auto, banded or brute; the result is the same.
    """
    _check(t)
    if method not in ("auto", "banded", "brute"):
        raise InvalidInput(f"no method {method!r}")
    q = queries.where("hash IS NOT NULL").select(F.col("id").alias("query_id"), F.col("hash").alias("qh"))
    h = index.where("hash IS NOT NULL").select(F.col("id").alias("match_id"), F.col("hash").alias("hh"))
    return _members(_join_hashes(q.select("qh").distinct(), h.select("hh").distinct(), min(t, 64), method), q, h)


def find(index: DataFrame, query: int, t: int) -> DataFrame:
    """All index rows within ``t`` bits of one word, copies repeated: id, hash, distance."""
    _check(t)
    d = hamming("hash", F.lit(query).cast("long"))
    return index.select("id", "hash", d.alias("distance")).where(F.col("distance") <= t)


def nearest(queries: DataFrame, index: DataFrame, first_t: int = 7) -> DataFrame:
    """For each query the nearest index row: query_id, match_id, hash, distance.

    Of equally near rows the one with the least hash (unsigned), then the least id. A banded
    join within ``first_t`` bits answers the queries that have such a row; the rest is asked
    again ``STEP`` bits further out, for as long as bands are less work than comparing it with
    all distinct hashes.  What is left then is compared; each task keeps the best only.
    """
    _check(first_t)
    q = queries.where("hash IS NOT NULL").select(F.col("id").alias("query_id"), F.col("hash").alias("qh"))
    h = index.where("hash IS NOT NULL").groupBy(F.col("hash").alias("hh")).agg(F.min("id").alias("match_id"))
    qs, hs = q.select("qh").distinct(), h.select("hh")

    def best(pairs: DataFrame) -> DataFrame:
        key = F.struct(hamming("qh", "hh").alias("distance"), hash_hex("hh").alias("hx"), F.col("hh").alias("hh"))
        return pairs.groupBy("qh").agg(F.min(key).alias("b"))

    found, left, t = None, qs, first_t
    n_left, n_hashes = qs.count(), hs.count()
    while n_left and (bands := Bands.choose(t, n_left, n_hashes)):
        near = best(_banded(left, hs, t, bands, n_left, n_hashes)).persist()  # read twice; a row a query
        n_left -= near.count()
        found = near if found is None else found.unionByName(near)
        left = left.join(near, "qh", "left_anti")
        t += STEP
    if n_left or found is None:
        far = best(_compare_all(left, hs))
        found = far if found is None else found.unionByName(far)
    found = found.select("qh", F.col("b.hh").alias("hh"), F.col("b.distance").alias("distance"))
    return q.join(found, "qh").join(h.hint("merge"), "hh").select("query_id", "match_id", F.col("hh").alias("hash"), "distance")


def near_pairs(hashes: DataFrame, t: int, method: str = "auto") -> DataFrame:
    """All pairs of rows within ``t`` bits, each once: id_a < id_b, distance."""
    hits = range_join(hashes, hashes, t, method).where("query_id < match_id")
    return hits.select(F.col("query_id").alias("id_a"), F.col("match_id").alias("id_b"), "distance")


def near_duplicates_of(left: DataFrame, index: DataFrame, t: int, keep_matches: bool = True) -> DataFrame:
    """Rows of ``left`` with (or, with keep_matches=False, without) an index row within ``t`` bits."""
    ids = range_join(left, index, t).select(F.col("query_id").alias("id")).distinct()
    return left.join(ids, "id", "left_semi" if keep_matches else "left_anti")


def distance_matrix(hashes: DataFrame) -> DataFrame:
    """Distances of all ordered pairs of a small set: id_a, id_b, distance."""
    if hashes.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise InvalidInput("a matrix is for a small set; near_pairs is for a large one")
    a = hashes.select(F.col("id").alias("id_a"), F.col("hash").alias("a"))
    b = hashes.select(F.col("id").alias("id_b"), F.col("hash").alias("b"))
    return a.join(F.broadcast(b)).select("id_a", "id_b", hamming("a", "b").alias("distance"))


class HashIndex:
    """An index to search within ``t`` bits: distinct hashes with their ids' count, and band entries to join on.

    ``write`` stores it, ``open`` gives it back; searches of an opened one join the stored entries.
    """

    def __init__(self, hashes: DataFrame, t: int = 5, bands: int | None = None):
        _check(t)
        self.hashes, self.t = hashes.where("hash IS NOT NULL"), t
        m = min(bands or t + 1, 64)
        self.bands = Bands(m, t // m)
        self.stored: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashIndex:
        """The index that ``write`` left at a path."""
        t, bands = spark.read.parquet(f"{path}/about").first()
        out = cls(spark.read.parquet(f"{path}/rows"), t, bands)
        out.stored = spark.read.parquet(f"{path}/entries")
        return out

    def entries(self) -> DataFrame:
        """hash, n, band, value."""
        return self.bands.entries(self.hashes.groupBy("hash").agg(F.count("*").alias("n")), "hash", False)

    def write(self, path: str, buckets: int = 64) -> None:
        """Entries as Parquet, clustered by (band, value), the rows by hash, and how it is cut."""
        self.entries().repartition(buckets, "band", "value").sortWithinPartitions("band", "value").write.mode("overwrite").parquet(f"{path}/entries")
        self.hashes.select("id", "hash").repartitionByRange(buckets, "hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.hashes.sparkSession
        spark.createDataFrame([(self.t, self.bands.bands)], "t int, bands int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    def insert(self, more: DataFrame) -> HashIndex:
        """An index with further rows; equal rows are kept."""
        return HashIndex(self.hashes.unionByName(more.select("id", "hash")), self.t, self.bands.bands)

    def find(self, query: int, t: int) -> DataFrame:
        return find(self.hashes, query, t)

    def find_nearest(self, query: int) -> tuple[int, int] | None:
        """Hash and distance of the nearest row, None if there is none."""
        d = hamming("hash", F.lit(query).cast("long"))
        row = self.hashes.agg(F.min(F.struct(d.alias("d"), hash_hex("hash").alias("x"), "hash")).alias("b")).first()
        return (row.b["hash"], row.b["d"]) if row and row.b else None

    def find_many(self, queries: DataFrame, t: int | None = None) -> DataFrame:
        """What range_join gives, from the stored entries where there are some that reach ``t``."""
        t = self.t if t is None else t
        _check(t)
        if self.stored is None or t > self.t:
            return range_join(queries, self.hashes, t)
        q = queries.where("hash IS NOT NULL").select(F.col("id").alias("query_id"), F.col("hash").alias("qh"))
        qs, f = q.select("qh").distinct(), self.stored.select(F.col("hash").alias("hh"), "band", "value")
        near = _meet(self.bands.entries(qs, "qh", True), f, t, self.bands, qs.count() * self.bands.probes, f.count())
        return _members(near, q, self.hashes.select(F.col("id").alias("match_id"), F.col("hash").alias("hh")))

    def __len__(self) -> int:
        return self.hashes.count()

    def is_empty(self) -> bool:
        return self.hashes.isEmpty()
