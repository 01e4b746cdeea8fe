"""Connected components of an edge table, for graphs of any size.

A task first replaces its edges (``EDGES``, about) by a spanning forest.  Then large-star and
small-star steps alternate until every component is a star around its smallest node.
The edges of a step are written to the shared folder; the driver sees one flag a step only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Edges that a task joins to a forest at first.
EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool, what: str) -> tuple[DataFrame, DataFrame]:
    """edges: u > v. Each node's neighbours are pointed at the least of them and itself.

    Also gives the table that the result reads.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = shared.table(both.groupBy("u").agg(F.count("*").alias("c"), F.min("v").alias("m")).select("u", "c", F.least("u", "m").alias("m")), f"{what}-least")
    met = shared.spread_join(both, least, ["u"], ["v"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct(), least


def _stars(edges: DataFrame) -> bool:
    """Whether each node is a leaf of one star, or the middle of one.  No step parts what is connected, so that is the end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("middle")).where("up > 1 OR (up = 1 AND middle = 0)").isEmpty()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """edges: columns a and b, long, cheap to read. node and component (its least node) of each node that is not the least."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    tasks = max(1, -(-e.count() // EDGES))
    e = shared.table(e.coalesce(tasks).mapInArrow(_forest, "u long, v long"), what)
    while not _stars(e):
        across, a = _star(e, True, what)
        down, b = _star(across, False, what)
        done, e = e, shared.table(down, what)
        for t in (done, a, b):
            shared.drop_table(t)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
