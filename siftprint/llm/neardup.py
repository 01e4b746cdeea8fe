"""Near-duplicate documents by bottom-k sketches of word shingles.

A document's set holds its distinct shingles of five lower-cased (A-Z) words; with
fewer words, the whole sequence; without words it is empty and links with nothing.
Documents are linked when 100 * |A & B| >= 75 * |A | B|; every link is confirmed on
the full sets, and a document's class is its connected component.

1. One hash function orders all shingles; a document retains its ``K`` least values.
   Equal sets are one node from here on.
2. Overlaps by inverted lists.  Two linked sketches have at least a share of the larger
   one's values in common: ``ESTIMATE`` (a pair at 0.75 falls below that with probability 1e-7), or
   0.75 where a partner's sketch must be its whole set.  So in any one order of all values they share
   one of the first s - ceil(share * s) + 1, where s is a sketch's size.  The order is by how many nodes retain a value, then by value, and a
   node posts its values of that prefix: one rule for all nodes, however frequent their
   values are, and rare values make short lists.
3. The members of a list of up to ``PAIRS`` nodes are candidates of each other.  Where
   sizes allow a link, the sketch of the union (all values up to the lesser of both sketches'
   last) estimates the similarity; what reaches ``ESTIMATE`` is confirmed on the full sets.
4. A longer list gives no pairs.  Its members are dealt out in blocks of bounded size, and a
   task for each block estimates and confirms as above but gives back a spanning forest of the
   links: members of one component are not compared.
   * First each node goes to the lists of its ``FIRST`` least long values only, as in
     min-hashing: that gathers most of a group of copies, with bytes linear in its sets.
   * Then the lists whose members are in one component, or all of which are in one other
     list, are done.  The members of the rest, mostly texts that share a common passage, post
     once more, from wider sketches (``WIDE`` values), whose prefix is shorter, and in the
     order of how many of them retain a value.  Short lists give pairs as above.  In each long one
     with several components every member outside of the largest is compared with
     all others, so that no link between two components is missed.  Lists of about one length with one
     largest component, as a group of copies has many, are one: a set goes there once.

Edge cases: null, empty and blank texts have n_shingles 0 and are their own class;
rows with words that share a doc_id are one node, with all their sets; a null doc_id belongs to
no class and is kept; texts may be of any length; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

WORDS = 5
K = 64
ESTIMATE = 0.45
WIDE = 512
WIDE_ESTIMATE = 0.65
#: A list of so many nodes gives pairs.  A candidate moves two sketches and a list's member moves its
#: set FIRST times; at 350 shingles that is as much for lists of about this size.
PAIRS = 12
#: Long lists that a node goes to at first.
FIRST = 2
#: Nodes that a block's others are compared with at first.
FIRST_PIVOTS = 24
#: Shingles in a block of a long list.
BLOCK = 500_000

_HASH = xxhash.xxh3_64_intdigest
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text as ascending hashes of 63 bits."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_HASH, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    x = np.full(n, min(len(w), words), np.uint64)
    for i in range(min(words, len(w))):
        x = _mix((x + h[i : i + n]) * _STEP)
    return np.unique((x >> np.uint64(1)).astype(np.int64))


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64()))


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.slices(batch, "text", 4_000_000):
                ids, texts = shared.columns(b, "doc_id", "text")
                sets = [shingles(t, words) for t in texts.to_pylist()]
                keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), _arrays([s[:k] for s in sets])], names=["doc_id", "n", "key", "sketch"])

    return run


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node and set of the documents of a table of ids; a node may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.slices(batch, "text", 4_000_000):
                own, texts = shared.columns(b, "doc_id", "text")
                sets = [shingles(t, words) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([own, pa.array([_HASH(s.tobytes()) >> 1 for s in sets], pa.int64()), _arrays(sets)], names=["node", "sid", "set"])

    # ids are written, so their size is known: they go to every task only if they are few
    own = docs.join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return shared.table(own.mapInArrow(run, "node long, sid long, set array<long>").where("size(set) > 0").dropDuplicates(["node", "sid"]), "near-sets")


def forest(nodes: list[int], sets: list[np.ndarray], percent: int, comps: list[int] | None = None, pivots: list[int] | None = None, k: int = K, most: int | None = None) -> list[tuple[int, int]]:
    """Links between the nodes' components, each confirmed on the sets: enough to join all that are linked.

    comps: the components so far; without them each node is its own.  pivots: the places of
    the nodes to compare with all others of other components; without them, a few pivots
    gather a core, and then every node outside the largest component is one (``most`` of
    them, for a first pass), so that no link between components is missed and pairs inside the core
    are not compared.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    heads = [s[:k] for s in sets]  # a set ascends, so this is its sketch
    values, ids = np.unique(np.concatenate(heads), return_inverse=True)
    ends = np.cumsum([len(h) for h in heads])
    lengths = np.array([len(h) for h in heads])
    starts = ends - lengths
    top = np.array([ids[e - 1] if len(s) >= k else len(values) for s, e in zip(sets, ends, strict=True)])  # known up to this value
    comp = np.unique(np.array(nodes if comps is None else comps), return_inverse=True)[1]
    count = np.bincount(comp, minlength=n)
    mark = np.zeros(len(values), np.int32)
    out: list[tuple[int, int]] = []

    def pivot(p: int) -> None:
        own = ids[starts[p] : ends[p]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        theirs = lengths if top[p] == len(values) else np.add.reduceat((ids <= top[p]).astype(np.int32), starts)
        union = theirs + np.searchsorted(own, top, "right") - both
        able = (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])) & (both >= ESTIMATE * union)
        for q in np.flatnonzero(able & (comp != comp[p])).tolist():
            if comp[q] == comp[p]:
                continue
            shared_ = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * shared_ >= percent * (sizes[p] + sizes[q] - shared_):
                out.append((nodes[p], nodes[q]))
                old, new = (comp[q], comp[p]) if count[comp[q]] <= count[comp[p]] else (comp[p], comp[q])
                count[new] += count[old]
                comp[comp == old] = new

    if pivots is not None:
        for p in pivots:
            pivot(p)
        return out
    first = sorted({i * n // 8 for i in range(8)})
    for p in first:
        pivot(p)
    for p in range(n):
        if comp[p] != np.argmax(count) and p not in first:
            if most is not None and (most := most - 1) < 0:
                break
            pivot(p)
    return out


def _links_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _block_links(percent: int, k: int):
    """The forest of a block; with column comp the components so far, and outside the nodes to compare."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names = group.schema.names
        told = "outside" in names
        by: dict[tuple[int, int], int] = {}  # a set once
        outside: set[tuple[int, int]] = set()
        for i, x in enumerate(zip(group.column("node").to_pylist(), group.column("sid").to_pylist(), strict=True)):
            by[x] = i
            if told and group.column("outside")[i].as_py():
                outside.add(x)
        order = sorted(by)
        if len(order) < 2:
            return _links_table([])
        lists = group.column("set")
        sets = [lists[by[x]].values.to_numpy() for x in order]
        if not told:
            return _links_table(forest([x for x, _ in order], sets, percent, k=k, most=FIRST_PIVOTS))
        comps = group.column("comp")
        return _links_table(forest([x for x, _ in order], sets, percent, [comps[by[x]].as_py() for x in order], [i for i, x in enumerate(order) if x in outside], k))

    return run


def _postings(nodes: DataFrame, k: int, estimate: float, percent: int) -> DataFrame:
    """v, node, n and the posted value before: the prefix of each node's sketch, of values that others have too."""
    values = nodes.select("node", "sid", "n", F.explode("sketch").alias("v"))
    often = shared.table(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").withColumn("often", F.col("c")), "near-often")
    own = shared.spread_join(values, often, ["v"], ["node"]).groupBy("node", "sid", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("own"))
    # values that no other node has come first: they fill the prefix but need no posting
    least = f"CASE WHEN 100 * n <= {percent} * {k} THEN ceil({percent} * n / 100) ELSE ceil({estimate} * least(n, {k})) END"
    prefix = F.expr(f"CAST(greatest(0, size(own) - {least} + 1) AS INT)")
    own = own.withColumn("own", F.slice("own", F.lit(1), prefix))
    return own.select("node", "n", F.posexplode("own").alias("i", "o"), "own").select("node", "n", F.col("o.v").alias("v"), F.when(F.col("i") > 0, F.get(F.col("own"), F.col("i") - 1)["v"]).alias("before"))


def _lists(postings: DataFrame) -> DataFrame:
    """v and its members' number c. within: all members have one value before it, so its list is part of that one's."""
    lists = postings.groupBy("v").agg(F.count("*").alias("c"), F.count("before").alias("befores"), F.min("before").alias("low"), F.max("before").alias("high")).where("c > 1")
    return shared.table(lists.select("v", "c", ((F.col("befores") == F.col("c")) & F.coalesce(F.col("low") == F.col("high"), F.lit(False))).alias("within")), "near-lists")


def _long(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """v, node, n: the members of long lists."""
    long_ = shared.table(lists.where((F.col("c") > PAIRS) & ~F.col("within")).select("v", "c"), "near-long")
    return shared.table(shared.spread_join(postings.select("v", "node", "n"), long_, ["v"], ["node"]), "near-members")


def _short(postings: DataFrame, lists: DataFrame) -> DataFrame:
    return postings.join(lists.where(F.col("c") <= PAIRS).select("v"), "v", "left_semi")


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """postings: v, node, n; lists of bounded length. Pairs a < b of members whose sizes allow a link."""
    p = postings.select("v", F.col("node").alias("a"), F.col("n").alias("n_a"))
    q = postings.select("v", F.col("node").alias("b"), F.col("n").alias("n_b"))
    met = p.join(q, "v").where(f"a < b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return met.select("a", "b").distinct()


def _estimated(cand: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Of candidate pairs those whose union's sketch says that they may be linked."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    est = cand.join(side("a"), "a").join(side("b"), "b")
    top = lambda x: F.when(F.col(f"n_{x}") > k, F.element_at(f"s_{x}", -1)).otherwise(F.lit(2**63 - 1))
    est = est.withColumn("top", F.least(top("a"), top("b")))
    union = F.size(F.filter(F.array_union("s_a", "s_b"), lambda v: v <= F.col("top")))
    return est.where(F.size(F.array_intersect("s_a", "s_b")) >= ESTIMATE * union).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs those that are linked."""
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("s_b")), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return full.where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def _blocks(total: str) -> Column:
    return F.expr(f"CAST(({total} + {BLOCK} - 1) div {BLOCK} AS INT)")


def _first_links(members: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Links that span the components of each block of the nodes' first long lists."""
    own = members.groupBy("node").agg(F.max("n").alias("n"), F.slice(F.sort_array(F.collect_set("v")), 1, FIRST).alias("vs"))
    own = shared.table(own.select("node", "n", F.explode("vs").alias("v")), "near-first")
    lists = shared.table(own.groupBy("v").agg(F.count("*").alias("c"), _blocks("sum(n)").alias("blocks")).where("c > 1"), "near-first-lists")
    rows = shared.spread_join(own, lists, ["v"], ["node"]).withColumn("block", F.expr("pmod(xxhash64(node, v), blocks)"))
    return rows.select("v", "block", "node").join(sets, "node").groupBy("v", "block").applyInArrow(_block_links(percent, k), "a long, b long")


def _open(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of long lists with their components, and the lists with several."""
    m = shared.table(members.join(comp, "node", "left").select("v", "node", "n", F.coalesce("component", "node").alias("comp")), "near-members")
    of = m.groupBy("v", "comp").agg(F.count("*").alias("c"))
    lists = of.groupBy("v").agg(F.sum("c").alias("c"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"))
    lists = lists.where("comps > 1").select("v", "c", F.col("top.comp").alias("core"), F.floor(F.log(4.0, "c")).cast("int").alias("length"))
    return m, shared.table(lists, "near-open-lists")


def _last_links(m: DataFrame, lists: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Links between components that meet in a long list."""
    on = ["core", "length"]
    met = shared.spread_join(m, lists, ["v"], ["node"]).groupBy(*on, "node", "comp").agg(F.max("n").alias("n"))
    met = shared.table(met, "near-open")
    sizes = met.groupBy(*on).agg(F.count("*").alias("c"), _blocks("sum(n)").alias("blocks"), _blocks("8 * sum(CASE WHEN comp <> core THEN n ELSE 0 END)").alias("chunks"))
    met = shared.spread_join(met, shared.table(sizes, "near-open-sizes"), on, ["node"])
    here = lambda n: F.expr(f"CAST(pmod(xxhash64(node, core), {n}) AS INT)")
    out = met.where("comp <> core").select(*on, here("chunks").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "node", "comp", F.lit(True).alias("outside"))
    rest = met.select(*on, F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), here("blocks").alias("block"), "node", "comp", F.lit(False).alias("outside"))
    rows = out.unionByName(rest).join(sets, "node")
    return rows.groupBy(*on, "chunk", "block").applyInArrow(_block_links(percent, k), "a long, b long")


def _wide_links(ids: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """All links between components of the given nodes, but for those within a component."""
    sketch = F.slice("set", 1, WIDE)
    wide = sets.join(shared.table(ids, "near-open-ids"), "node", "left_semi").select("node", "sid", F.size("set").cast("long").alias("n"), sketch.alias("sketch"))
    postings = shared.table(_postings(wide, WIDE, WIDE_ESTIMATE, percent), "near-wide")
    lists, out = _lists(postings), []
    side = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    pairs = _pairs(_short(postings, lists), percent).join(side("a"), "a", "left").join(side("b"), "b", "left")
    pairs = shared.table(pairs.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"), "near-wide-pairs")
    if not pairs.isEmpty():
        out.append(shared.table(_confirmed(pairs, sets, percent), "near-links"))
    m, lists = _open(_long(postings, lists), comp)
    if not lists.isEmpty():
        out.append(shared.table(_last_links(m, lists, sets, percent, K), "near-links"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the class) and kept (the one with that id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = shared.table(docs.mapInArrow(_sketches(words, k), "doc_id long, n long, key string, sketch array<long>"), "near-rows")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = real.groupBy("key", "n").agg(F.count("*").alias("c"), F.min("doc_id").alias("node"), F.min_by("sketch", "doc_id").alias("sketch"))
    nodes = shared.table(nodes.withColumn("sid", F.xxhash64("key")), "near-nodes")

    postings = shared.table(_postings(nodes, k, ESTIMATE, percent), "near-postings")
    lists = _lists(postings)
    pairs = shared.table(_estimated(_pairs(_short(postings, lists), percent), nodes, k), "near-pairs")
    members = _long(postings, lists)
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    sets = _full_sets(docs.where("doc_id IS NOT NULL"), shared.table(ids, "near-ids"), words)

    # rows of one doc_id with several sets are one node
    several = real.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    same = real.join(several, "doc_id", "left_semi").join(nodes, ["key", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # written one by one: else a task would run several Python workers
    links = shared.table(_confirmed(pairs, sets, percent).unionByName(same), "near-links")
    links = links.unionByName(shared.table(_first_links(members, sets, percent, k), "near-links"))
    comp = components(links, "near-components")
    members, lists = _open(members, comp)
    if not lists.isEmpty():
        more = _wide_links(members.join(lists.select("v"), "v", "left_semi").select("node").distinct(), comp, sets, percent)
        if more:
            known = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = components(reduce(DataFrame.unionByName, more, known), "near-components")
    classes = nodes.join(comp, "node", "left").select("key", "n", "c", F.coalesce("component", "node").alias("component"))
    out = shared.spread_join(rows.select("doc_id", "n", "key"), shared.table(classes, "near-classes"), ["key", "n"], ["doc_id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
