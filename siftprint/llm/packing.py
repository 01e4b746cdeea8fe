"""Best-fit packing of documents into training sequences, by hierarchical residual packing.

Every document is encoded, ended by an id and cut into pieces of at most ``length`` ids;
only longer documents are cut.

1. Leaves.  The pieces (without their texts) are dealt over leaves of about ``LEAF`` pieces by
   the hash of their row's place, so that every leaf has the table's mix of lengths however the
   rows are clustered, and repeated rows are spread.  A leaf packs its pieces best fit, largest first.
2. Nearly full sequences (room for at most 1/128 of ``length``) are emitted.
3. The underfull ones are items of the node above, which merges those of ``fan_in`` nodes: each
   is as large as its fill, and they are best-fit into sequences once more, whole.  What is nearly
   full then is emitted, the rest goes up again; the root emits all.

Best fit sees nothing of an item but its size, so a node works on the counts of the sizes
(``plan``): a run of equal sequences takes a run of equal items at a time, and its work and
memory follow ``length`` and ``fan_in``, not the number of items.  A piece finds its place by its
sequence's size and number among those of that size, level by level; only pieces of
underfull sequences take part.  Pieces and places are written at each level, so a task that runs
again meets the same numbers.  The rule is the same at every size; a table of one leaf is its own root.

Edge cases: a null or empty text is a document of the end id alone; a document of
exactly ``length`` ids is one piece; equal sizes are taken in the order of partition and row;
repeated rows are packed once each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, size long, number long"
_MERGED = "node long, size long, c long, starts array<long>, firsts array<long>, eachs array<long>, places array<long>, open_bin array<long>, open_n array<long>, open_size array<long>, open_number array<long>"

#: Pieces of a leaf, about.
LEAF = 100_000
#: Sequences whose room is at most this share of their length are emitted.
NEARLY = 128
#: Documents' text that is encoded at a time, in bytes.
ENCODE_BYTES = 2_000_000


def plan(counts: dict[int, int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, largest first, of so many items of each size.

    A row for each run of items: size, first number, first sequence, items a sequence,
    place of the first in its sequence; by size and number.  And a row for each run of
    sequences that have room: first sequence, how many, their fill; by sequence.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}  # first and number of the bins in a run
    free: list[int] = []  # the rooms, sorted, for which a bin is open
    made, runs = 0, []

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in by_room:
                by_room[left] = []
                free.insert(bisect_left(free, left), left)
            by_room[left].append((first, n))

    for size in sorted(counts, reverse=True):
        done = 0
        while done < counts[size]:
            todo, at = counts[size] - done, bisect_left(free, size)
            if at == len(free):
                r, first, n = room, made, -(-todo // (room // size))
                made += n
            else:
                r = free[at]
                first, n = by_room[r].pop()
                if not by_room[r]:
                    del by_room[r], free[at]
            each = r // size  # a bin that took one is the fullest that takes the next
            full = min(n, todo // each)
            rest = todo - full * each if full < n else 0
            runs.append((size, done, first, each, room - r))
            put(r - each * size, first, full)
            put(r - rest * size, first + full, 1 if rest else 0)
            put(r, first + full + (rest > 0), n - full - (rest > 0))
            done += full * each + rest
    left = sorted((first, n, room - r) for r, own in by_room.items() for first, n in own)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), np.array(left, np.int64).reshape(-1, 3)


def _underfull(left: np.ndarray, most: int) -> np.ndarray:
    """Runs of sequences whose fill is ``most`` at most: first, how many, fill, first number among those of that fill."""
    left = left[left[:, 2] <= most]
    order = np.lexsort((left[:, 0], left[:, 2]))
    own = left[order]
    before = np.cumsum(own[:, 1]) - own[:, 1]
    first = np.searchsorted(own[:, 2], own[:, 2])  # of the same fill
    number = np.empty(len(own), np.int64)
    number[order] = before - before[first]
    return np.column_stack([left, number])


def place(runs: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of pieces by their sizes and their numbers among all of that size."""
    at = np.empty(len(sizes), np.int64)
    for size in np.unique(sizes):
        a, z = np.searchsorted(runs[:, 0], [size, size + 1])
        own = sizes == size
        at[own] = a - 1 + np.searchsorted(runs[a:z, 1], numbers[own], "right")
    _, start, first, each, place = runs[at].T
    k = numbers - start
    return first + k // each, place + k % each * sizes


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Indices of ``sizes`` by bin: best fit, largest first, ties in the given order."""
    counts: dict[int, int] = {}
    numbers = []
    for size in sizes:
        numbers.append(counts.get(size, 0))
        counts[size] = numbers[-1] + 1
    seq, at = place(plan(counts, room)[0], np.array(sizes, np.int64), np.array(numbers, np.int64))
    bins: dict[int, list[int]] = {}
    for i in np.lexsort((at, seq)).tolist():
        bins.setdefault(int(seq[i]), []).append(i)
    return list(bins.values())


def _pieces(path: str, length: int, end_id: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        enc, end = tokens.word_encoder(path), end_id.to_bytes(4, "little")
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
        for batch in batches:
            for b in shared.slices(batch, text_col, ENCODE_BYTES):
                ids, texts = (c.to_pylist() for c in shared.columns(b, id_col, text_col))
                rows = []
                for doc, packed_ids in zip(ids, enc.encode(texts), strict=True):
                    packed_ids += end
                    for k, at in enumerate(range(0, len(packed_ids), 4 * length)):
                        own = packed_ids[at : at + 4 * length]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), part, nth))
                        nth += 1
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_names(_PIECES))

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _numbers(sizes: np.ndarray) -> np.ndarray:
    """Of each item its number among those of its size, in the given order."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    out = np.empty(len(sizes), np.int64)
    out[order] = np.arange(len(sizes)) - np.searchsorted(ordered, ordered)
    return out


def _lookup(open_: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fill and number of sequences by the runs of underfull ones; -1 where a sequence is in none."""
    if not len(open_):
        return np.full(len(bins), -1), np.full(len(bins), -1)
    at = np.searchsorted(open_[:, 0], bins, "right") - 1
    ok = (at >= 0) & (bins < open_[at, 0] + open_[at, 1])
    return np.where(ok, open_[at, 2], -1), np.where(ok, open_[at, 3] + bins - open_[at, 0], -1)


def _pack_leaf(length: int, most: int):
    """Best fit of a leaf's pieces; sequences filled up to ``most`` are underfull."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("nth", "ascending")])
        sizes = group.column("length").to_numpy()
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        runs, left = plan(counts, length)
        bins, at = place(runs, sizes, _numbers(sizes))
        fill, number = _lookup(_underfull(left, most), bins)
        cols = [group.column(c) for c in (*_names(_PIECES)[:5], "node")]
        return pa.table([*cols, *[pa.array(x, pa.int64()) for x in (bins, at, fill, number)]], names=_names(_PLACED))

    return run


def _merge(length: int, most: int):
    """Best fit of the underfull sequences of several nodes, whole: where each node's go (_MERGED)."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("size", "node", "c")), strict=True))
        counts: dict[int, int] = {}
        base = []
        for size, _, n in rows:
            base.append(counts.get(size, 0))
            counts[size] = base[-1] + n
        runs, left = plan(counts, length)
        open_ = _underfull(left, most)
        out = []
        for (size, node, n), first in zip(rows, base, strict=True):
            a, z = np.searchsorted(runs[:, 0], [size, size + 1])
            own = runs[a:z]
            ends = np.append(own[1:, 1], counts[size])
            ends, own = ends[(own[:, 1] < first + n) & (ends > first)], own[(own[:, 1] < first + n) & (ends > first)]
            low = own[:, 2] + (np.maximum(own[:, 1], first) - own[:, 1]) // own[:, 3]
            high = own[:, 2] + (np.minimum(ends, first + n) - 1 - own[:, 1]) // own[:, 3]
            met = np.zeros(len(open_), bool)
            for x, y in zip(low.tolist(), high.tolist(), strict=True):
                met |= (open_[:, 0] <= y) & (open_[:, 0] + open_[:, 1] > x)
            out.append((node, size, n, own[:, 1] - first, own[:, 2], own[:, 3], own[:, 4], *open_[met].T))
        kinds = [*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 8]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(_MERGED))

    return run


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of underfull sequences, with where these go: the pieces' new sequences and places."""
    for b in batches:
        rows = []
        names = ("number", "size", "offset", *_names(_MERGED)[3:])
        for number, size, offset, starts, firsts, eachs, places, *open_ in zip(*(c.to_pylist() for c in shared.columns(b, *names)), strict=True):
            i = bisect_right(starts, number) - 1
            k = number - starts[i]
            to = firsts[i] + k // eachs[i]
            j = bisect_right(open_[0], to) - 1
            held = j >= 0 and to < open_[0][j] + open_[1][j]
            rows.append((to, offset + places[i] + k % eachs[i] * size, open_[2][j] if held else -1, open_[3][j] + to - open_[0][j] if held else -1))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        same = shared.columns(b, *_names(_PIECES)[:5], "parent")
        yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, pa.int64()) for c in cols]], names=_names(_PLACED))


def pack(docs: DataFrame, path: str | None = None, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, leaf: int = LEAF) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there.

    sequence_id is unique for a sequence and otherwise arbitrary (the level that emitted it is
    above bit 60); the places of a sequence are gapless from 0.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = shared.table(docs.mapInArrow(_pieces(path or tokens.word_tokenizer_path(), length, end_id, "doc_id", "text"), _PIECES), "pack")
    nodes = max(1, -(-pieces.count() // leaf))
    nearly = length - length // NEARLY - 1  # the largest fill of an underfull sequence
    dealt = pieces.withColumn("node", F.pmod(F.xxhash64("part", "nth"), F.lit(nodes)))
    placed = shared.table(dealt.groupBy("node").applyInArrow(_pack_leaf(length, nearly if nodes > 1 else -1), _PLACED), "pack-leaf")
    level, out = 0, None
    while True:
        sequence = F.lit(level << 60).bitwiseOR(F.shiftleft("node", 36)).bitwiseOR(F.col("bin"))
        emitted = placed.where("size < 0").select(*_names(SCHEMA)[:5], sequence.alias("sequence_id"), "offset")
        out = emitted if out is None else out.unionByName(emitted)
        if nodes == 1:
            return out
        nodes, level = -(-nodes // fan_in), level + 1
        held = placed.where("size >= 0")
        items = held.groupBy("node", "size").agg((F.max("number") + 1).alias("c"))
        merged = items.groupBy(F.expr(f"node div {fan_in}")).applyInArrow(_merge(length, nearly if nodes > 1 else -1), _MERGED)
        moved = shared.spread_join(held, shared.table(merged, "pack-merge"), ["node", "size"], ["number"])
        placed = shared.table(moved.withColumn("parent", F.expr(f"node div {fan_in}")).mapInArrow(_move, _PLACED), "pack-level")
