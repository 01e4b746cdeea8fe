"""Runs of lines that a corpus repeats, by winnowing over line hashes.

The units are the lines with a word, compared by their words.  A window starts at each
line and reaches just far enough to hold ``min_words`` words.

1. Of each window the place of the least line hash is selected (the last of equal ones); a
   place is emitted once however many windows select it, with the lines of those windows.
   Windows depend on their own lines only, so two places that share a run of ``min_words``
   words or more share a whole window, and select the same line in it: none is missed,
   also where the run is one long line.
2. Selected places with one hash, the fingerprint, meet in a join.
3. A match is extended both ways from the fingerprint: to every window that selected it,
   and from such a window's start as far as a window that ends there takes to hold
   ``min_words`` words.  The first place of each extension, by (doc_id, line), stays; the
   later ones go.  So a place is compared with all earlier ones, not with one: exactly the
   lines go that lie in a run of ``min_words`` words or more which an earlier place has too.
   A line that is common for itself meets many places, but has no extension with them.

Fingerprints and extensions with more than a thousandth of all rows are dealt over tasks.
Every deleted line has an equal one at an earlier place, so that no content is lost from
the corpus.

Edge cases: null, empty and blank texts have no lines and stay as they are; a run that
repeats in its own document is deleted from the second time on, without the part that
overlaps the first; rows with one doc_id and one text are one document and get the same
result; rows without a doc_id stay as they are; a text may become empty; input columns
other than the text pass through, but for those named like the results, which are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words that a repeated run must have to go.
MIN_WORDS = 50

_PLACES = "fp long, doc_id long, th long, at int, start int, hashes array<long>, words array<int>"
_RUNS = "fp long, run long, doc_id long, th long, first int, last int"
RESULTS = ["n_lines", "n_removed_lines", "n_removed_words"]


def units(text: str | None) -> tuple[list[int], list[int], list[int], list[str]]:
    """Hash, number of words and line number of each line with a word, and all lines."""
    lines = text.split("\n") if text else []
    at, words, hashes = [], [], []
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            at.append(i)
            words.append(len(w))
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(w)) >> 1)
    return hashes, words, at, lines


def windows(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """First and last unit of each window."""
    last, total = -1, 0
    for first in range(len(words)):
        while total < least:
            last += 1
            if last == len(words):
                return
            total += words[last]
        yield first, last
        total -= words[first]


def selected(hashes: list[int], words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Of each window its first and last unit and the selected one: the last of the least hashes."""
    rising: deque[int] = deque()  # units of a window from the selected one on, by hash
    done = 0
    for first, last in windows(words, least):
        while done <= last:
            while rising and hashes[rising[-1]] >= hashes[done]:
                rising.pop()
            rising.append(done)
            done += 1
        while rising[0] < first:
            rising.popleft()
        yield first, last, rising[0]


def extensions(hashes: list[int], words: list[int], least: int) -> dict[int, list[tuple[int, int]]]:
    """First and last unit of each extension, by the selected unit."""
    out: dict[int, list[tuple[int, int]]] = {}
    selects, ends = {}, {}
    for first, last, at in selected(hashes, words, least):
        out.setdefault(at, []).append((first, last))
        selects[first], ends[first] = at, last
    start, total = 0, 0
    for last in range(len(words)):
        total += words[last]
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least and ends[start] != last:  # the shortest run that ends here
            out[selects[start]].append((start, last))
    return out


def _places(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.slices(batch, "text", 8_000_000):
                rows: list[tuple] = []
                for doc, th, text in zip(*(c.to_pylist() for c in shared.columns(b, "doc_id", "th", "text")), strict=True):
                    hashes, words, _, _ = units(text)
                    if sum(words) < least:
                        continue
                    for at, runs in extensions(hashes, words, least).items():
                        lo, hi = min(x for x, _ in runs), max(y for _, y in runs) + 1
                        rows.append((hashes[at], doc, th, at, lo, hashes[lo:hi], words[lo:hi]))
                yield _batch(rows, _PLACES)

    return run


def _extend(least: int):
    """A row for each extension of a place; its lines are all that it depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for fp, doc, th, at, lo, hashes, words in zip(*(c.to_pylist() for c in shared.columns(b, *_names(_PLACES))), strict=True):
                packed = np.array(hashes, np.int64)
                for i, j in extensions(hashes, words, least).get(at - lo, ()):
                    rows.append((fp, xxhash.xxh3_64_intdigest(packed[i : j + 1].tobytes()) >> 1, doc, th, lo + i, lo + j))
            yield _batch(rows, _RUNS)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = _names(schema)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs: doc_id, th, text. A row for each selected place (_PLACES)."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_places(min_words), _PLACES)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs: doc_id, th, text. doc_id, th and the spans of units to delete (array of first, last)."""
    places = shared.table(fingerprints(docs, min_words), "line-places")
    again = shared.table(places.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1"), "line-again")
    met = shared.spread_join(places, again, ["fp"], ["doc_id", "at"])
    runs = shared.table(met.mapInArrow(_extend(min_words), _RUNS), "line-runs")
    shared.drop_table(places)
    first = runs.groupBy("fp", "run").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "first", "last")).alias("a")).where("c > 1")
    m = shared.spread_join(runs, shared.table(first, "line-first"), ["fp", "run"], ["doc_id", "first"])
    same_doc = (F.col("doc_id") == F.col("a.doc_id")) & (F.col("th") == F.col("a.th"))
    m = m.where(~(same_doc & (F.col("first") == F.col("a.first"))))
    start = F.when(same_doc, F.greatest(F.col("first"), F.col("a.last") + 1)).otherwise(F.col("first"))
    m = m.select("doc_id", "th", start.alias("first"), "last").where("first <= last")
    return m.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[str | None, int, int, int]:
    """The text without the spans of units, and the lines that it had, and lines and words removed."""
    hashes, words, at, lines = units(text)
    drop = np.zeros(len(at) + 1, int)
    for a, z in spans:
        drop[a] += 1
        drop[z + 1] -= 1
    inside = np.cumsum(drop[:-1]) > 0
    if not inside.any():
        return text, len(at), 0, 0
    gone = np.zeros(len(lines), bool)
    for k in np.flatnonzero(inside):
        gone[at[k]] = True
        if k and inside[k - 1]:  # blank lines within a run go with it
            gone[at[k - 1] : at[k]] = True
    kept = "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)
    return kept, len(at), int(inside.sum()), int(np.array(words)[inside].sum())


def _rewrite(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.slices(batch, "text", 8_000_000):
                texts, spans = (c.to_pylist() for c in shared.columns(b, "text", "spans"))
                out = [cut(t, [(s["first"], s["last"]) for s in x or ()]) for t, x in zip(texts, spans, strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([shared.columns(b, "rest")[0], pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from the text, and what was deleted (RESULTS)."""
    own = [c for c in docs.columns if c not in RESULTS]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in own if c != text_col])
    d = docs.select(rest.alias("rest"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(d.select("doc_id", "th", "text"), min_words)
    met = d.join(spans, ["doc_id", "th"], "left").select("rest", "text", "spans")
    kind = met.schema["rest"].dataType.simpleString()
    out = met.mapInArrow(_rewrite(["rest", "text", *RESULTS]), f"rest {kind}, text string, n_lines long, n_removed_lines long, n_removed_words long")
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in own], *RESULTS)
