"""Language of documents by fusing Bayesian evidence.

Text: a naive Bayes model over hashed triples of letters' bytes gives a log-likelihood
of the whole text per language.  It is fitted on web pages, labelled by the ``lang`` of their
``<html>`` tag: on at most ``SAMPLE`` of them, those whose id hashes least, with their whole texts.
Without labelled pages it is fitted on the documents' own declared languages.

Prior evidence comes from grouped aggregation over all documents and all pages, with the text
model's own decisions as counts, less that of the row itself:
* how often documents of a language declare each markup language (not used where the
  model was fitted on these, as a label would count twice),
* how often documents and pages of a language have each address suffix,
* the languages of each host, smoothed towards its parent domain, which is smoothed
  towards the whole corpus, with ``STRENGTH`` pseudo-documents at each step.

All add up in logarithms; the posterior's maximum is the language.  A document is
rejected if it has no letters, if no language reaches the probability ``certain``, or if
no language explains its text.  A language explains a text whose mean log-likelihood a
triple lies above the middle between two means: that of labelled texts under a model
fitted without them (the sample is cut in two for that), and that of triples which no
language has.  This doesn't depend on the text's size.

The counts are written before they are joined, so that they go to every task only if they are
small; keys that many rows share are dealt over tasks, and so are rows without the key.

Edge cases: null and empty texts have no letters, get the prior's language and are
rejected; texts of fewer than ``FIT_TRIPLES`` triples (a name or two) are too short to
ask whether they are explained; a language with labelled texts in one half of the sample only
explains all that it is the likeliest of; without a declared language, suffix or host that
evidence is left out; every language of the sample has a model (of 256 KB), others are not known;
with no declared language anywhere there is nothing to fit, the language is null and nothing
with letters is rejected; equal posteriors go to the first language by name; repeated
rows count once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows that the text model is fitted on, at most.
SAMPLE = 4000
SLOTS = 1 << 16
STRENGTH = 50.0
#: Neighbouring triples overlap; this share of their log-likelihood counts.
WEIGHT = 1 / 3
#: Triples from which on a text must be explained by a language.
FIT_TRIPLES = 20

_LOW = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)), np.uint8)


def triples(data: bytes) -> np.ndarray:
    """Slots of the triples of bytes, with letters lower-cased and all else a blank."""
    x = _LOW[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    t = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    t = t[(x[:-2] != 32).astype(int) + (x[1:-1] != 32) + (x[2:] != 32) > 1]
    return (t * np.uint32(2654435761)) >> np.uint32(16)


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.I | re.S)
_LANG = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)"


def _bytes(text: str | None, markup: bool) -> bytes:
    """The UTF-8 of a text, or of what a reader of markup sees."""
    return (html.unescape(_HIDDEN.sub(" ", text)) if markup and text else text or "").encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], dict[int, int]] = {}
    for b in batches:
        for *key, text, page in zip(*(c.to_pylist() for c in shared.columns(b, "declared", "half", "text", "page")), strict=True):
            at, n = np.unique(triples(_bytes(text, page)), return_counts=True)
            own = total.setdefault(tuple(key), {})
            for x, y in zip(at.tolist(), n.tolist(), strict=True):
                own[x] = own.get(x, 0) + y
    langs, halves, slots, counts = [], [], [], []
    for (lang, half), c in total.items():
        langs += [lang] * len(c)
        halves += [half] * len(c)
        slots.append(np.fromiter(c.keys(), np.int64))
        counts.append(np.fromiter(c.values(), np.int64))
    join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(halves, pa.int32()), join(slots), join(counts)], names=["declared", "half", "slot", "n"])


def _log_p(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the slots from their counts by language."""
    base = counts.sum(0) + 0.01
    table = counts + 20 * base / base.sum() * np.minimum(1, base)  # unseen slots lean on all languages
    table += 0.01
    return np.log(table / table.sum(1, keepdims=True))


def _least(halves: np.ndarray, log_p: np.ndarray) -> list[float]:
    """Mean log-likelihood a triple from which on each language explains a text; halves: counts by half, language and slot."""
    got, n = sum((halves[1 - h] * _log_p(halves[h])).sum(1) for h in (0, 1)), halves.sum((0, 2))
    both = (halves.sum(2) > 0).all(0)
    return np.where(both, (got / np.maximum(n, 1) + log_p.min(1)) / 2, -np.inf).tolist()


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, list[float]]:
    """Languages, the log-probabilities of the slots under each, and what each explains (_least); rows: doc_id, declared, text, page."""
    labelled = rows.where("declared IS NOT NULL AND doc_id IS NOT NULL")
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    n = labelled.count()
    if n > 4 * sample:  # about 4 * sample rows have hashes this small: else each task would send as many as the sample
        labelled = labelled.where(order < int(2**64 * (4 * sample / n) - 2**63))
    ids = [r[0] for r in labelled.select("doc_id").orderBy(order, "doc_id").limit(sample).collect()]
    # as an Arrow table: a list would come from workers with a daemon of their own, which stay beside those of the operators
    sampled = rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
    rows = labelled.join(F.broadcast(sampled), "doc_id", "left_semi")
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).cast("int").alias("half")
    got = rows.select("declared", half, "text", "page").mapInArrow(_count, "declared string, half int, slot long, n long").groupBy("declared", "half", "slot").agg(F.sum("n").alias("n"))
    got = got.toPandas()  # at most 2 * SLOTS rows a language, and a language a row of the sample
    langs = sorted(got["declared"].unique())
    halves = np.zeros((2, len(langs), SLOTS))
    halves[got["half"].to_numpy(int), np.searchsorted(langs, got["declared"].to_numpy(object)) if langs else [], got["slot"].to_numpy(int)] = got["n"].to_numpy()
    if not langs:
        return langs, halves[0], []
    log_p = _log_p(halves.sum(0))
    return langs, log_p.astype(np.float32), _least(halves, log_p)


_SCORED = "doc_id long, page boolean, declared string, suffix string, parent string, host string, n long, text_ll array<double>"


def _score(model):
    table = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = table.value
        names = [x.split()[0] for x in _SCORED.split(", ")]
        for batch in batches:
            for b in shared.slices(batch, "text", 1_000_000):
                scores, sizes = [], []
                for t, page in zip(*(c.to_pylist() for c in shared.columns(b, "text", "page")), strict=True):
                    at = triples(_bytes(t, page))
                    sizes.append(len(at))
                    scores.append(log_p[:, at].sum(1, dtype=np.float64))
                flat = pa.array(np.concatenate(scores) if scores else np.empty(0))
                ends = pa.array(np.arange(len(scores) + 1, dtype="i4") * len(log_p))
                yield pa.RecordBatch.from_arrays([*shared.columns(b, *names[:6]), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=names)

    return run


def primary_tag(declared: Column) -> Column:
    """The primary part of a language tag, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(declared), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def _best(scores: Column, langs: list[str]) -> Column:
    at = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.lit(x) for x in langs]), at.cast("int"))


def _per_language(langs: list[str], where: Column) -> Column:
    return F.array(*[F.count(F.when(where & (F.col("best") == x), 1)).cast("double") for x in langs])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _joined(p: DataFrame, rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """p with the counts by language of the rows that share a key with each of its own."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"), _per_language(langs, F.col("n") > 0).alias(f"{key}_c"))
    # rows without the key meet nothing, each at a place of its own
    p = p.withColumn("key_", F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64("doc_id", "n").cast("string"))))
    counts = shared.table(counts.withColumnRenamed(key, "key_"), f"langid-{key}")
    return shared.spread_join(p, counts, ["key_"], ["doc_id", "n"], "left").drop("key_")


def fuse(rows: DataFrame, langs: list[str], least: list[float], certain: float, strength: float, markup: bool) -> DataFrame:
    """Verdicts of the documents (not the pages) of a written table (_SCORED, and best: the likeliest language by text)."""
    k = len(langs)
    docs = rows.where("NOT page")
    n = F.col("n") > 0
    corpus = rows.agg(_per_language(langs, n).alias("all"), _per_language(langs, n & ~F.col("page")).alias("docs")).first()  # one row
    own = F.when(n, F.array(*[(F.col("best") == x).cast("double") for x in langs])).otherwise(F.array(*[F.lit(0.0)] * k))
    p = docs.withColumn("own", own)
    for key, counted in (("declared", docs), ("suffix", rows), ("parent", rows), ("host", rows)):
        p = _joined(p, counted, key, langs)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    smooth = lambda c, up: F.transform(F.zip_with(c, up, lambda x, y: x + strength * y), lambda x: x / (_total(c) + strength))
    none = literal([0.0] * k)
    p = p.withColumn("all_c", minus(literal(corpus["all"]), F.col("own"))).withColumn("docs_c", minus(literal(corpus["docs"]), F.col("own")))
    for key in ("declared", "suffix", "parent", "host"):
        p = p.withColumn(f"{key}_c", F.when(F.col(key).isNotNull(), minus(F.coalesce(f"{key}_c", none), F.col("own"))))
    p = p.withColumn("p_all", F.transform("all_c", lambda x: (x + 1) / (_total(F.col("all_c")) + k)))
    p = p.withColumn("p_parent", smooth(F.coalesce("parent_c", none), F.col("p_all")))
    p = p.withColumn("p_host", smooth(F.coalesce("host_c", none), F.col("p_parent")))
    given = lambda c, of: F.when(F.col(c).isNotNull(), F.zip_with(c, of, lambda x, y: F.log((x + 1) / (y + k)))).otherwise(none)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    post = add(F.transform("text_ll", lambda x: x * WEIGHT), F.transform("p_host", lambda x: F.log(x)))
    post = add(post, given("suffix_c", "all_c"))
    if markup:
        post = add(post, given("declared_c", "docs_c"))
    p = p.withColumn("post", post).withColumn("language", _best(F.col("post"), langs))
    top = F.array_max("post")
    p = p.withColumn("probability", 1 / _total(F.transform("post", lambda x: F.exp(x - top))))
    fits = F.zip_with("text_ll", literal(least), lambda x, t: x >= t * F.col("n"))
    explained = (F.col("n") < FIT_TRIPLES) | F.exists(fits, lambda x: x)
    return p.select("doc_id", "language", "probability", "declared", F.col("n").alias("n_triples"), (n & (F.col("probability") >= certain) & explained).alias("kept"))


def _rows(df: DataFrame, id_col: str, text_col: str, declared: Column, host_col: str | None, page: bool) -> DataFrame:
    host = F.lit(None).cast("string")
    if host_col:
        host = F.nullif(F.lower(F.regexp_extract(F.col(host_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), primary_tag(declared).alias("declared"), host.alias("host"), F.lit(page).alias("page"))
    parent = F.nullif(F.regexp_extract("host", r"^[^.]*\.(.+\..+)$", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract("host", r"\.([a-z]+)$", 1), F.lit(""))
    return d.withColumns({"suffix": suffix, "parent": F.coalesce(parent, F.when(F.col("host").contains("."), F.col("host")))})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markup_col: str | None = "lang", host_col: str | None = "source", pages: DataFrame | None = None, certain: float = 0.5, sample: int = SAMPLE, strength: float = STRENGTH) -> DataFrame:
    """doc_id, language, probability, declared, n_triples and kept of each row.

    host_col may hold hosts or whole addresses.  pages: page_id, url, html.
    """
    sc = docs.sparkSession.sparkContext
    declared = F.col(markup_col).cast("string") if markup_col else F.lit(None).cast("string")
    d = _rows(docs, id_col, text_col, declared, host_col, False)
    both, langs = d, []
    if pages is not None:
        w = _rows(pages, "page_id", "html", F.regexp_extract(F.col("html").cast("string"), _LANG, 1), "url", True)
        langs, table, least = fit(w, sample)
        both = d.unionByName(w)
    markup = bool(langs)
    if not langs:
        langs, table, least = fit(d, sample)
    if not langs:
        n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\p{L}]", "")).cast("long")
        return d.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), "declared", n.alias("n_triples"), (n > 0).alias("kept"))
    rows = both.mapInArrow(_score(sc.broadcast(table)), _SCORED)
    rows = shared.table(rows.withColumn("best", _best(F.col("text_ll"), langs)), "langid")
    return fuse(rows, langs, least, certain, strength, markup)
