"""Quality rules per document and per host, in DataFrame functions only.

Base counts come from whole texts, in array functions that take time n log n in the
words of a text and need no shuffle.  Rule failures are then aggregated by host;
each host's failure rate is shrunk towards the rate of all hosts by a beta prior that
is fitted to the hosts by moments; a host is rejected if its shrunken rate of some rule is
above ``host_limit`` of the way from the rate of all hosts to 1, and at least above
``host_limit`` itself; its verdict is joined back to its documents.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``.

Edge cases: a null text has no words, so it fails the base; a text of blanks too.
Documents without a host get no host verdict.  Hosts with few documents keep close to
the prior.  With fewer than two hosts, or hosts that all have one rate, the prior has
the strength ``flat_strength``.  Repeated rows count once each.  Input columns with the
names of results are not read and do not clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BLANKS = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The rules whose failures are aggregated by host.
RULES = ["short", "repetitive", "symbols", "dup_lines"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def _windows(words: Column) -> Column:
    """A hash for each window of three words."""
    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
    )


def _covered(positions: Column) -> Column:
    """Words in windows of three at the given positions, which ascend."""
    return F.aggregate(
        F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3)).cast("int"))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def _repeats(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more: equal hashes are neighbours once sorted."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    again = _let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce((k > 0) & (x["h"] == F.get(s, k - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
    return _let(F.sort_array(F.transform(again, lambda x: x["i"])), _covered)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""
    return _let(
        _windows(words),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_repeats(w)),
    )


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the base counts of each row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    return d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def failures(counts: DataFrame, min_words: int, repeat_percent: int) -> DataFrame:
    """The counts with a column of each rule and base_failed."""
    return counts.withColumns(
        {
            "short": F.col("n_words") < min_words,
            "repetitive": 100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"),
            "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
            "dup_lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
        }
    ).withColumn("base_failed", F.col("short") | F.col("repetitive"))


def host_verdicts(failed: DataFrame, host_limit: float, flat_strength: float) -> DataFrame:
    """host, its shrunken rate of each rule (rate_*) and host_failed."""
    hosts = failed.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    moments = []
    for r in RULES:
        rate = F.col(r) / F.col("n")
        moments += [(F.sum(r) / F.sum("n")).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}"), F.avg(1 / F.col("n")).alias(f"i_{r}")]
    prior = hosts.agg(*moments).first()  # one row
    rates, over = [], []
    for r in RULES:
        m = prior[f"m_{r}"] or 0.0
        spread = m * (1 - m)
        between = (prior[f"v_{r}"] or 0.0) - spread * (prior[f"i_{r}"] or 0.0)  # without what chance adds
        strength = spread / between - 1 if 0 < between < spread else flat_strength
        rate = (F.col(r) + m * strength) / (F.col("n") + strength)
        rates.append(rate.alias(f"rate_{r}"))
        over.append(rate - (host_limit + (1 - host_limit) * m))
    return hosts.select("host", *rates, (F.greatest(*over) > 0).alias("host_failed"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, repeat_percent: int = 50, host_limit: float = 0.5, flat_strength: float = 20.0) -> DataFrame:
    """Counts and verdicts of each row: base_failed, and kept by document and host."""
    failed = shared.table(failures(base_counts(docs, id_col, text_col, host_col), min_words, repeat_percent), "quality")
    # written, so that its size is known: it goes to every task only if it is small
    hosts = shared.table(host_verdicts(failed, host_limit, flat_strength).select("host", "host_failed"), "quality-hosts")
    out = failed.join(hosts, "host", "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS k FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS x(d) GROUP BY doc_id),
c AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words
  FROM t LEFT JOIN n USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive,
         10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > n_words AS dup_lines FROM c),
h AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS k
  FROM (SELECT source, unnest([0, 1, 2, 3]) AS rule, unnest([short, repetitive, symbols, dup_lines]) AS failed FROM f)
  WHERE source IS NOT NULL GROUP BY ALL),
m AS (SELECT rule, sum(k) / sum(n) AS m, var_pop(k / n) AS v, avg(1 / n) AS i FROM h GROUP BY rule),
s AS (
  SELECT rule, m, CASE WHEN v - m * (1 - m) * i > 0 AND m * (1 - m) > v - m * (1 - m) * i
                       THEN m * (1 - m) / (v - m * (1 - m) * i) - 1 ELSE 20 END AS strength FROM m),
v AS (SELECT source, max((k + m * strength) / (n + strength) - (0.5 + 0.5 * m)) > 0 AS host_failed FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive) AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN v USING (source)
"""
