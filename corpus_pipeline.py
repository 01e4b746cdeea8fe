"""From raw documents to packed training sequences, in stages.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and calls one operator of ``siftprint.llm``.  All but the last return the columns
of ``documents``.

Stages run one after another in the same executors, whose Python workers stay; whole texts go
to them in Arrow batches bounded by bytes (``shared.bound_batches``).

Rows that share a doc_id share a verdict (kept if one of them is); rows without a doc_id
count as sharing one, and near-duplicate removal always keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftprint.llm import langid, linededup, neardup, packing, quality, shared
from siftprint.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    shared.bound_batches(spark)


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs but for those whose doc_id verdicts (doc_id, kept) reject: only their ids are joined."""
    rejected = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept_")).where("NOT kept_").select(F.col("doc_id").alias("id_"))
    # written, so that its size is known: no text moves where the ids are few
    rejected = shared.table(rejected, "pipeline-rejected")
    docs = docs.select(*COLUMNS)
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["id_"]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; lang is the language found. Evidence of the folder's pages is used too."""
    _prepare(spark)
    found = langid.identify(docs, pages=shared.if_there(spark, sf_dir, "pages"))
    one = found.groupBy("doc_id").agg(
        F.max("kept").alias("kept_"), F.max_by("language", "probability").alias("lang_"), F.min("declared").alias("low_"), F.max("declared").alias("high_"), F.count("declared").alias("n_"), F.count("*").alias("all_")
    )
    same = (F.col("lang_") == F.col("low_")) & (F.col("lang_") == F.col("high_")) & (F.col("n_") == F.col("all_"))
    # only rejected documents, and those that declare another language, are joined
    changed = shared.table(one.where(~F.col("kept_") | ~F.coalesce(same, F.lit(False))).select(F.col("doc_id").alias("id_"), "kept_", "lang_"), "pipeline-changed")
    docs = docs.select(*COLUMNS)
    met = docs.join(changed, docs["doc_id"].eqNullSafe(changed["id_"]), "left").where(F.coalesce("kept_", F.lit(True)))
    return met.withColumn("lang", F.coalesce("lang_", langid.primary_tag(F.col("lang")), "lang")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, on hosts that do."""
    _prepare(spark)
    return _without(docs, quality.apply_rules(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of lines."""
    _prepare(spark)
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _prepare(spark)
    return _without(docs, neardup.near_duplicates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    _prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.table(docs, f"pipeline-{name}")
    return docs
