"""The queries of this subpackage; oracle.py has SQL for those that it can express."""

from __future__ import annotations

from . import langid, linededup, mpeg, neardup, packing, quality, spwfst, tokencount, tokenorc, warc
from .oracle import oracle_sql
from .shared import documents

__all__ = ["oracle_sql", "queries"]


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op3_sentencepiece(spark, sf_dir):
    return spwfst.round_trip(documents(spark, sf_dir))


def op4_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir), pages=documents(spark, sf_dir, "pages"))


def op5_mpeg_audio(spark, sf_dir):
    return mpeg.features(mpeg.store(documents(spark, sf_dir)))


def op6_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_warc(spark, sf_dir):
    return warc.archive_and_read(documents(spark, sf_dir, "pages"))


def op8_quality_rules(spark, sf_dir):
    return quality.apply_rules(documents(spark, sf_dir))


def op9_token_orc(spark, sf_dir):
    return tokenorc.store_and_digest(documents(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    return tokencount.count(documents(spark, sf_dir))


def queries():
    return {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_sentencepiece, op4_language_id, op5_mpeg_audio, op6_minhash_near_dedup, op7_warc, op8_quality_rules, op9_token_orc, op10_token_counts)}
