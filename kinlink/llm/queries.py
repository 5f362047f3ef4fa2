"""Registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import audit, decontaminate, langid, licences, manifest, mixing, near, pii, quality, scoring, substrings, tokens, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the public vocabulary the token query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.archive_round_trip(table(spark, sf, "pages"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.languages(table(spark, sf, "documents")).drop("text")


def op3_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document, written to shards and read back."""
    return tokens.token_rows(table(spark, sf, "documents"), word_vocabulary())


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a passage close to a benchmark item."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality.judge_quality(table(spark, sf, "documents"))


def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that lie in a string of 200 bytes which occurs again."""
    return substrings.remove_repeats(table(spark, sf, "documents")).drop("kept_text")


def op7_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Bigram stupid-backoff score of every document by all others."""
    return scoring.lm_scores(table(spark, sf, "documents"))


def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licences.scan_licences(table(spark, sf, "documents"))


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Component of near duplicates of every document, on shingles of four words."""
    return near.near_duplicates(table(spark, sf, "documents"), n=4)


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words the mix takes of every document."""
    rows = mixing.mix(table(spark, sf, "documents"))
    return rows.selectExpr(
        "doc_id", "source", "mix_size AS size", "mix_source_size AS source_size", "mix_target AS target", "mix_taken AS taken",
    )


def op11_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document: the fixed patterns, and what the fitted field adds."""
    return pii.personal_data(table(spark, sf, "documents")).drop("masked_text")


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes, for every language, order and step."""
    return audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and proof of every document; every fifth one by the checksum of its id is checked after tampering."""
    rows = manifest.merkle_manifest(table(spark, sf, "documents"), tampered=manifest.every_fifth(F.col("doc_id")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc, "op2_language_id": op2_language_id, "op3_token_ids": op3_token_ids,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules, "op6_substrings": op6_substrings,
    "op7_lm_scores": op7_lm_scores, "op8_licence_scan": op8_licence_scan, "op9_near_duplicates": op9_near_duplicates,
    "op10_mixing": op10_mixing, "op11_personal_data": op11_personal_data, "op12_filter_audit": op12_filter_audit, "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op8_licence_scan": licences.scan_sql(), "op12_filter_audit": audit.audit_sql(), "op13_merkle_manifest": manifest.manifest_sql(),
}
