"""From raw documents to token shards: five stages, each a DataFrame in and a DataFrame out.

``STAGES`` lists them; ``run`` writes each stage's result as Parquet in the shared folder and reads it back for the next.
All but the last return the columns of ``documents``; the last returns one row a document of the token shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import decontaminate, langid, mixing, near, tokens
from kinlink.session import cut

#: A text whose n-gram ranks are further than this from every language is in none of them.
LEAST_SCORE = 0.3
#: The stages hold binary shards and iterative links, which SQL cannot express; tests compare with plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; texts without letters or near no language go."""
    judged = langid.identify(docs, langid.fit_profiles(docs))
    return judged.where(f"lang_pred != 'und' AND score >= {LEAST_SCORE}").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return near.without_near_duplicates(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixed documents, read back: ``doc_id, shard, start, n_tokens, ids_crc32``."""
    import public_tokenizers

    return tokens.token_rows(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks),
    ("mixing", mix_sources), ("token_ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
