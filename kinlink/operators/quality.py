"""Counts, coverage and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions.text import or_blank


def registry_stats(registry: DataFrame, state: str = "etat_administratif") -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(state) == "A").alias("active"))


def quality_counts(
    registry: DataFrame, state: str = "etat_administratif", name: str = "denomination", sign: str = "enseigne"
) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(state) == "A").alias("actifs"),
        F.count_if(F.col(name) != "").alias("avec_denom"),
        F.count_if(F.col(sign) != "").alias("avec_enseigne"),
    )


def sample_of_postcode(registry: DataFrame, postcode: str, n: int = 5, key: str = "siret") -> DataFrame:
    """First n rows of one postcode, by id."""
    return registry.filter(F.col("code_postal") == postcode).orderBy(key).limit(n)


def similarity_probe(
    df: DataFrame, column: str, text: str, where: Column | None = None, threshold: float = 0.15, n: int = 5,
    key: str = "siret",
) -> DataFrame:
    """The n rows most similar to a fixed text among those at or above the threshold."""
    kept = df if where is None else df.filter(where)
    scored = kept.withColumn("sim", S.trigram_similarity(F.col(column), F.lit(text)))
    return scored.filter(F.col("sim") >= threshold).orderBy(F.desc("sim"), key).limit(n)


def missing_labels(facts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows whose code has no label."""
    return facts.join(labels.select(key), key, "left_anti")


def missing_label_ranking(facts: DataFrame, labels: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n most used non-blank codes without a label; counted before the anti join."""
    counted = facts.filter(or_blank(F.col(key).cast("string")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return missing_labels(counted, labels, key).orderBy(F.desc("count"), key).limit(n)


def label_coverage(facts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Coded rows, labelled rows and their share; counted per code before the join."""
    counted = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known = labels.select(key).distinct().withColumn("__known", F.lit(True))
    joined = counted.join(known, key, "left")
    coded = F.sum("__n")
    labelled = F.coalesce(F.sum(F.when(F.col("__known"), F.col("__n"))), F.lit(0))
    return joined.agg(coded.alias("coded"), labelled.alias("labelled")).withColumn(
        "coverage_pct", F.round(F.try_divide(F.col("labelled") * 100.0, F.col("coded")), 1)
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, or NULL, with their count; empty when the key is unique."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter((F.col("copies") > 1) | F.col(key).isNull())


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Return ``df`` if the key is unique and never NULL, else raise with an example."""
    bad = duplicate_keys(df, key).head(1)
    if bad:
        raise ValueError(f"key {key!r} is not unique: {bad[0].asDict()}")
    return df


def match_report(results: DataFrame, siret: str = "siret", method: str = "methode") -> DataFrame:
    """Matched, total and rounded percent in one row; no division by zero on empty input."""
    matched = F.count_if(or_blank(F.col(siret)) != "")
    return results.agg(matched.alias("matched"), F.count(F.lit(1)).alias("total")).withColumn(
        "percent", F.bround(F.try_divide(F.col("matched") * 100.0, F.col("total")), 0).cast("int")
    )


def method_counts(results: DataFrame, method: str = "methode") -> DataFrame:
    return results.groupBy(method).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), method)
