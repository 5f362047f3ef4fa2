"""Pair scoring. The Python measures see each distinct pair of strings once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import text as X
from kinlink.functions.fuzzy import fuzzy_measures, sorted_ratio
from kinlink.session import cut


def pair_measures(pairs: DataFrame, a: str, b: str, words: X.WordLists = X.WordLists()) -> DataFrame:
    """Distinct pairs of (a, b) with all measures and the name blend, compared in compare form."""
    distinct = pairs.select(a, b).distinct()
    formed = distinct.select(a, b, S.compare_form(F.col(a)).alias("__a"), S.compare_form(F.col(b)).alias("__b"))
    measured = formed.select(
        a,
        b,
        S.edit_similarity(F.col("__a"), F.col("__b")).alias("edit"),
        S.common_word_score("__a", "__b", words).alias("common_words"),
        fuzzy_measures("__a", "__b").alias("m"),
    )
    return measured.select(
        a, b, "edit", "common_words", "m.*", S.name_blend(F.col("edit"), F.col("m"), F.col("common_words")).alias("blend")
    )


def name_points(
    candidates: DataFrame,
    *,
    names: str,
    refs: list[str],
    words: X.WordLists = X.WordLists(),
    out: str = "name_points",
) -> DataFrame:
    """Add the name points of each candidate row: best blend over its ``names`` (array) and reference columns.

    Points depend on the strings alone, so they are found once per distinct (names, references) and joined to the rows
    from a written table: Spark knows its size, sends a small one to all tasks and leaves the candidates where they are.
    """
    held = [f"__ref{i}" for i in range(len(refs))]
    texts = [F.coalesce(F.col(names), F.array().cast("array<string>")).alias("__said"), *[X.or_blank(F.col(r)).alias(h) for r, h in zip(refs, held)]]
    sets = cut(candidates.select(*texts).distinct().withColumn("__set", F.monotonically_increasing_id()), "name-sets")
    pairs = sets.select("__set", F.explode("__said").alias("__name"), F.array(*held).alias("__refs"))
    pairs = pairs.select("__set", "__name", F.explode("__refs").alias("__ref")).filter(F.col("__ref") != "")
    blends = pair_measures(pairs, "__name", "__ref", words).select("__name", "__ref", "blend")
    best = pairs.join(blends, ["__name", "__ref"]).groupBy("__set").agg(F.max("blend").alias("__blend"))
    scored = sets.join(best, "__set").select("__said", *held, S.name_bucket(F.col("__blend")).alias("__points"))
    joined = candidates.select("*", *texts).join(cut(scored, "name-points"), ["__said", *held], "left")
    blank = S.name_bucket(F.lit(0.0))
    return joined.select(*[F.col(f"`{c}`") for c in candidates.columns], F.coalesce("__points", blank).alias(out))


def street_ratio(
    df: DataFrame, a: str, b: str, out: str = "street_ratio", source: DataFrame | None = None
) -> DataFrame:
    """Add the word-order-free ratio of two streets, NULL where either is blank; distinct pairs are measured once.

    ``source`` is where the pairs are read from, when a written copy of ``df`` is at hand.
    """
    filled = (df if source is None else source).filter((X.or_blank(F.col(a)) != "") & (X.or_blank(F.col(b)) != "")).select(a, b).distinct()
    formed = filled.select(a, b, S.compare_form(F.col(a)).alias("__a"), S.compare_form(F.col(b)).alias("__b"))
    # Written, so that Spark knows its size before it plans the join; see ``name_points``.
    measured = cut(formed.select(a, b, sorted_ratio("__a", "__b").alias(out)), "street-ratios")
    return df.join(measured, [a, b], "left")


def score_total(
    pairs: DataFrame,
    *,
    name: str,
    refs: list[str],
    postcodes: tuple[str, str],
    departments: tuple[str, str],
    numbers: tuple[str, str],
    streets: tuple[str, str],
    sole: str,
) -> DataFrame:
    """Full 0-100 score of prospect and establishment pairs with its parts."""
    df = pairs.withColumn("__names", F.array(name))
    df = name_points(df, names="__names", refs=refs).drop("__names")
    df = street_ratio(df, *streets)
    df = df.withColumn("geo_points", S.geo_points(*[F.col(c) for c in (*postcodes, *departments)]))
    df = df.withColumn("address_points", S.address_points(F.col(numbers[0]), F.col(numbers[1]), F.col("street_ratio")))
    total = S.total_points(F.col("name_points"), F.col("geo_points"), F.col("address_points"), F.col(sole))
    return df.withColumn("score", total)
