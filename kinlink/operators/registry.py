"""Registry build steps: filters, name joins, search columns, label upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text as X
from kinlink.functions.rules import department_of


def keep_active(df: DataFrame, state: str = "etat_administratif") -> DataFrame:
    return df.filter(F.col(state) == "A")


def drop_inactive(df: DataFrame, state: str = "etat_administratif") -> DataFrame:
    """Delete rows known not to be active; rows without a state stay."""
    return df.filter(F.col(state).isNull() | (F.col(state) == "A"))


def attach_legal_names(df: DataFrame, units: DataFrame, local_name: str = "denomination_usuelle_etab") -> DataFrame:
    """Legal name by unit id; the usual name is the unit's and the establishment's, joined where both exist."""
    names = units.select(
        "siren", F.col("denomination").alias("__legal"), F.col("denomination_usuelle").alias("__usual")
    )
    joined = df.drop("denomination", "denomination_usuelle").join(names, "siren", "left")
    usual = F.concat_ws(" ", F.nullif("__usual", F.lit("")), F.nullif(local_name, F.lit("")))
    return (
        joined.withColumn("denomination", X.or_blank(F.col("__legal")))
        .withColumn("denomination_usuelle", usual)
        .drop("__legal", "__usual", local_name)
    )


def backfill_names(df: DataFrame, units: DataFrame) -> DataFrame:
    """Both name columns from the unit where the legal name is NULL or blank and the unit exists."""
    names = units.select(
        "siren", F.col("denomination").alias("__legal"), F.col("denomination_usuelle").alias("__usual"),
        F.lit(True).alias("__unit"),
    )
    joined = df.join(names, "siren", "left")
    fill = (X.or_blank(F.col("denomination")) == "") & F.col("__unit").isNotNull()
    return (
        joined.withColumn("denomination_usuelle", F.when(fill, F.col("__usual")).otherwise(F.col("denomination_usuelle")))
        .withColumn("denomination", F.when(fill, F.col("__legal")).otherwise(F.col("denomination")))
        .select(*df.columns)
    )


def backfill_if_sparse(df: DataFrame, units: DataFrame) -> DataFrame:
    """Backfill only when fewer than half of the rows have a name. The test is one two-number aggregate."""
    named = F.count_if(X.or_blank(F.col("denomination")) != "")
    n = df.agg(named.alias("named"), F.count(F.lit(1)).alias("total")).first()
    return backfill_names(df, units) if n["named"] < n["total"] // 2 else df


def with_department(df: DataFrame, postcode: str = "code_postal", corsica: str = "full") -> DataFrame:
    return df.withColumn("departement", department_of(F.col(postcode), corsica))


def clean_search_columns(df: DataFrame, street_like_prospects: bool = False) -> DataFrame:
    """The three search columns; blank, never NULL.

    By default the street column has neither the street type nor abbreviations; ``street_like_prospects`` builds it
    from type and street the way prospect addresses are cleaned, so that both sides look alike.
    """
    street = X.search_text(F.col("voie"))
    if street_like_prospects:
        street = X.street_clean(F.concat_ws(" ", X.or_blank(F.col("type_voie")), X.or_blank(F.col("voie"))))
    return (
        df.withColumn("denomination_clean", X.search_text(F.col("denomination"), F.col("denomination_usuelle")))
        .withColumn("enseigne_clean", X.search_text(F.col("enseigne"), F.col("enseigne2")))
        .withColumn("voie_clean", street)
    )


def blanks_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.nullif(c, F.lit("")).alias(c) if c in columns else F.col(c) for c in df.columns])


def upsert_labels(old: DataFrame, new: DataFrame, key: str = "idcc", order: list[str] | None = None) -> DataFrame:
    """Insert or replace by key. Of several new rows for a key the last by ``order`` wins."""
    by = F.struct(*(order or [c for c in new.columns if c != key]))
    latest = new.groupBy(key).agg(F.max_by(F.struct(*old.columns), by).alias("__row"))
    latest = latest.select(*[F.col(f"__row.{c}").alias(c) for c in old.columns])
    return old.join(latest.select(key), key, "left_anti").select(*old.columns).unionByName(latest)
