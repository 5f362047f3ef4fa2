"""Id lookup and enrichment. Small tables carry no broadcast hint: Spark broadcasts them below its size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions import rules as R
from kinlink.functions import text as X


def funding_by_activity(naf: Column, table: dict[str, str] | None = None) -> Column:
    return R.lookup_map(table or K.ACTIVITY_FUNDING, R.activity_prefix(naf))


def funding_by_brand(name: Column, brands: list[tuple[str, str]] | None = None) -> Column:
    """Body of the first brand, in list order, contained in the lower-cased name."""
    pairs = brands or [(b, K.BRAND_FUNDING_BODY) for b in K.FUNDED_BRANDS]
    lowered = F.lower(X.or_blank(name))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(b)), F.lit(body)) for b, body in pairs])


def guess_funding(
    naf: Column, name: Column, activity: dict[str, str] | None = None, brands: list[tuple[str, str]] | None = None
) -> Column:
    """Struct (opco, source_opco): by activity prefix, else by brand, else undetermined."""
    by_activity, by_brand = funding_by_activity(naf, activity), funding_by_brand(name, brands)
    return F.struct(
        F.coalesce(by_activity, by_brand, F.lit(K.UNKNOWN_FUNDING)).alias("opco"),
        F.when(by_activity.isNotNull(), K.SOURCE_ACTIVITY)
        .when(by_brand.isNotNull(), K.SOURCE_BRAND)
        .otherwise("")
        .alias("source_opco"),
    )


def funding_fallback(owner: Column, manager: Column, naf: Column, activity: dict[str, str] | None = None) -> Column:
    """Struct (opco, source_opco) of the id lookup: official value, else activity prefix, else blank."""
    official, guessed = X.first_nonblank(owner, manager), funding_by_activity(naf, activity)
    return F.struct(
        F.coalesce(official, guessed, F.lit("")).alias("opco"),
        F.when(official.isNotNull(), K.SOURCE_OFFICIAL)
        .when(guessed.isNotNull(), K.SOURCE_ACTIVITY)
        .otherwise("")
        .alias("source_opco"),
    )


def region_table(spark: SparkSession, regions: dict[str, list[str]] | None = None) -> DataFrame:
    """(region, dept) rows."""
    rows = [(r, d) for r, ds in (regions or K.REGION_DEPARTMENTS).items() for d in ds]
    return spark.createDataFrame(rows, "region string, dept string")


def department_names() -> dict[str, str]:
    """Department to region name, built from the region table; Corsica also under its old number."""
    names = {d: K.REGION_NAMES[r] for r, ds in K.REGION_DEPARTMENTS.items() if r in K.REGION_NAMES for d in ds}
    return {**names, "20": K.REGION_NAMES["CORSE"], **K.OVERSEAS_NAMES}


def department_regions(spark: SparkSession) -> DataFrame:
    """(dept, region) lookup of about a hundred rows."""
    return spark.createDataFrame(list(department_names().items()), "dept string, region string")


def regions_table(regions: DataFrame) -> DataFrame:
    """Each region with its sorted departments."""
    return regions.groupBy("region").agg(F.array_sort(F.collect_set("dept")).alias("departements"))


def region_of(df: DataFrame, dept_region: DataFrame, postcode: str = "code_postal", out: str = "region") -> DataFrame:
    """Region by the postcode's two or three leading characters, blank if unknown."""
    lookup = dept_region.select(F.col("dept").alias("__dept"), F.col("region").alias("__region"))
    joined = df.withColumn("__dept", R.region_key(F.col(postcode))).join(lookup, "__dept", "left")
    return joined.withColumn(out, X.or_blank(F.col("__region"))).drop("__dept", "__region")


def activity_label(df: DataFrame, labels: DataFrame, naf: str = "naf", out: str = "libelle_naf") -> DataFrame:
    """Label of the activity code from (naf, label), blank if absent."""
    lookup = labels.select(F.col("naf").alias("__naf"), F.col("label").alias("__label"))
    joined = df.join(lookup, F.col(naf) == F.col("__naf"), "left")
    return joined.withColumn(out, X.or_blank(F.col("__label"))).drop("__naf", "__label")


def _spread_blanks(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``__key``: the id, or a value no id has where it is blank, different from row to row.

    Most rows can be without id. They match nothing, and as one value they would meet in one task of the join.
    """
    blank = F.concat(F.lit("?"), F.xxhash64(*df.columns).cast("string"))
    return df.withColumn("__key", F.when(X.or_blank(F.col(key)) == "", blank).otherwise(F.col(key)))


def attach_funding(df: DataFrame, funding: DataFrame, key: str = "siret") -> DataFrame:
    """Official funding body and agreement by id; they replace the guess only where the body is not blank."""
    official = funding.select(
        F.col("siret").alias("__key"),
        X.first_nonblank(F.col("opco_proprietaire"), F.col("opco_gestion")).alias("__body"),
        X.first_nonblank(F.col("idcc")).alias("__idcc"),
    )
    joined = _spread_blanks(df, key).join(official, "__key", "left")
    known = F.col("__body").isNotNull()
    return (
        joined.withColumn("opco", F.coalesce("__body", "opco"))
        .withColumn("source_opco", F.when(known, K.SOURCE_OFFICIAL).otherwise(F.col("source_opco")))
        .withColumn("idcc", F.when(known & F.col("__idcc").isNotNull(), F.col("__idcc")).otherwise(F.col("idcc")))
        .drop("__body", "__idcc", "__key")
    )


def lookup_by_id(
    ids: DataFrame,
    registry: DataFrame,
    funding: DataFrame,
    agreements: DataFrame,
    activity_labels: DataFrame,
    dept_region: DataFrame,
    key: str = "siret",
    digits: int = 14,
) -> DataFrame:
    """One row per asked id with ``valid`` and ``found`` flags and the enriched card, blank where nothing is known."""
    facts = registry.select(
        F.col("siret").alias(key), "siren", "denomination", "denomination_usuelle", "enseigne", "naf", "numero_voie",
        "type_voie", "voie", "code_postal", "commune", "tranche_effectif", "date_creation", F.lit(True).alias("__hit"),
    )
    joined = (
        ids.select(key)
        .join(facts, key, "left")
        .join(funding.withColumnRenamed("siret", key), key, "left")
        .join(agreements.select("idcc", F.col("libelle").alias("__agreement")), "idcc", "left")
    )
    labelled = activity_label(region_of(joined, dept_region), activity_labels)
    found = F.coalesce(F.col("__hit"), F.lit(False))
    shown = lambda c: F.when(found, X.or_blank(c)).otherwise("")
    body = funding_fallback(F.col("opco_proprietaire"), F.col("opco_gestion"), F.col("naf"))
    return labelled.select(
        key,
        R.valid_id_format(F.col(key), digits).alias("valid"),
        found.alias("found"),
        shown(F.col("siren")).alias("siren"),
        shown(F.col("denomination")).alias("denomination"),
        shown(X.first_nonblank(F.col("enseigne"), F.col("denomination_usuelle"))).alias("enseigne"),
        shown(F.col("naf")).alias("code_naf"),
        shown(F.col("libelle_naf")).alias("libelle_naf"),
        shown(F.col("tranche_effectif")).alias("effectif_code"),
        shown(F.col("date_creation")).alias("date_creation"),
        shown(body["opco"]).alias("opco"),
        shown(body["source_opco"]).alias("source_opco"),
        shown(F.col("idcc")).alias("idcc"),
        shown(F.col("__agreement")).alias("convention_collective"),
        shown(X.join_address(F.col("numero_voie"), F.col("type_voie"), F.col("voie"))).alias("adresse"),
        shown(F.col("code_postal")).alias("code_postal"),
        shown(F.col("commune")).alias("ville"),
        shown(F.col("region")).alias("region"),
    )


def reject_inactive(results: DataFrame, registry: DataFrame, key: str = "siret") -> DataFrame:
    """A match whose id is not active in the registry is rejected: blank id, score 0, its own method label."""
    active = registry.filter(F.col("etat_administratif") == "A").select(
        F.col("siret").alias("__key"), F.lit(True).alias("__active")
    )
    joined = _spread_blanks(results, key).join(active, "__key", "left")
    gone = (X.or_blank(F.col(key)) != "") & F.col("__active").isNull()
    return (
        joined.withColumn("score", F.when(gone, 0.0).otherwise(F.col("score")))
        .withColumn("methode", F.when(gone, K.METHOD_CLOSED).otherwise(F.col("methode")))
        .withColumn(key, F.when(gone, "").otherwise(F.col(key)))
        .drop("__active", "__key")
    )
