"""Filtered search, counts, paging and the reports on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions import text as X
from kinlink.session import cut


def require_criterion(idcc: str | None, naf: str | None, section: str | None = None) -> None:
    """At least one business criterion; a section letter alone is refused."""
    if not (idcc or naf or section):
        raise ValueError("one of idcc, naf or section is required")
    if section and not (idcc or naf):
        raise ValueError("section is not supported: use a two-digit naf prefix")


def in_departments(departments: list[str], column: str = "departement") -> Column:
    if not 1 <= len(departments) <= 101:
        raise ValueError("between 1 and 101 departments are required")
    return F.col(column).isin(*departments)


def by_size_class(size: str, column: str = "tranche_effectif", classes: dict[str, list[str]] | None = None) -> Column:
    """Headcount code in the class; the catch-all class filters nothing."""
    classes = classes or K.SIZE_CLASSES
    if size == K.ALL_SIZES:
        return F.lit(True)
    if size not in classes:
        raise ValueError(f"unknown size class {size!r}")
    return F.col(column).isin(*classes[size])


def by_activity_prefix(prefix: str, column: str = "naf") -> Column:
    """Literal prefix: ``%`` and ``_`` are no wildcards here."""
    return F.col(column).startswith(prefix)


def _filtered(registry: DataFrame, departments, size, idcc, naf) -> DataFrame:
    kept = registry.filter(F.col("etat_administratif") == "A").filter(in_departments(departments))
    kept = kept.filter(by_size_class(size))
    return kept.filter(by_activity_prefix(naf)) if naf and not idcc else kept


def by_agreement(registry: DataFrame, funding: DataFrame, idcc: str | None) -> DataFrame:
    """Join the funding table: inner and filtered with an agreement code, left without."""
    if idcc:
        return registry.join(funding.filter(F.col("idcc") == idcc), "siret", "inner")
    return registry.join(funding, "siret", "left")


def search_prospects(
    registry: DataFrame,
    funding: DataFrame,
    agreements: DataFrame,
    *,
    departments: list[str],
    size: str = K.ALL_SIZES,
    idcc: str | None = None,
    naf: str | None = None,
    section: str | None = None,
) -> DataFrame:
    """Active establishments that meet the criteria, with funding and agreement. Unordered; see ``page``."""
    require_criterion(idcc, naf, section)
    joined = by_agreement(_filtered(registry, departments, size, idcc, naf), funding, idcc)
    joined = joined.join(agreements.select("idcc", F.col("libelle").alias("convention_collective")), "idcc", "left")
    return joined.select(
        "siret", "siren", "denomination", "denomination_usuelle", "enseigne", "naf", "code_postal", "commune",
        "departement", "tranche_effectif", F.nullif(F.col("date_creation"), F.lit("")).alias("date_creation"),
        X.join_address(F.col("numero_voie"), F.col("type_voie"), F.col("voie")).alias("adresse"),
        F.coalesce("opco_proprietaire", "opco_gestion").alias("opco"), "idcc", "convention_collective",
    )


def search_count(
    registry: DataFrame,
    funding: DataFrame,
    *,
    departments: list[str],
    size: str = K.ALL_SIZES,
    idcc: str | None = None,
    naf: str | None = None,
    section: str | None = None,
    agreements: DataFrame | None = None,
) -> DataFrame:
    """Row count of a search. The funding table is read only when the agreement filters on it.

    Without ``agreements`` every agreement has one label. With them the count is that of ``search_prospects``, which has a
    row per label; labels are counted before the join.
    """
    require_criterion(idcc, naf, section)
    kept = _filtered(registry, departments, size, idcc, naf).select("siret")
    if agreements is None:
        if idcc:
            kept = kept.join(funding.filter(F.col("idcc") == idcc).select("siret"), "siret")
        return kept.agg(F.count(F.lit(1)).alias("total"))
    labels = agreements.groupBy("idcc").agg(F.count(F.lit(1)).alias("__labels"))
    found = by_agreement(kept, funding.select("siret", "idcc"), idcc).join(labels, "idcc", "left")
    return found.agg(F.coalesce(F.sum(F.coalesce("__labels", F.lit(1))), F.lit(0)).alias("total"))


def page_order(first: str = "commune", second: str = "denomination", key: str = "siret") -> list[Column]:
    """City, name, then id, so that pages neither overlap nor miss rows; NULLs last."""
    return [F.asc_nulls_last(first), F.asc_nulls_last(second), F.col(key).asc()]


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    if offset < 0:
        raise ValueError("offset must not be negative")


def page(df: DataFrame, limit: int = 500, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One page of a result. One task sorts ``offset + limit`` rows; ``write_pages`` and ``seek_page`` serve deep pages."""
    _check_page(limit, offset)
    return df.orderBy(*(order or page_order())).offset(offset).limit(limit)


def write_pages(df: DataFrame, path: str, order: list[Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Write a result once by ranges of its order, for pages at any depth; returns rows per range (``page_range, n``).

    The order has to end in a unique column, so that a value shared by many rows can be split. ``ranges`` is the session's
    number of shuffle partitions by default; a page then sorts that fraction of the rows.
    """
    order = order or page_order()
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *order).withColumn("page_range", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.partitionBy("page_range").parquet(f"{path}/rows")
    ranged.limit(0).write.parquet(f"{path}/empty")
    # The folder names and file footers hold all that is counted here.
    sizes = _ranged_rows(df.sparkSession, path).groupBy("page_range").agg(F.count(F.lit(1)).alias("n"))
    sizes.coalesce(1).write.parquet(f"{path}/sizes")
    return df.sparkSession.read.parquet(f"{path}/sizes")


def _ranged_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_pages``; an empty result has no folders to take the columns from."""
    return spark.read.schema(spark.read.parquet(f"{path}/empty").schema).parquet(f"{path}/rows")


def seek_page(spark: SparkSession, path: str, limit: int = 500, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """A page of a result written by ``write_pages``, equal to ``page`` of it; reads only the ranges the page meets.

    The sizes, one row per range, are read by the driver.
    """
    _check_page(limit, offset)
    start, met, skipped = 0, [], 0
    for r in spark.read.parquet(f"{path}/sizes").orderBy("page_range").collect():
        if start + r.n <= offset:
            skipped = start + r.n
        elif start < offset + limit:
            met.append(r.page_range)
        start += r.n
    rows = _ranged_rows(spark, path).filter(F.col("page_range").isin(met)).drop("page_range")
    return rows.orderBy(*(order or page_order())).offset(offset - skipped if met else 0).limit(limit)


def clamp_page_size(limit: int | None) -> int:
    return max(100, min(2000, limit or 500))


def page_plan(count: DataFrame, limit: int | None = None, total: str = "total") -> DataFrame:
    """The page requests of an extract: page number, offset and size, from a one-row count."""
    size = clamp_page_size(limit)
    pages = F.ceil(F.col(total) / F.lit(size)).cast("int")
    planned = count.select(F.col(total).alias("total"), pages.alias("total_pages")).filter(F.col("total") > 0)
    return planned.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_pages").cast("long"))).alias("page"), "total_pages", "total"
    ).select("page", "total_pages", "total", ((F.col("page") - 1) * size).alias("offset"), F.lit(size).alias("limit"))


def number_pages(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """Every row with its row number in the total order and its page, without sorting in one task.

    Rows are range-partitioned and written once, so the partition numbers cannot change; the partition sizes, one row
    per partition, give each partition's start.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per range partition (at most spark.sql.shuffle.partitions), so a single-task window is fine here.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__start")
    numbered = ranged.join(F.broadcast(starts), "__part").withColumn("row_number", row)
    return numbered.withColumn(
        "page", F.ceil(F.col("row_number") / F.lit(clamp_page_size(limit))).cast("long")
    ).drop("__part", "__start")


def agreements_by_size(funding: DataFrame, agreements: DataFrame) -> DataFrame:
    """Agreements with their label and number of establishments, largest first; counted before the join."""
    counted = funding.filter(F.col("idcc").isNotNull()).groupBy("idcc").agg(F.count("siret").alias("count"))
    return (
        counted.filter(F.col("count") > 0)
        .join(agreements.select("idcc", "libelle"), "idcc")
        .select("idcc", "libelle", "count")
        .orderBy(F.desc("count"), "idcc")
    )


def flatten_pages(pages: DataFrame, results: str = "results") -> DataFrame:
    """Rows of all pages in the extract's shape: shown name, blanks for NULL, empty contact columns."""
    r = pages.select(F.explode(results).alias("r")).select("r.*")
    kept = [
        "enseigne", "naf", "code_postal", "commune", "departement", "adresse", "tranche_effectif", "date_creation",
        "opco", "idcc", "convention_collective",
    ]
    shown = X.first_nonblank(F.col("denomination"), F.col("denomination_usuelle"), F.col("enseigne"))
    return r.select(
        "siret", "siren", X.or_blank(shown).alias("denomination"), *[X.or_blank(F.col(c)).alias(c) for c in kept],
        *[F.lit("").alias(c) for c in ("email", "telephone", "site_web")],
    )


def dedupe_by_id(df: DataFrame, key: str = "siret", order: list[str] | None = None) -> DataFrame:
    """One row per id, the first by ``order`` if given. Aggregated map-side, so copies collapse before the shuffle."""
    if order is None:
        return df.dropDuplicates([key])
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return first.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def extract_summary(df: DataFrame, **facts: str) -> DataFrame:
    """One row: number of rows and the given facts (region, criterion, size, sheet name, date)."""
    total = F.count(F.lit(1)).alias("total_prospects")
    found, none = "Extraction terminée", "Aucun prospect trouvé"
    summary = df.agg(total).withColumn("statut", F.when(F.col("total_prospects") > 0, found).otherwise(none))
    return summary.select("statut", "total_prospects", *[F.lit(v).alias(k) for k, v in facts.items()])
