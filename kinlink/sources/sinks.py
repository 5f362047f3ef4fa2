"""Writers."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions.text import or_blank
from kinlink.session import Markers


def write_registry(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Full refresh of the registry: one folder per department, files sorted by postcode, number and id.

    The range exchange on (department, postcode, id) splits a department of any size over several tasks, and the sort
    gives Parquet narrow postcode ranges to skip by.
    """
    ordered = df.select(*K.REGISTRY_COLUMNS).repartitionByRange("departement", "code_postal", "siret")
    ordered = ordered.sortWithinPartitions("departement", "code_postal", "numero_voie", "siret")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("departement").parquet(path)


def write_by_id(df: DataFrame, path: str, key: str = "siret", buckets: int | None = None) -> None:
    """Write a table in buckets of its id, sorted, for joins by id that move the other side only (``read_by_id``).

    There are ``buckets``, by default as many as shuffle partitions: Spark shuffles a table of fewer buckets after all. The
    exchange uses the hash the buckets have, so each bucket is one file. Ids are the table's unique key, so no bucket is hot.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"by_id_{uuid.uuid4().hex}"
    # Only a table can be written in buckets; the folder and the marker with their number are all that is kept of it.
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    # An empty table has no bucket file to tell the columns.
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/_columns")
    Markers(spark, f"{path}/_buckets").add(f"{key}@{buckets}")


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace a table; there is no incremental load. ``publish`` does it without a time in which there is no table."""
    df.write.mode("overwrite").parquet(path)


def publish(
    spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], object] | None = None, keep: int = 2
) -> str:
    """Refresh the table ``path`` as a new version: ``write`` it to a folder beside the others, ``check`` it, then set its
    marker. Returns the folder.

    Readers take the version of the last marker (``current_version``), so a write that breaks off or a check that raises
    leaves the table as it was. Versions before the last ``keep`` are deleted, with what broken writes have left among them.
    """
    markers = Markers(spark, f"{path}/_published")
    names = markers.names()
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    version = f"{number:010d}-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    if check is not None:
        check(f"{path}/{version}")
    markers.add(version)
    last = markers.names()[-keep:]
    for status in markers.files.listStatus(markers.folder.getParent()):
        name = status.getPath().getName()
        # A version being written by another job has a number that is not below the kept ones.
        if re.fullmatch(r"[0-9]{10}-[0-9a-f]{32}", name) and name.split("-")[0] < last[0].split("-")[0]:
            markers.files.delete(status.getPath(), True)
    return f"{path}/{version}"


def enriched_rows(results: DataFrame) -> DataFrame:
    """The flat 28-column export, one row per prospect."""
    given = [
        "nom", "adresse", "code_postal", "ville", "departement", "telephone", "site_web", "email",
        "secteur_recherche", "place_id", "rating", "avis",
    ]
    r = lambda c: or_blank(F.col(f"result.{c}"))
    status = F.when(r("siret") != "", K.STATUS_FOUND).otherwise(K.STATUS_MISSING)
    return results.select(
        *[or_blank(F.col(c)).alias(c) for c in given],
        r("siret").alias("siret"), r("siren").alias("siren"), r("denomination").alias("denomination_sirene"),
        r("enseigne").alias("enseigne_sirene"), r("naf").alias("naf"), r("effectif").alias("effectif"),
        r("tranche_effectif_code").alias("tranche_effectif_code"), r("date_creation").alias("date_creation"),
        r("dirigeant").alias("dirigeant"), r("opco").alias("opco"), r("source_opco").alias("source_opco"),
        r("idcc").alias("idcc"), r("convention_collective").alias("convention_collective"),
        F.coalesce(F.col("result.score"), F.lit(0.0)).alias("score_confiance"), r("methode").alias("methode_matching"),
        status.alias("statut_prospection"),
    )


def write_enriched(results: DataFrame, path: str, format: str = "csv") -> None:
    writer = enriched_rows(results).write.mode("overwrite").format(format)
    (writer.option("header", True).option("escape", '"') if format == "csv" else writer).save(path)


def extract_name(region: str, mode: str, criterion: str, day: datetime.date | None = None) -> str:
    """Name of an extract: region, mode, criterion and day."""
    day = day or datetime.datetime.now(datetime.timezone.utc).date()
    return f"Prospects_{region}_{mode}_{criterion}_{day.isoformat()}"


def extract_columns(df: DataFrame) -> DataFrame:
    """The 16 columns of an extract under their display names."""
    return df.select(*[F.col(c).alias(shown) for shown, c in K.EXTRACT_COLUMNS.items()])


def write_extract(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    extract_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
