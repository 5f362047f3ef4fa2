"""Registry build: two CSV scans, one join, one partitioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinlink import constants as K
from kinlink.operators import registry as R
from kinlink.operators.quality import assert_unique_key
from kinlink.session import spread
from kinlink.sources.readers import read_legal_units, read_registry, read_registry_csv
from kinlink.sources.sinks import publish, write_registry


def registry_frame(establishments: DataFrame, units: DataFrame, corsica: str = "full") -> DataFrame:
    """Active establishments with legal names, department and search columns; blanks become NULL as in the table."""
    df = R.attach_legal_names(spread(R.keep_active(establishments)), units)
    df = R.with_department(df, corsica=corsica)
    text = [c for c in df.columns if c not in ("siret", "siren")]
    return R.clean_search_columns(R.blanks_to_null(df, text)).select(*K.REGISTRY_COLUMNS)


def build_registry(spark: SparkSession, establishments_csv: str, units_csv: str, path: str) -> DataFrame:
    """Read, join, derive, write and check a new version, then publish it; returns the written table.

    Whatever fails before leaves the registry of the last build in place.
    """
    df = registry_frame(read_registry_csv(spark, establishments_csv), read_legal_units(spark, units_csv))
    return read_registry(spark, publish(
        spark, path, lambda version: write_registry(df, version),
        lambda version: assert_unique_key(read_registry(spark, version), "siret"),
    ))
