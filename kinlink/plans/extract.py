"""Extract: search, flatten, de-duplicate and name in one pass instead of page by page."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.operators import search as Q
from kinlink.sources.sinks import extract_name, write_extract


def extract(
    registry: DataFrame,
    funding: DataFrame,
    agreements: DataFrame,
    *,
    region: str,
    size: str = K.ALL_SIZES,
    idcc: str | None = None,
    naf: str | None = None,
) -> DataFrame:
    """All rows of a region's search in the extract's shape, one per id: of several labels of its agreement the first."""
    if region not in K.REGION_DEPARTMENTS:
        raise ValueError(f"unknown region {region!r}")
    found = Q.search_prospects(
        registry, funding, agreements, departments=K.REGION_DEPARTMENTS[region], size=size, idcc=idcc, naf=naf
    )
    rows = found.select(F.array(F.struct(*found.columns)).alias("results"))
    return Q.dedupe_by_id(Q.flatten_pages(rows), order=["convention_collective"])


def run_extract(registry, funding, agreements, folder: str, *, region: str, size: str = K.ALL_SIZES, idcc=None, naf=None,
                day: datetime.date | None = None) -> DataFrame:
    """Write the extract and return its one-row summary."""
    mode, criterion = ("IDCC", idcc) if idcc else ("NAF", naf)
    name = extract_name(region, mode, criterion, day)
    rows = extract(registry, funding, agreements, region=region, size=size, idcc=idcc, naf=naf)
    path = write_extract(rows, folder, name)
    written = registry.sparkSession.read.option("header", True).csv(path)
    return Q.extract_summary(
        written, region=region, critere=f"{mode}: {criterion}", taille=size, sheet_name=name
    )
