"""Tables in buckets of their id, searches turn by turn, and searches that read the asked departments only."""

import re

import pytest
from compare import SF
from pyspark.sql import functions as F

from kinlink.operators import candidates as C
from kinlink.operators import enrich as E
from kinlink.plans.cascade import _with_facts
from kinlink.session import scratch_path
from kinlink.sources.readers import current_version, read_by_id, read_registry
from kinlink.sources.sinks import publish, write_by_id, write_registry
from workload import tables as T


@pytest.fixture(scope="module")
def registry(spark):
    return T.registry(spark, SF)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_below_an_exchange(plan, column):
    """Scans of tables with ``column`` that an exchange lies above, by the indents of the plan's lines."""
    found, path = 0, []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+-]*", line).group())
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if "FileScan" in line and f"{column}#" in line:
            found += any(re.search(r"\bExchange hashpartitioning", x) for _, x in path)
    return found


def test_joins_by_id_move_the_small_side_only(spark, registry, no_broadcast):
    path = scratch_path(spark, "by-id")
    write_by_id(registry, path)
    table = read_by_id(spark, path)
    plain = scratch_path(spark, "plain")
    registry.write.parquet(plain)
    results = spark.range(50).selectExpr("CAST(id AS STRING) AS prospect_id", "CAST(id AS STRING) AS siret", "1.0D AS score", "'M' AS methode")
    for join in (lambda r: E.reject_inactive(results, r), lambda r: _with_facts(results.select("prospect_id", "siret"), r)):
        assert scans_below_an_exchange(plan_of(join(spark.read.parquet(plain))), "siret") == 1
        assert scans_below_an_exchange(plan_of(join(table)), "siret") == 0
    funding = scratch_path(spark, "funding")
    write_by_id(T.funding(spark, SF), funding)
    assert scans_below_an_exchange(plan_of(E.attach_funding(results.selectExpr("*", "'' AS opco", "'' AS source_opco", "'' AS idcc"), read_by_id(spark, funding))), "siret") == 0


def test_bucketed_table_holds_the_rows(spark, registry):
    path = scratch_path(spark, "by-id")
    write_by_id(registry, path, buckets=5)
    rows = lambda df: sorted(map(tuple, df.select(*registry.columns).collect()), key=str)
    assert rows(read_by_id(spark, path)) == rows(registry)
    # Each bucket is one file, sorted.
    files = spark.read.parquet(path).select("siret", F.input_file_name().alias("f")).groupBy("f").count().count()
    assert files == 5


def test_bucketed_versions(spark, registry):
    path = scratch_path(spark, "versions")
    for rows in (registry.limit(7), registry.limit(3), registry.limit(0)):
        publish(spark, path, lambda to, rows=rows: write_by_id(rows, to, buckets=4))
        assert read_by_id(spark, path).count() == rows.count()
    assert current_version(spark, path).split("/")[-1].startswith("0000000003")


def address_rows(spark):
    schema = "siret string, code_postal string, numero_voie string, voie_clean string"
    rows = [("a", "20090", "1", "COURS NAPOLEON"), ("b", "20100", "1", "COURS NAPOLEON"), ("c", "20100", "2", "RUE FESCH"), ("d", "20190", "3", "QUAI SUD")]
    asked = [
        ("in-turn-0", "2A", "1", "COURS NAPOLEON"), ("in-turn-1", "2A", "2", "RUE FESCH"), ("in-turn-2", "2A", "3", "QUAI SUD"),
        ("nowhere", "2A", "9", "RUE FESCH"), ("no-number", "2A", "", "RUE FESCH"), ("other", "75", "1", "COURS NAPOLEON"),
    ]
    prospects = spark.createDataFrame([(p, d, "20000", n, s) for p, d, n, s in asked], "prospect_id string, departement string, code_postal string, adresse_numero string, adresse_voie_clean string")
    return prospects, spark.createDataFrame(rows, schema)


def test_turns_are_searched_for_prospects_without_a_hit(spark, monkeypatch):
    prospects, registry = address_rows(spark)
    searched, whole = [], C.address_candidates

    def counted(rest, *args, **options):
        searched.append(sorted(r.prospect_id for r in rest.collect()))
        return whole(rest, *args, **options)

    monkeypatch.setattr(C, "address_candidates", counted)
    found = C.nearby_address_candidates(prospects, registry, table={"200": ["20090", "20000", "20100", "20190"]})
    assert sorted((r.prospect_id, r.alt_ord, r.siret) for r in found.collect()) == [("in-turn-0", 0, "a"), ("in-turn-1", 1, "c"), ("in-turn-2", 2, "d")]
    assert searched == [
        ["in-turn-0", "in-turn-1", "in-turn-2", "nowhere"], ["in-turn-1", "in-turn-2", "nowhere"], ["in-turn-2", "nowhere"],
    ]


def test_turns_end_with_the_last_hit_and_nobody_gives_no_rows(spark):
    prospects, registry = address_rows(spark)
    table = {"200": ["20090", "20100"]}
    assert C.nearby_address_candidates(prospects.filter("prospect_id = 'other'"), registry, table=table).collect() == []
    only = C.nearby_address_candidates(prospects.filter("prospect_id = 'in-turn-0'"), registry, table=table)
    assert [(r.alt_ord, r.siret) for r in only.collect()] == [(0, "a")]


def test_search_reads_the_asked_departments_only(spark, registry):
    path = scratch_path(spark, "registry")
    write_registry(registry, path)
    written = read_registry(spark, path)
    asked = spark.createDataFrame([("04000",), ("11190",), ("20190",), (None,)], "code_postal string")
    few = C.in_asked_departments(written, asked)
    scan = next(line for line in plan_of(few).splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[.*departement#\d+ IN \((?=.*04)(?=.*11)(?=.*2A)", scan)
    assert few.count() == written.filter("departement IN ('', '04', '11', '2A')").count() < written.count()
    assert C.in_asked_departments(written, asked, most=1).count() == written.count()
