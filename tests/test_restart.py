"""What survives a job that breaks off: published tables, finished stages, pages by ranges."""

import pytest
from pyspark.sql import functions as F

from kinlink.operators import search as S
from kinlink.operators.quality import assert_unique_key
from kinlink.plans import cascade as M
from kinlink.session import Journal, Markers, fingerprint, scratch_path
from kinlink.sources.readers import current_version
from kinlink.sources.sinks import publish


def rows(spark, path):
    return sorted(r.id for r in spark.read.parquet(current_version(spark, path)).collect())


def test_broken_refresh_leaves_the_table(spark):
    path = scratch_path(spark, "table")
    write = lambda *ids: lambda to: spark.createDataFrame([(i,) for i in ids], "id long").write.parquet(to)
    unique = lambda version: assert_unique_key(spark.read.parquet(version), "id")
    assert current_version(spark, path) == path
    publish(spark, path, write(1, 2), unique)
    assert rows(spark, path) == [1, 2]

    def half(to):
        # Some tasks write their files before another one fails.
        spark.range(0, 8, 1, 8).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id")).write.parquet(to)

    with pytest.raises(Exception, match="TASK_WRITE_FAILED|broken"):
        publish(spark, path, half, unique)
    assert rows(spark, path) == [1, 2]
    with pytest.raises(Exception):
        publish(spark, path, write(3, 3), unique)
    assert rows(spark, path) == [1, 2]
    publish(spark, path, write(4), unique)
    publish(spark, path, write(5), unique)
    assert rows(spark, path) == [5]
    # What broken writes left goes with the versions of their number.
    publish(spark, path, write(6), unique)
    assert rows(spark, path) == [6]
    folder = Markers(spark, path).folder
    kept = [s.getPath().getName() for s in Markers(spark, path).files.listStatus(folder)]
    assert len([k for k in kept if k.startswith("0")]) == 2


def test_fingerprints_follow_rows_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("id")).repartition(3)) != fingerprint(df.distinct())
    assert fingerprint(df, None) != fingerprint(None, df) and fingerprint(df) != fingerprint(df.withColumnRenamed("t", "u"))


def test_second_run_goes_on_after_the_last_finished_stage(spark):
    prospects = spark.createDataFrame([(str(i), f"name {i}") for i in range(6)], "prospect_id string, nom string")
    folder, calls, broken = scratch_path(spark, "journal"), [], [True]

    def stage(k):
        def run(rest):
            calls.append(k)
            if k == 2 and broken[0]:
                raise RuntimeError("broken on purpose")
            hit = M.result_struct({"methode": F.lit(f"stage {k}"), "siret": F.col("nom")})
            return rest.filter(F.col("prospect_id") == str(k)).select("prospect_id", hit.alias("result"))

        return run

    def run(rows):
        return M.union_stages(rows, [stage(0), stage(1), stage(2)], Journal(spark, folder, fingerprint(rows)))

    with pytest.raises(RuntimeError):
        run(prospects)
    broken[0] = False
    got = {r.prospect_id: r.result.methode for r in run(prospects).collect()}
    assert calls == [0, 1, 2, 2]
    plain = {r.prospect_id: r.result.methode for r in M.union_stages(prospects, [stage(0), stage(1), stage(2)]).collect()}
    assert got == plain and got["1"] == "stage 1" and len(got) == 6
    calls.clear()
    run(prospects.union(prospects.limit(1).withColumn("prospect_id", F.lit("new")))).collect()
    assert calls == [0, 1, 2]


def test_pages_by_ranges(spark):
    df = spark.range(0, 3000, 1, 5).select(
        F.col("id").alias("siret"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("string").alias("commune"),
        F.when(F.col("id") % 5 > 0, F.lit("same")).alias("denomination"),
    )
    path = scratch_path(spark, "pages")
    sizes = [r.n for r in S.write_pages(df, path, ranges=6).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1000
    for limit, offset in ((1, 0), (500, 0), (500, 499), (700, 1400), (500, 2900), (10, 3000), (10, 10_000_000)):
        assert S.seek_page(spark, path, limit, offset).collect() == S.page(df, limit, offset).collect()
    deep = S.seek_page(spark, path, 10, 2500)
    assert len({f.split("page_range=")[1].split("/")[0] for f in deep.inputFiles()}) == 6
    plan = deep._jdf.queryExecution().executedPlan().toString()
    met = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "page_range" in met and met.count("page_range") <= 2
    with pytest.raises(ValueError):
        S.seek_page(spark, path, 0, 0)
    S.write_pages(df.limit(0), path + "-empty")
    assert S.seek_page(spark, path + "-empty", 10, 0).count() == 0


def test_cascade_with_a_journal(spark, monkeypatch):
    from kinlink.sources.readers import with_prospect_id

    fields = "nom adresse code_postal site_web ville departement telephone email secteur_recherche place_id rating avis".split()
    prospects = with_prospect_id(spark.createDataFrame([("Foo Bar", *[""] * 11), ("Baz", *[""] * 11)], ", ".join(f"{c} string" for c in fields)))
    pages = spark.createDataFrame([("https://a.example", "SIRET 44306184100047")], "url string, html string")
    columns = "siret siren denomination denomination_usuelle enseigne enseigne2 naf numero_voie type_voie voie code_postal commune tranche_effectif date_creation etat_administratif departement".split()
    registry = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    folder, calls = scratch_path(spark, "journal"), []
    monkeypatch.setattr(M, "match_by_page_id", lambda rest, *_: calls.append(1) or M.unmatched_results(rest).limit(0))
    run = lambda: sorted(M.match_cascade(prospects, registry, pages=pages, use_registry=False, enrich=False, journal=folder).collect())
    first = run()
    assert len(first) == 2 and run() == first and calls == [1]
