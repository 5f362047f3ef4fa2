"""What one task gets does not grow with the table."""

from compare import SF
from pyspark.sql import functions as F

from kinlink.operators.scoring import name_points, street_ratio
from kinlink.sources import readers
from workload import build, tables


def test_candidates_stay_where_few_strings_are_scored(spark):
    rows = spark.range(1000).select("id", F.array(F.lit("RED GEAR")).alias("names"), F.lit("RED BOLT").alias("a"), F.lit("GEAR RED").alias("b"))
    out = street_ratio(name_points(rows, names="names", refs=["a", "b"]), "a", "b")
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select("name_points", F.round("street_ratio", 3)).distinct().collect() == [(50, 0.5)]


def test_units_in_as_many_ranges_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(build, "UNITS_PER_RANGE", 500)
    path = build._units_csv(spark, SF)
    assert len(spark.read.csv(path).inputFiles()) > 8
    whole = readers.read_legal_units(spark, path)
    monkeypatch.setattr(readers, "BYTES_PER_TASK", 1000)
    dealt = readers.read_legal_units(spark, path)
    assert "REPARTITION" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(dealt.collect()) == sorted(whole.collect()) == sorted(build.read_legal_units(spark, SF).collect())


def test_tables_of_one_file_are_dealt(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.run(spark, SF, "SELECT p_partkey FROM {part}").rdd.getNumPartitions() >= cores
    assert tables.lines(spark, SF).rdd.getNumPartitions() >= cores
