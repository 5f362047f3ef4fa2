"""What is sent to all tasks, and with that held by the driver, does not grow with the tables."""

from pyspark.sql import functions as F

from kinlink.llm.common import attach_small
from kinlink.llm.substrings import within
from kinlink.operators.extract import site_urls
from kinlink.session import cut


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_not_broadcast(spark):
    small = cut(spark.range(50).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v")), "small")
    rows = spark.range(300).select(F.when(F.col("id") % 60 > 0, F.col("id") % 60).alias("k"), "id")
    sent, salted = attach_small(rows, small, ["k"]), attach_small(rows, small, ["k"], limit=10)
    assert "BroadcastHashJoin" in planned(sent) and "Broadcast" not in planned(salted)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, sent.collect())) and salted.count() == 300


def test_files_count_for_their_rows(spark):
    """A few hundred kilobytes of file that are dozens of megabytes of rows."""
    sites = F.when(F.col("id") % 3 > 0, "").otherwise(F.concat(F.lit("site"), "id", F.lit(".example")))
    prospects = cut(spark.range(150_000).select(F.concat(F.lit("P"), "id").alias("prospect_id"), sites.alias("site_web")), "prospects")
    urls = site_urls(prospects)
    pages = cut(urls.select("page_url", F.lit("ab").alias("html")), "pages")
    hits = urls.join(pages, "page_url")
    assert "Broadcast" not in planned(hits) and hits.count() == 50_000 * urls.groupBy("prospect_id").count().first()["count"]
    few = cut(spark.range(5).select(F.lit("P3").alias("prospect_id")), "few")
    assert "BroadcastHashJoin" in planned(prospects.join(few, "prospect_id"))


def test_digests_are_sent_up_to_a_few_dozen_megabytes(spark):
    rows, keys = spark.range(10).withColumnRenamed("id", "k"), spark.range(250_000).withColumnRenamed("id", "k")
    assert "Broadcast" not in planned(within(rows, keys, "k"))
    assert "BroadcastHashJoin" in planned(within(rows, keys.limit(1000), "k"))


def test_settings_of_the_caller_stay(spark):
    factor, limit = "spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold"
    for given, left in (({factor: "3.0"}, "3.0"), ({limit: "256k"}, "1.0"), ({limit: "-1"}, "1.0"), ({limit: "10m"}, "40.0")):
        session = spark.newSession()
        for k, v in given.items():
            session.conf.set(k, v)
        assert cut(session.range(5)).count() == 5 and session.conf.get(factor) == left
