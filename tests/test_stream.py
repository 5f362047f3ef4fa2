"""The stream: several batches, repeats inside and outside the delay, late rows, batches run twice, restart."""

import pytest
from pyspark.sql import functions as F

from kinlink.session import scratch_path
from kinlink.streaming.match_stream import Commits, distinct_prospects, last_matches, match_stream, read_matches

ROWS = "place_id string, nom string, minute int"


class Feed:
    """Files arriving one batch at a time, matched by a function that only marks the name."""

    def __init__(self, spark):
        self.spark = spark
        self.source, self.out, self.state = (scratch_path(spark, n) for n in ("feed", "matched", "state"))
        self.calls, self.broken = [], False

    def arrive(self, *rows):
        stamped = self.spark.createDataFrame(rows, ROWS).withColumn("seen_at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("minute")))
        stamped.coalesce(1).write.mode("append").parquet(self.source)
        self.schema = stamped.schema

    def match(self, batch):
        self.calls.append(sorted(r.nom for r in batch.collect()))
        if self.broken:
            raise RuntimeError("broken on purpose")
        return batch.select("place_id", F.concat(F.lit("matched "), "nom").alias("result"))

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.source)
        match_stream(distinct_prospects(stream, time="seen_at", delay="60 minutes"), self.match, self.out, self.state).awaitTermination()

    def rows(self):
        return read_matches(self.spark, self.out, "place_id string, result string")

    def last(self):
        return {r.place_id: r.result for r in last_matches(self.rows(), "place_id").collect()}


@pytest.fixture
def feed(spark):
    return Feed(spark)


def test_repeats_late_rows_and_restart(feed):
    feed.arrive(("a", "one", 0), ("b", "two", 1), ("a", "one again", 2))
    feed.arrive(("b", "repeat in the delay", 30), ("c", "three", 50))
    feed.run()
    assert [len(c) for c in feed.calls if c] == [2, 1]
    assert feed.last().keys() == {"a", "b", "c"} and feed.last()["b"] == "matched two"
    # A new run goes on from the checkpoint: the clock moves on, then old rows are late and repeats count again.
    feed.arrive(("d", "four", 300))
    feed.run()
    feed.arrive(("e", "too late", 100), ("b", "after the delay", 310))
    feed.run()
    assert feed.last() == {"a": feed.last()["a"], "b": "matched after the delay", "c": "matched three", "d": "matched four"}
    assert feed.last()["a"] in ("matched one", "matched one again") and feed.rows().count() == 5


def test_a_broken_batch_is_run_again_and_a_committed_one_is_not(spark, feed):
    feed.arrive(("a", "one", 0))
    feed.broken = True
    with pytest.raises(Exception, match="broken on purpose"):
        feed.run()
    assert feed.rows().count() == 0
    feed.broken = False
    feed.run()
    assert feed.last() == {"a": "matched one"} and feed.calls[:2] == [["one"], ["one"]]
    # The checkpoint is lost, the results are not: batch 0 comes again and changes nothing.
    done, calls = Commits(spark, feed.out).batches(), len(feed.calls)
    feed.state = scratch_path(spark, "state")
    feed.run()
    assert len(feed.calls) == calls and Commits(spark, feed.out).batches() == done and feed.rows().count() == 1


def test_rows_without_commit_are_not_read(spark, feed):
    assert feed.rows().count() == 0
    spark.createDataFrame([("x", "half written")], "place_id string, result string").write.parquet(f"{feed.out}/batch_id=7")
    assert feed.rows().count() == 0
