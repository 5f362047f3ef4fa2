"""Prospects as a stream against the static registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kinlink.session import scratch_path


def distinct_prospects(stream: DataFrame, key: str = "place_id", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a prospect that arrive within ``delay`` and rows older than that; without a time all input passes.

    The state holds one row per prospect of the last ``delay``, whatever the length of the stream.
    """
    return stream if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class Commits:
    """The batches whose results count: one empty file per batch beside the result folders."""

    def __init__(self, spark: SparkSession, out: str):
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{out}/_commits/{name}")
        self.files = self.path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __contains__(self, batch_id: int) -> bool:
        return self.files.exists(self.path(batch_id))

    def add(self, batch_id: int) -> None:
        self.files.create(self.path(batch_id), False).close()

    def batches(self) -> list[int]:
        folder = self.path("x").getParent()
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(folder)) if self.files.exists(folder) else []


def match_stream(
    stream: DataFrame,
    match: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Run ``match`` (a cascade bound to its registry) on every micro-batch and write its rows under ``out``.

    ``match`` gets the batch as a written table of the stream's session: the batch is read once, whatever ``match`` does with
    it, and planned adaptively, which plans of a running stream are not. Each batch counts once. It writes a folder of its own and then its commit file; a batch that broke off leaves no commit
    file and is written again from the start, one that is run again after its commit is left alone.
    """
    spark = stream.sparkSession
    commits = Commits(spark, out)

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id in commits:
            # The state of dropped repeats advances only where a batch is read.
            batch.write.format("noop").mode("overwrite").save()
            return
        path = scratch_path(spark, "batch")
        batch.write.parquet(path)
        match(spark.read.schema(batch.schema).parquet(path)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        commits.add(batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_matches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches with their ``batch_id``; folders without a commit file are not read."""
    rows = spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
    folders = [f"{out}/batch_id={b}" for b in Commits(spark, out).batches()]
    if not folders:
        return rows
    read = spark.read.schema(schema).option("basePath", out).parquet(*folders)
    return read.withColumn("batch_id", F.col("batch_id").cast("long"))


def last_matches(matches: DataFrame, key: str = "prospect_id") -> DataFrame:
    """The result of the latest batch per prospect, for prospects that arrived again after the delay. Counts map-side."""
    columns = [c for c in matches.columns if c != "batch_id"]
    last = matches.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("batch_id")).alias("last"))
    return last.select(*[F.col(f"last.{c}").alias(c) for c in columns])
