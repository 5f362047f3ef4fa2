"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a caller should start the session with. AQE splits skewed shuffle partitions at run time, also when a
# window or an aggregate follows the join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stages here compute much on few bytes: pairs of strings. Small partitions are joined up to this size only.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # Recording the Python call site of every column expression costs more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Up to this size of its files Spark may send a table to all tasks without knowing its rows. Columns of ids and repeated
# strings are up to 40 times larger as rows, and it is the driver that holds them.
SENT_FILE_BYTES = 256 * 1024

# Intermediate folders this process made, by application: what ``remove_scratch`` may delete.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder all executors share: ``folder``, else ``spark.checkpoint.dir``, else one in the warehouse.

    Off ``local[...]`` a warehouse on a plain local path is refused: each executor would write to its own disk, and
    later reads would miss those files without an error.
    """
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = folder or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        # A path without scheme means the default file system, also for readers and writers outside the JVM.
        plain = jvm.org.apache.hadoop.fs.FileSystem.get(configuration) if ":" not in named else None
        return (plain.makeQualified(jvm.org.apache.hadoop.fs.Path(named)).toString() if plain else named).rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    warehouse = jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
    system = warehouse.getFileSystem(configuration)
    if system.getScheme() == "file" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder all executors share in spark.checkpoint.dir")
    path = f"{system.makeQualified(warehouse).toString().rstrip('/')}/_scratch-{spark.sparkContext.applicationId}"
    system.deleteOnExit(jvm.org.apache.hadoop.fs.Path(path))
    return path


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark, folder)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the intermediate folders made so far in this application; returns how many there were.

    Call it once results that were read from them are written: their plans read these files.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(configuration).delete(path, True)
    return len(paths)


class Markers:
    """Empty files in a folder. A name is set or not, whatever breaks off, so setting one is a single step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, name: str) -> None:
        path = self.folder.suffix(f"/{name}")
        if not self.files.exists(path):
            self.files.create(path, False).close()

    def names(self) -> list[str]:
        """The names set so far, in order."""
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.folder)) if self.files.exists(self.folder) else []


def fingerprint(*frames: DataFrame | None) -> str:
    """A digest of the rows of tables, whatever their order and files; one pass each, summed map-side."""
    parts = []
    for df in frames:
        if df is not None:
            # Two sums of differently salted hashes, and the count: equal rows weigh as often as they come.
            sums = [F.sum(F.xxhash64(F.lit(salt), F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")) for salt in (1, 2)]
            parts.append((df.schema.simpleString(), *df.agg(F.count(F.lit(1)), *sums).first()))
        else:
            parts.append(None)
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:32]


class Journal:
    """Finished steps of a job in a shared folder, by the fingerprint of the job's inputs and the step's name.

    A step's rows are written to a folder of their own, then its marker names that folder. A run after one that broke off
    reads the steps that have a marker and computes the others; other inputs are another job.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{inputs}"
        self.markers = Markers(spark, f"{self.folder}/_finished")

    def step(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        done = [m for m in self.markers.names() if m.rpartition("@")[0] == name]
        if not done:
            written = f"{name}@{uuid.uuid4().hex}"
            run().write.parquet(f"{self.folder}/{written}")
            self.markers.add(written)
            done = [written]
        return self.spark.read.parquet(f"{self.folder}/{done[0]}")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where it comes from files, fewer than there are cores.

    For stages that compute much on few bytes, such as cleaning names: a small file is one partition to Spark. Larger
    inputs stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and 0 < len(df.inputFiles()) < cores else df


def sizes_as_rows(spark: SparkSession) -> None:
    """Let Spark count a file for what its rows take, where the session has left that at one for one.

    Without it a table is sent to all tasks up to a limit its compressed files are held against (10 MB by default), whatever
    its rows take on the driver. What is above ``SENT_FILE_BYTES`` is shuffled then, and still sent if its rows turn out to
    be below the limit: the adaptive planner has counted them.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if float(spark.conf.get(factor)) == 1 and limit > SENT_FILE_BYTES:
        spark.conf.set(factor, str(limit / SENT_FILE_BYTES))


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the file.

    Later readers get a columnar scan with pruning instead of a recomputed plan, and a lost executor costs a re-read.
    The write runs when this is called, while the plan is being built. Joins of the session are planned by
    ``sizes_as_rows`` from then on.
    """
    sizes_as_rows(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
