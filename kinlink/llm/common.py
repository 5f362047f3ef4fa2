"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a regex class body (space, tab, line feed, vertical tab, form feed, return).
SPACES = r"\x20\x09-\x0D"

#: Most counted rows that are sent to all tasks, of digests and of ids: 34 MB each as a hash table, and the driver holds several.
MOST_DIGESTS, MOST_IDS = 200_000, 400_000


def attach_small(df: DataFrame, small: DataFrame, keys: list[str], limit: int = 20_000, salts: int = 32) -> DataFrame:
    """Left join of a written table with one row per key, null keys equal; keys of ``df`` may be as skewed as they like.

    ``small`` is counted: up to ``limit`` rows it is broadcast, beyond that each of its rows is repeated once per salt
    and the rows of a hot key in ``df`` are spread over the salts. The repeated rows are never broadcast: Spark knows the
    size of the file they come from, not how often they are repeated.
    """
    small = small.withColumnsRenamed({k: f"_small_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_small_{k}")) for k in keys]
    drop = [f"_small_{k}" for k in keys]
    if small.count() <= limit:
        return df.join(F.broadcast(small), reduce(lambda a, b: a & b, same), "left").drop(*drop)
    spread = df.withColumn("_salt", F.floor(F.rand(17) * salts).cast("int"))
    copies = small.withColumn("_salt_small", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    same.append(F.col("_salt") == F.col("_salt_small"))
    return spread.join(copies, reduce(lambda a, b: a & b, same), "left").drop("_salt", "_salt_small", *drop)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def open_fs(uri: str):
    """The Arrow file system of a Spark path and the path in it; a task can then write there and read byte ranges."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def worker_cache() -> dict:
    """What this Python worker keeps from task to task, such as a loaded model; functions shipped by value have no lasting
    globals. Nothing that grows with the data belongs here: workers are shared by all stages of an application.
    """
    return sys.modules.setdefault("_kinlink_worker", types.ModuleType("_kinlink_worker")).__dict__


def stage_cache() -> dict:
    """What this worker keeps from task to task of one stage; the first task of another stage forgets it."""
    from pyspark import TaskContext

    cache, stage = worker_cache(), TaskContext.get().stageId()
    if cache.get("stage") != stage:
        cache["stage"], cache["of_stage"] = stage, {}
    return cache["of_stage"]


def returning_memory(run):
    """``run`` over the batches of a task, then what it freed handed to the system, for later stages in the same worker.

    What an earlier stage kept in ``stage_cache`` goes before the task starts.
    """

    def task(batches):
        import ctypes

        import pyarrow as pa

        stage_cache()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task
