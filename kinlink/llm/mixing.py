"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling to a token budget.

Only DataFrame functions run here. Two scans of the documents: the first sums sizes by source and slice of the sampling
key (combined map-side, at most sources x slices rows), the second decides each document by comparing its slice with the
slice where its source's budget ends. A slice that holds too many rows, as the last ones do where most weights are low, is
cut again between its smallest and its largest key. Only the documents of that one slice are ordered, so no task holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import attach_small, word_count
from kinlink.session import cut


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document: 1 for words of about six characters, less the further the mean is from that; 0.05 at least."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    off = F.abs(F.ln(F.greatest(mean, F.lit(0.1)) / 6.0))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 / (1.0 + off)), F.lit(0.05))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``source, source_size`` -> also ``target``: the words the mix should take from each source.

    Weights go to the sources in code-point order, null last, and repeat. A target stops at ``most`` times its source's
    size; what is above goes to the others by weight. That is a water level: with sources ordered by the level at which
    each is full, the level is the largest of (what is left for the sources from here on) / (their weights).
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    full = F.lit(most) * F.col("source_size")
    rows = (
        sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("_full", full)
        .withColumn("_total", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    )
    by_level = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_total") - before) / rest)
    level = F.max("_level").over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("_full"), level * F.col("_w")).alias("target"))


def slices_of(keyed: DataFrame, slice_no: Column, name: str) -> DataFrame:
    """One row a source and slice: its words, rows, smallest and largest key. Slices follow the order of the keys."""
    rows = keyed.groupBy("_mix_source", slice_no.alias("_mix_slice")).agg(
        F.sum("mix_size").alias("_mix_held"), F.count(F.lit(1)).alias("_mix_rows"), F.min("_mix_key").alias("_mix_low"), F.max("_mix_key").alias("_mix_high"),
    )
    return cut(rows, name)


def with_end(plan: DataFrame, slices: DataFrame) -> DataFrame:
    """``plan``, of one row a source, with the slice in which its ``_mix_left`` words end and the words ``_mix_before`` that slice.

    Slices begin after the ``_mix_before`` of the plan. Where no slice ends the budget, as it is the whole source, they stay null.
    """
    running = Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slices.withColumn("_upto", F.sum("_mix_held").over(running)).withColumnRenamed("_mix_source", "_end_source").drop("_mix_slice")
    plan = plan.withColumnRenamed("_mix_before", "_start")
    upto = F.col("_start") + F.col("_upto")
    meets = F.col("_mix_source").eqNullSafe(F.col("_end_source")) & (upto - F.col("_mix_held") <= F.col("_mix_left")) & (upto > F.col("_mix_left"))
    return plan.join(ends, meets, "left").withColumn("_mix_before", upto - F.col("_mix_held")).drop("_start", "_upto", "_end_source", "_mix_held")


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", most_rows: int = 50_000,
) -> DataFrame:
    """Columns of ``docs`` and ``mix_size, mix_source_size, mix_target, mix_taken``: the words the mix takes of each row.

    A source's target is cut into complete epochs (every document once) and a remainder. For the remainder documents are
    ordered by ``-ln(u) / weight`` within their source and taken until the remainder is spent; the last is taken in part.
    At most ``most_rows`` rows of a source, or those of one key, are put in order by one task; the result does not depend on it.

    Defined results: a null text has size 0 and nothing is taken; null sources form one source, ordered last; a null id is
    an id of its own; rows that repeat an id share a key and are ordered by text digest, and equal rows are told
    apart by position only, so the set of results is the same. An empty table gives an empty result. Columns of ``docs`` with the
    ``mix_`` names are replaced; all others are kept, whatever their names.
    """
    slices = max(16, math.isqrt(docs.count()))
    keyed = docs.withColumn("mix_size", word_count(F.col("text"))).withColumn("_mix_source", F.col("source"))
    keyed = keyed.withColumn("_mix_key", -F.ln(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"), F.col("mix_size")))
    held = slices_of(keyed, F.floor((1.0 - F.exp(-F.col("_mix_key"))) * slices), "mix-slices")
    sizes = held.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_held").alias("source_size"))
    targets = source_targets(sizes, share, most, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_mix_epochs", whole).select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "_mix_epochs",
        F.round(F.col("target") - F.col("_mix_epochs") * F.col("source_size")).cast("long").alias("_mix_left"), F.lit(0).cast("long").alias("_mix_before"),
    )
    plan = cut(with_end(plan, held), "mix-plan")
    full = (F.col("_mix_rows") > most_rows) & (F.col("_mix_high") > F.col("_mix_low"))
    while not plan.where(full).isEmpty():
        inside = attach_small(keyed.select("_mix_source", "_mix_key", "mix_size"), plan.where(full).select("_mix_source", "_mix_low", "_mix_high"), ["_mix_source"])
        inside = inside.where("_mix_key BETWEEN _mix_low AND _mix_high")
        place = F.floor((F.col("_mix_key") - F.col("_mix_low")) / (F.col("_mix_high") - F.col("_mix_low")) * slices)
        finer = slices_of(inside, place, "mix-finer-slices")
        again = with_end(plan.where(full).drop("_mix_rows", "_mix_low", "_mix_high"), finer)
        plan = cut(plan.where(~F.coalesce(full, F.lit(False))).unionByName(again), "mix-plan")
    rows = attach_small(keyed, plan, ["_mix_source"])
    # No slice ends the budget where the remainder is the whole source (or nothing is in it): all of it is taken.
    past = F.coalesce(F.col("_mix_key") > F.col("_mix_high"), F.lit(False))
    at_end = F.coalesce(F.col("_mix_key").between(F.col("_mix_low"), F.col("_mix_high")), F.lit(False))
    clear = rows.where(~at_end).withColumn("_mix_extra", F.when(past, F.lit(0)).otherwise(F.col("mix_size")).cast("long"))
    order = Window.partitionBy("_mix_source").orderBy("_mix_key", "doc_id", F.xxhash64("text"))
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_mix_left") - F.col("_mix_before") - (F.sum("mix_size").over(order) - F.col("mix_size"))
    split = rows.where(at_end).withColumn("_mix_extra", F.least(F.col("mix_size"), F.greatest(F.lit(0), left)).cast("long"))
    taken = F.col("_mix_epochs") * F.col("mix_size") + F.col("_mix_extra")
    spare = ["_mix_key", "_mix_source", "_mix_epochs", "_mix_left", "_mix_before", "_mix_rows", "_mix_low", "_mix_high", "_mix_extra"]
    return clear.unionByName(split).withColumn("mix_taken", taken.cast("long")).drop(*spare)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it; a part of at least half a document counts as one."""
    copies = F.when(F.col("mix_size") > 0, F.round(F.col("mix_taken") / F.col("mix_size"))).otherwise(F.lit(0)).cast("int")
    rows = mix(docs, **options).withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
