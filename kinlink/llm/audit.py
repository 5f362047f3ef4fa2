"""Filter interaction audit: what each of five filters removes, alone and after others, in every order.

A document's failing filters are a bit mask, so a part of the corpus is at most 32 counted cells. One walk over all sets of
filters in Gray-code order toggles one filter at a time; a cell keeps the number of chosen filters it fails, and the
survivors change only where that number leaves or reaches zero. The 32 stored states answer every step of every order by
difference. Counting runs over all documents, combined map-side; the walk sees cells only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import SPACES

#: The filters in bit order: the first has bit 1; the last, text repeated from a smaller id, has the highest bit.
FILTERS = "ABCDE"
NUMBERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row: its part, the SHA-256 of its text, and the filters the text alone fails.

    A: under 100 words; B: under 80 % of them distinct; C: over 10 % capitals A-Z; D: holds one of ``#$%&*|``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words.alias("words"))
    bits = [
        "size(words) < 100", "100L * size(array_distinct(words)) < 80L * size(words)",
        "100L * regexp_count(t, '[A-Z]') > 10L * length(t)", "t RLIKE '[#$%&*|]'",
    ]
    mask = " + ".join(f"CAST({b} AS INT) * {1 << k}" for k, b in enumerate(bits))
    return rows.selectExpr("doc_id", "part", "unhex(sha2(t, 256)) AS digest", f"{mask} AS mask")


def count_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the set of filters they fail.

    Rows are first counted by (id, part, text digest, mask), then labelled by id, then counted by text, where the smallest
    id is known without a join back: a group's rows at its own smallest id pass the last filter if that id is the text's.
    A text a third of all rows share is thus combined map-side, and null ids are dealt over tasks.
    """
    ids = ["doc_id", "spread"]
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(1024))).otherwise(F.lit(0)).alias("spread")
    rows = failing_masks(docs).select("doc_id", spread, "part", "digest", "mask")
    rows = rows.groupBy(*ids, "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr("max(quality = 1)").alias("good"), F.expr("max(toxic = 1)").alias("toxic"))
    rows = rows.join(marks.withColumn("spread", F.lit(0).cast("long")), ids, "left")
    marked = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    # Each id stands once in a group of this step, so the row count at the smallest id is that of one row.
    groups = rows.groupBy("digest", "part", "mask", *marked).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.expr("min_by(n, doc_id)").alias("at_least"),
        F.expr("coalesce(sum(n) FILTER (WHERE doc_id IS NULL), 0)").alias("unknown"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("unknown") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    groups = groups.withColumn("first", first).withColumn("passing", passing)
    last = 1 << (len(FILTERS) - 1)
    both = F.expr(f"inline(array(struct(mask, passing AS n), struct(mask + {last} AS mask, n - passing AS n)))")
    counts = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    return groups.select("part", "good", "toxic", both).groupBy("part", "mask").agg(*counts)


def gray_walk(cells: dict[int, tuple[int, ...]], filters: int) -> list[tuple[int, ...]]:
    """Sums of the surviving cells for each set of filters, the set being the index as a bit mask."""
    width = len(next(iter(cells.values())))
    alive = [sum(c[k] for c in cells.values()) for k in range(width)]
    active = dict.fromkeys(cells, 0)
    states: list[tuple[int, ...]] = [()] * (1 << filters)
    states[0], chosen = tuple(alive), 0
    for step in range(1, 1 << filters):
        bit = step & -step
        chosen ^= bit
        for mask, cell in cells.items():
            if not mask & bit:
                continue
            before = active[mask]
            active[mask] = now = before + (1 if chosen & bit else -1)
            if bool(before) != bool(now):
                sign = -1 if now else 1
                alive = [a + sign * c for a, c in zip(alive, cell, strict=True)]
        states[chosen] = tuple(alive)
    return states


def audit_rows(cells: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """Filter order, step and the seven numbers, for every order and step, from the stored states by difference."""
    k = len(names)
    states, full = gray_walk(cells, k), (1 << k) - 1
    removed = lambda chosen, bit: [a - b for a, b in zip(states[chosen], states[chosen | bit], strict=True)]
    failing = [removed(0, 1 << f)[0] for f in range(k)]
    alone = [removed(full ^ 1 << f, 1 << f)[0] for f in range(k)]
    orders = lambda chosen: factorial(chosen.bit_count()) * factorial(k - 1 - chosen.bit_count())
    shapley = [sum(orders(s) * removed(s, 1 << f)[0] for s in range(1 << k) if not s >> f & 1) for f in range(k)]
    out = []
    for order in permutations(range(k)):
        chosen, shown = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            gone, good, toxic = removed(chosen, 1 << f)
            chosen |= 1 << f
            out.append((shown, step, states[chosen][0], gone, failing[f] - gone, alone[f], good, toxic, shapley[f]))
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Defined results: a null text is empty; a null language is the part with the empty name, as an empty one is; a row without
    id neither fails the last filter nor makes others fail it; equal ids with equal texts all pass it; a row is good or
    toxic if any label of its id says so; an empty table has no parts and gives no rows; other columns are not read.
    """
    cell = F.struct("mask", "n", "good", "toxic")
    parts = count_cells(docs, labels).groupBy("part").agg(F.collect_list(cell).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = audit_rows({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["cells"]})
                columns = [[row["part"]] * len(rows), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(NUMBERS), strict=True)],
                    ["part", "filter_order", "step", *NUMBERS],
                )

    kinds = ", ".join(f"{c} long" for c in NUMBERS)
    return parts.mapInArrow(walk, f"part string, filter_order string, step int, {kinds}")


def audit_sql() -> str:
    """The same rows in SQL, from the definitions: each set of filters counted by itself."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    five = [f"{x}.f" for x in "abcde"]
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(five) for b in five[i + 1 :])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS MATERIALIZED (SELECT part, doc_id, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > first, false)::INT AS mask,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
s AS MATERIALIZED (SELECT part, chosen, count(*) FILTER (mask & chosen = 0) AS alive, count(*) FILTER (mask & chosen = 0 AND good) AS good,
  count(*) FILTER (mask & chosen = 0 AND toxic) AS toxic, count(*) FILTER (mask = chosen) AS exact, count(*) FILTER (mask & chosen = chosen) AS failing
  FROM f, (SELECT unnest(range(32)) AS chosen) GROUP BY part, chosen),
l(f, bit) AS (VALUES {letters}),
o AS (SELECT {' || '.join(five)} AS filter_order, [{', '.join(f'{x}.bit' for x in 'abcde')}] AS bits FROM l a, l b, l c, l d, l e WHERE {apart}),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS MATERIALIZED (SELECT x.part, filter_order, step, bit, y.alive AS kept, x.alive - y.alive AS removed, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps JOIN s x ON x.chosen = before JOIN s y ON y.part = x.part AND y.chosen = before + bit)
SELECT r.part, filter_order, step::INT AS step, kept, removed, one.failing - removed AS redundant, one.exact AS unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY r.part, bit))::BIGINT AS shapley
FROM r JOIN s one ON one.part = r.part AND one.chosen = bit
"""
