"""Exact similarity joins of strings by shared tokens inside a block.

A string is a set of 64-bit token codes with a number of its own. Rows that travel carry block, code, number, size and
position; sets are joined to a pair only once it has passed every bound.

Two sets with Jaccard similarity t or more share a token among the first |A| - ceil(t|A|) + 1 tokens of each, in any
common order. Ordered from rare to frequent, the frequent tokens, the ones that make a group hot, fall behind that
prefix wherever a string has anything rarer. The join is then an equi-join on (block, token); no block is ever crossed
with itself. A token that is hot in its block is cut into a grid of salted cells; all other tokens stay as they are.

Where only each query's best rows are asked for and most strings share some token, lists are counted in place instead: a
block is a grid of cells, and a cell sends out a few rows a query, never its pairs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.session import cut

# Send the counting of cells along with the job, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries and references of a cell of a large block: what a task holds.
CELL_QUERIES, CELL_REFS = 8_192, 32_768

# Token counts are kept per hash bucket, so the broadcast table has at most this many rows whatever the data.
BUCKETS = 1 << 16
# Of the tokens that are hot in a block, the hottest get salts: a bound for the table that is sent to all tasks.
MOST_HOT = 20_000

# Exact number of a three-character token: 21 bits per code point.
TRIGRAM_CODE = "ascii(tok) * 4398046511104L + ascii(substring(tok, 2, 1)) * 2097152L + ascii(substring(tok, 3, 1))"
# Hash of a longer token: two of n tokens of a block share it with probability n * n / 2^65.
TEXT_CODE = "xxhash64(tok)"


def encoded_sets(side: DataFrame, tokens: str, code: str, number: str, name: str) -> DataFrame:
    """``side`` written with a ``number`` per row, its ``codes``, their ``size`` and a bit signature ``s0, s1, s2`` of 192 bits."""
    coded = side.withColumn("codes", F.expr(f"array_distinct(transform({tokens}, tok -> {code}))")).drop(tokens)
    bits = "transform(codes, c -> pmod(xxhash64(c), 192))"
    signature = [f"aggregate({bits}, 0L, (s, h) -> s | IF(h div 64 = {i}, shiftleft(1L, CAST(h % 64 AS INT)), 0L)) AS s{i}" for i in range(3)]
    return cut(coded.selectExpr("*", "size(codes) AS size", *signature, f"monotonically_increasing_id() AS {number}"), name)


def _sized(side: DataFrame, keep: list[str], tag: str, columns: tuple[str, ...]) -> DataFrame:
    return side.select(*keep, *[F.col(c).alias(f"{tag}_{c}") for c in columns])


def _with_similarity(pairs: DataFrame, queries: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """``q_id, r_id, sim, shared`` of pairs at or above the threshold; the sets come to the pairs here."""
    both = pairs.join(_sized(queries, ["q_id"], "q", ("codes", "size")), "q_id").join(_sized(refs, ["r_id"], "r", ("codes", "size")), "r_id")
    return _similar(both, ["q_id", "r_id"], threshold)


def _similar(both: DataFrame, keep: list[str], threshold: float) -> DataFrame:
    counted = both.selectExpr(*keep, "q_size + r_size AS both", "size(array_intersect(q_codes, r_codes)) AS shared")
    return counted.filter(f"shared > 0 AND shared / (both - shared) >= {threshold}D").selectExpr(*keep, "shared / (both - shared) AS sim", "shared")


def pairs_in_blocks(queries: DataFrame, refs: DataFrame, blocks: list[str], threshold: float) -> DataFrame:
    """All pairs of a block at or above the threshold, for blocks whose pair count is bounded.

    A bit that one signature has and the other has not stands for at least one token that is not shared, so sizes and
    signatures drop nearly all pairs inside the join, before any set is intersected.
    """
    columns = ("codes", "size", "s0", "s1", "s2")
    need = f"{threshold / (1 + threshold)}D * (q_size + r_size) - 1e-9D"
    apart = lambda a, b: " + ".join(f"bit_count({a}_s{i} & ~{b}_s{i})" for i in range(3))
    met = _sized(queries, [*blocks, "q_id"], "q", columns).join(_sized(refs, [*blocks, "r_id"], "r", columns), blocks).filter(
        f"r_size >= {threshold}D * q_size - 1e-9D AND q_size >= {threshold}D * r_size - 1e-9D "
        "AND (q_s0 & r_s0 | q_s1 & r_s1 | q_s2 & r_s2) != 0 "
        f"AND q_size - ({apart('q', 'r')}) >= {need} AND r_size - ({apart('r', 'q')}) >= {need}"
    )
    return _similar(met, ["q_id", "r_id"], threshold)


def _rare_first(queries: DataFrame, refs: DataFrame, blocks: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their codes from rare to frequent, written."""
    bucket = f"CAST(pmod(xxhash64(code), {BUCKETS}) AS INT) AS bucket"
    codes = lambda side: side.selectExpr("explode(codes) AS code").selectExpr(bucket)
    counts = codes(queries).unionAll(codes(refs)).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = cut(counts, "token-counts")

    def ordered(side: DataFrame, number: str, name: str) -> DataFrame:
        kept = [*blocks, number, *[c for c in ("order",) if c in side.columns]]
        exploded = side.selectExpr(*kept, "explode(codes) AS code").selectExpr("*", bucket)
        counted = exploded.join(F.broadcast(counts), "bucket").groupBy(*kept)
        entries = counted.agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("entries"))
        return cut(entries.selectExpr(*kept, "transform(entries, e -> e.code) AS codes", "size(entries) AS size"), name)

    return ordered(queries, "q_id", "queries-rare-first"), ordered(refs, "r_id", "references-rare-first")


def _meet(asked: DataFrame, held: DataFrame, keys: list[str], condition: str, rows_per_cell: int) -> DataFrame:
    """Distinct ``q_id, r_id`` of rows that meet on ``keys`` under a condition; keys hot on a side are spread over cells."""
    counted = lambda side, name: side.groupBy(*keys).agg(F.count("*").alias(name))
    heavy = [counted(s, n).filter(f"{n} > {rows_per_cell}") for s, n in ((asked, "q_n"), (held, "r_n"))]
    hot = heavy[0].join(heavy[1], keys, "full").orderBy(F.desc(F.greatest("q_n", "r_n"))).limit(MOST_HOT)
    cells = [f"CAST(ceil(coalesce({n}, 1) / {rows_per_cell}) AS INT) AS {n[0]}_cells" for n in ("q_n", "r_n")]
    hot = cut(hot.selectExpr(*keys, *cells), "hot-tokens")
    on = list(keys)
    if not hot.isEmpty():
        on += ["q_cell", "r_cell"]
        own = lambda t: f"CAST(pmod(xxhash64({t}_id), coalesce({t}_cells, 1)) AS INT) AS {t}_cell"
        every = lambda t: f"explode(sequence(0, coalesce({t}_cells, 1) - 1)) AS {t}_cell"
        asked = asked.join(F.broadcast(hot), keys, "left").selectExpr(*asked.columns, own("q"), every("r"))
        held = held.join(F.broadcast(hot), keys, "left").selectExpr(*held.columns, own("r"), every("q"))
    return asked.join(held, on).filter(condition).select("q_id", "r_id").distinct()


def similar_pairs(queries: DataFrame, refs: DataFrame, blocks: list[str], threshold: float, rows_per_cell: int = 200_000) -> DataFrame:
    """All ``q_id, r_id`` at or above the threshold with ``sim`` and ``shared``, by the prefix join."""
    queries, refs = _rare_first(queries, refs, blocks)
    prefix = lambda side, t, number: side.selectExpr(
        *blocks, number, f"size AS {t}_size",
        f"posexplode(slice(codes, 1, greatest(1, CAST(size - ceil(size * {threshold}D - 1e-9D) + 1 AS INT)))) AS ({t}_pos, code)",
    )
    # Length bound, and the most that can still be shared if this is the pair's first shared token.
    need = f"{threshold / (1 + threshold)}D * (q_size + r_size) - 1e-9D"
    condition = (
        f"r_size >= {threshold}D * q_size - 1e-9D AND q_size >= {threshold}D * r_size - 1e-9D "
        f"AND least(q_size - q_pos, r_size - r_pos) >= {need}"
    )
    met = _meet(prefix(queries, "q", "q_id"), prefix(refs, "r", "r_id"), [*blocks, "code"], condition, rows_per_cell)
    return _with_similarity(met, queries, refs, threshold)


def _best_of_cell(queries: pa.Table, refs: pa.Table, rows: int, threshold: float) -> dict[str, np.ndarray]:
    """Each query's ``rows`` best references of one cell by (sim, ``order``), with the number of shared tokens.

    A token's list holds the references that have it; how often a reference comes in a query's lists is what both share.
    """
    refs = refs.sort_by("order")
    flat = lambda side: np.asarray(pa.concat_arrays(side.column("codes").chunks).flatten())
    r_size = refs.column("size").to_numpy().astype(np.int64)
    code = flat(refs)
    by_code = np.argsort(code, kind="stable")
    held = np.repeat(np.arange(len(r_size)), r_size)[by_code]
    known, first = np.unique(code[by_code], return_index=True)
    stop = np.append(first[1:], len(code))
    q_size = queries.column("size").to_numpy().astype(np.int64)
    code = flat(queries)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    at = np.where(known[at] == code, at, -1)
    ends = np.cumsum(q_size)
    found: list[tuple[np.ndarray, ...]] = []
    for i, (n, end) in enumerate(zip(q_size.tolist(), ends.tolist(), strict=True)):
        lists = [held[first[k] : stop[k]] for k in at[end - n : end].tolist() if k >= 0]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=len(r_size))
        # Of n tokens at least so many are shared, or the union is too large whatever the reference.
        some = np.flatnonzero(shared >= max(1, np.ceil(threshold * n - 1e-9)))
        both = shared[some]
        sim = both / (n + r_size[some] - both)
        if len(some) > rows:
            threshold_here = max(threshold, np.partition(sim, -rows)[-rows])
            some, both, sim = (x[sim >= threshold_here] for x in (some, both, sim))
        best = np.argsort(-sim, kind="stable")[:rows]
        best = best[sim[best] >= threshold]
        found.append((np.full(len(best), i), some[best], sim[best], both[best]))
    i, r, sim, both = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    number = lambda side, name, which: side.column(name).to_numpy()[which]
    return {"q_id": number(queries, "q_id", i), "r_id": number(refs, "r_id", r), "sim": sim.astype(float), "shared": both.astype(np.int32)}


def best_in_cells(queries: DataFrame, refs: DataFrame, blocks: list[str], rows: int, threshold: float, cell: tuple[int, int] = (CELL_QUERIES, CELL_REFS)) -> DataFrame:
    """Pairs at or above the threshold among which are each query's ``rows`` best by (sim, ``order`` of the reference), with
    sim and shared.

    A block is cut into cells of about ``cell`` queries and references, a task each. All pairs of a cell are counted in
    place, and at most ``rows`` rows a query leave it: the work is that of all pairs, memory and rows are not.
    """
    n = lambda side, name: side.groupBy(*blocks).agg(F.count("*").alias(name))
    sizes = n(queries, "q").join(n(refs, "r"), blocks)
    sizes = cut(sizes.selectExpr(*blocks, f"CAST(ceil(q / {cell[0]}) AS INT) AS q_cells", f"CAST(ceil(r / {cell[1]}) AS INT) AS r_cells"), "cells")
    tasks = sizes.agg(F.sum(F.expr("CAST(q_cells AS LONG) * r_cells"))).first()[0] or 1
    keys = [*blocks, "q_cell", "r_cell"]

    def dealt(side: DataFrame, t: str, other: str, columns: list[str]) -> DataFrame:
        own = f"CAST(pmod(xxhash64({t}_id), {t}_cells) AS INT) AS {t}_cell"
        every = f"explode(sequence(0, {other}_cells - 1)) AS {other}_cell"
        return side.join(sizes, blocks).selectExpr(*blocks, own, every, *columns).repartition(min(tasks, 20_000), *keys)

    asked = dealt(queries, "q", "r", ["q_id", "codes", "size"])
    held = dealt(refs, "r", "q", ["r_id", "codes", "size", "order"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("q_id", pa.int64()), ("r_id", pa.int64()), ("sim", pa.float64()), ("shared", pa.int32()))})
        return pa.table(_best_of_cell(left, right, rows, threshold))

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, "q_id long, r_id long, sim double, shared int")


def best_by_words(
    queries: DataFrame, refs: DataFrame, blocks: list[str], rows: int, first_read: int = 1000, rows_per_cell: int = 200_000,
) -> DataFrame:
    """Pairs among which are each query's ``rows`` best by (shared, sim, ``order`` of the reference), with sim and shared.

    A search with score bounds over lists ordered by impact. Round by round a query looks for references that share at
    least ``least`` words: its rarest words, one of which such a reference must hold with enough words behind it. A word's
    list is read up to the size by which ``first_read`` references are shorter, then from there on. A query leaves once its
    last needed score is above what any unread reference can reach; otherwise ``least`` falls to 0.7 of itself. Of
    references that share one word only, the first ``2 * rows`` of each list by (size, order) hold the best: fewer
    than ``rows`` of them can be known already, or the query had left.
    """
    queries, refs = _rare_first(queries, refs, blocks)
    keys = [*blocks, "code"]
    held = refs.selectExpr(*blocks, "r_id", "order", "size AS r_size", "posexplode(codes) AS (r_pos, code)")
    held = held.selectExpr(*keys, "r_id", "order", "r_size", "r_size - r_pos AS r_left")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("r_size"))
    sizes = held.groupBy(*keys, "r_size").agg(F.count("*").alias("n")).withColumn("upto", upto)
    lists = sizes.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("upto") >= first_read, F.col("r_size"))), F.max("r_size")).alias("head"), F.max("r_size").alias("longest"),
    )
    asked = queries.selectExpr(*blocks, "q_id", "size AS q_size", "posexplode(codes) AS (q_pos, code)").join(lists, keys)
    # Words of a query that any reference holds, from this one on; names are short.
    behind = F.count("*").over(Window.partitionBy("q_id").orderBy(F.desc("q_pos")))
    asked = cut(asked.withColumn("q_left", behind).drop("q_pos"), "asked-words")
    open_ = cut(asked.groupBy("q_id").agg(F.max("q_left").cast("int").alias("least")).withColumn("before", F.col("least") + 1), "open")
    found = None

    def read(now: DataFrame, part: str) -> None:
        nonlocal found
        met = _meet(now, held.drop("order"), keys, f"r_left >= least AND {part}", rows_per_cell)
        fresh = met if found is None else met.join(found.select("q_id", "r_id"), ["q_id", "r_id"], "left_anti")
        new = cut(_with_similarity(fresh, queries, refs, 0.0), "evaluated")
        found = new if found is None else found.unionByName(new)

    def settled(of: DataFrame) -> DataFrame:
        """``q_id`` and the score of its last needed reference, where it has that many."""
        first = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score")))
        scored = found.select("q_id", (F.col("shared") + F.col("sim")).alias("score")).join(of.select("q_id"), "q_id", "left_semi")
        return scored.withColumn("n", first).filter(F.col("n") == rows).select("q_id", F.col("score").alias("last"))

    while True:
        alone = open_.filter("least <= 1").select("q_id")
        open_ = open_.filter("least > 1")
        first = Window.partitionBy(*keys).orderBy("r_size", "order")
        single = asked.join(alone, "q_id", "left_semi")
        if not alone.isEmpty():
            wanted = held.join(single.select(*keys).distinct(), keys, "left_semi")
            heads = wanted.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= 2 * rows)
            met = single.select(*keys, "q_id").join(heads.select(*keys, "r_id"), keys).select("q_id", "r_id").distinct()
            fresh = met if found is None else met.join(found.select("q_id", "r_id"), ["q_id", "r_id"], "left_anti")
            new = cut(_with_similarity(fresh, queries, refs, 0.0), "evaluated")
            found = new if found is None else found.unionByName(new)
        if open_.isEmpty():
            break
        now = cut(asked.join(open_, "q_id").filter("q_left >= least"), "prefix-words")
        read(now, "r_size <= head")
        # What a reference behind the head can still reach: words from here on, fewer than those of earlier rounds.
        most, size = "least(q_left, before - 1)", "greatest(head + 1, least(q_left, before - 1))"
        tails = now.filter("longest > head").groupBy("q_id").agg(F.expr(f"max({most} + {most} / (q_size + {size} - {most}))").alias("bound"))
        state = open_.join(settled(open_), "q_id", "left").join(tails, "q_id", "left")
        state = cut(state, "round")
        more = state.filter("bound IS NOT NULL AND (last IS NULL OR last < least OR last <= bound)").select("q_id")
        if not more.isEmpty():
            read(now.join(more, "q_id", "left_semi").filter("longest > head"), "r_size > head")
            state = cut(open_.join(settled(open_), "q_id", "left"), "round")
        rest = state.filter("last IS NULL OR last < least")
        open_ = cut(rest.selectExpr("q_id", "greatest(1, CAST(floor(least * 0.7D) AS INT)) AS least", "least AS before"), "open")
    return queries.limit(0).selectExpr("q_id", "0L AS r_id", "0D AS sim", "0 AS shared") if found is None else found


# --- the joins on strings ------------------------------------------------------------------------------------------
def _on_strings(join, queries, refs, blocks, query, ref, tokens, threshold, payload, code) -> DataFrame:
    payload = payload or []
    q = encoded_sets(queries.select(*blocks, query, tokens), tokens, code, "q_id", "queries")
    r = encoded_sets(refs.select(*blocks, ref, *payload, tokens), tokens, code, "r_id", "references")
    found = join(q, r).join(q.select("q_id", *blocks, query), "q_id").join(r.select("r_id", ref, *payload), "r_id")
    return found.select(*blocks, query, ref, *payload, "sim", "shared")


def jaccard_join(
    queries: DataFrame, refs: DataFrame, blocks: list[str], query: str, ref: str, tokens: str, threshold: float,
    payload: list[str] | None = None, rows_per_cell: int = 200_000, code: str = TEXT_CODE,
) -> DataFrame:
    """All (block, query string, reference string) with similarity >= threshold, each once, with ``sim`` and ``shared``.

    ``queries`` and ``refs`` hold distinct strings per block with their token arrays; ``payload`` columns of ``refs``
    come along. Empty token sets match nothing.
    """
    join = lambda q, r: similar_pairs(q, r, blocks, threshold, rows_per_cell)
    return _on_strings(join, queries, refs, blocks, query, ref, tokens, threshold, payload, code)


def block_pairs(
    queries: DataFrame, refs: DataFrame, blocks: list[str], query: str, ref: str, tokens: str, threshold: float,
    payload: list[str] | None = None, code: str = TEXT_CODE,
) -> DataFrame:
    """The rows of ``jaccard_join`` from all pairs of a block, for blocks whose pair count is bounded."""
    join = lambda q, r: pairs_in_blocks(q, r, blocks, threshold)
    return _on_strings(join, queries, refs, blocks, query, ref, tokens, threshold, payload, code)
