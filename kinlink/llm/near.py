"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

One hash function orders all shingles. A document's sketch is its k smallest hash values. Inverted lists over retained
values bring candidates together; a candidate's similarity is estimated from the k smallest values of the union of two
sketches; what may reach the threshold is verified on the full sets. Equal sets form one class first, so groups of exact
copies cost one member.

Lists: a document with fewer than ``SMALL`` shingles enters the lists of its smallest values, as many as make sharing one
certain for a linked pair. One with at least ``LARGE`` enters a list for each pair of neighbouring values among its
``RETAINED`` smallest; a pair at similarity 0.8 then shares no list with probability below 1e-9. Every linked pair has two
members of at least one of the kinds.

No list emits its pairs. Its members are compared in blocks on sketches, and each pair of blocks emits the edges that connect
its candidates, each to the first of its part; members that are all connected are not compared further. Connected candidates
form clusters, and each cluster is compared on full sets in the same way. Components need no more than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import MOST_DIGESTS, MOST_IDS, attach_small, returning_memory
from kinlink.session import cut

K, RETAINED, SMALL, LARGE = 32, 32, 100, 64
#: An estimate this far below the threshold rejects a pair. A pair at 0.8 then goes with 9 or fewer of K = 32 common values,
#: by the binomial distribution with probability 3.5e-10.
SLACK = 0.49
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SETS = "doc_id long, n_shingles long, node binary, sketch array<bigint>"


class WordHashes(dict):
    """Word -> position of its 64-bit hash; forgotten when too many words are held."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most, self.made, self.hashes = most, [], np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.made.append(xxhash.xxh3_64_intdigest(word))
        self[word] = at = len(self)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.hashes = np.zeros(0, np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.made:
            self.hashes = np.concatenate([self.hashes, np.array(self.made, np.uint64)])
            self.made = []
        return self.hashes[at]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], n: int, words: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of fewer words the whole sequence is one shingle."""
    split = [(t or "").encode().lower().split() for t in texts]
    hashes = words.of([w for ws in split for w in ws])
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * MULTIPLIER + hashes[k : len(hashes) - n + 1 + k]
    rolled = mixed(rolled)
    sets, at = [], 0
    for ws in split:
        if len(ws) >= n:
            sets.append(np.unique(rolled[at : at + len(ws) - n + 1]))
        elif ws:
            one = np.uint64(len(ws))
            with np.errstate(over="ignore"):
                for h in hashes[at : at + len(ws)]:
                    one = one * MULTIPLIER + h
            sets.append(mixed(np.array([one ^ MIX])))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += len(ws)
    return sets


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, node, sketch`` of every row; ``node`` is a digest of the whole set, null for an empty one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                sets = shingle_sets(some.column(1).to_pylist(), n, words)
                small = [s[:K].view(np.int64) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in small])]).astype(np.int32)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(small)))
                columns = [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning_memory(sketch), SETS)


def list_keys(n: int, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the inverted lists of one sketch (sorted as unsigned)."""
    keys = []
    if n < SMALL:
        keys.append(mixed(sketch[: min(K, n - -(-percent * n // 100) + 1)] ^ MIX))
    if n >= LARGE:
        keys.append(mixed(sketch[: RETAINED - 1] * MULTIPLIER + sketch[1:RETAINED]))
    return np.unique(np.concatenate(keys))


def listed(classes: DataFrame, percent: int) -> DataFrame:
    """``key, node`` of every class and each of its lists."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [list_keys(n, np.array(s, np.int64).view(np.uint64), percent) for n, s in zip(sizes, batch.column(2).to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(at))], ["key", "node"])

    return classes.select("node", "n_shingles", "sketch").mapInArrow(returning_memory(lists), "key long, node binary")


def unsigned(lists: list) -> list[np.ndarray]:
    return [np.array(s, np.int64).view(np.uint64) for s in lists]


NONE = np.uint64(2**64 - 1)


def union_estimates(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Share of common values among the K smallest of the union, for pairs of rows of a table of sketches.

    Rows are filled up with ``NONE``. Exact where the union has at most K values.
    """
    both = np.sort(np.concatenate([table[i], table[j]], 1), 1)
    twice = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(np.concatenate([np.ones((len(i), 1), bool), ~twice], 1), 1)
    real = both != NONE
    united = np.minimum(K, np.where(real, rank, 0).max(1))
    return (twice & real[:, 1:] & (rank[:, 1:] <= K)).sum(1) / united


def groups_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, about ``most`` rows each, and where the groups begin."""
    held: list[pa.Table] = []

    def begins(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for name in names:
            codes = rows.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= most:
            rows = pa.concat_tables(held).combine_chunks()
            starts = begins(rows)
            # The last group may go on in the next batch.
            if starts[-1]:
                yield rows.slice(0, starts[-1]), starts[:-1]
            held = [rows.slice(starts[-1])]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, begins(rows)


def meetings(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For one set after the other, how many values it has in common with each: by one sorted table of (value, set)."""
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    for s in sets:
        left, right = np.searchsorted(value, s), np.searchsorted(value, s, "right")
        times = right - left
        at = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
        yield np.bincount(owner[at], minlength=len(sets))


def forest(n: int, linked: Iterator[np.ndarray]) -> list[tuple[int, int]]:
    """The first member of each connected part with each of its others; all block pairs that share it say the same.

    ``linked`` gives, for one member after the other, the members it is linked with.
    """
    part = np.arange(n)
    for k, others in enumerate(linked):
        others = others[part[others] != part[k]]
        if len(others):
            part[np.isin(part, part[others])] = part[k]
            if (part == part[0]).all():
                break
    _, first, at = np.unique(part, return_index=True, return_inverse=True)
    return [(int(first[at[k]]), k) for k in np.flatnonzero(first[at] != np.arange(n)).tolist()]


def dealt_blocks(rows: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Rows repeated for every pair of blocks of about ``block`` members of their group: ``low, high, own``."""
    rows = rows.withColumn("_blocks", F.ceil(F.col(count) / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other"))
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def named_edges(rows: pa.Table, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes = rows.column("node").combine_chunks()
    return pa.RecordBatch.from_arrays([nodes.take(pa.array([e[k] for e in edges], pa.int64())) for k in range(2)], ["a", "b"])


def candidate_forest(members: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """``a, b``: edges that connect the pairs of a list whose sizes and estimate allow a link, and no others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups_of(batches, ("key", "low", "high"), 20_000):
            stops = np.append(starts[1:], rows.num_rows)
            low, high, own, sizes = (rows.column(n).to_numpy() for n in ("low", "high", "own", "n_shingles"))
            lists = rows.column("sketch").combine_chunks()
            values, lengths = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            sets = np.split(values, np.cumsum(lengths)[:-1])
            table = np.full((rows.num_rows, K), NONE)
            table[np.repeat(np.arange(rows.num_rows), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
            edges: list[tuple[int, int]] = []

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])  # noqa: B023
                good = (100 * small >= percent * large) & ((low[i] == high[i]) | (own[i] != own[j]))  # noqa: B023
                where = np.flatnonzero(good)
                for some in range(0, len(where), 5000):
                    these = where[some : some + 5000]
                    slack = np.where(large[these] <= K // 2, 0.0, SLACK)
                    good[these] = union_estimates(table, i[these], j[these]) >= percent / 100 - slack - 1e-9  # noqa: B023
                return good

            for n in np.unique(stops - starts):
                first = starts[stops - starts == n]
                if n > 64:
                    for start in first:

                        def linked(start: int = start, n: int = n) -> Iterator[np.ndarray]:
                            for k, common in enumerate(meetings(sets[start : start + n])):  # noqa: B023
                                near = np.flatnonzero(common >= (percent / 100 - SLACK) * min(K, sizes[start + k] * percent // 100))  # noqa: B023
                                yield near[allowed(np.full(len(near), start + k), near + start)]  # noqa: B023

                        edges += [(start + x, start + y) for x, y in forest(n, linked())]
                    continue
                i, j = np.triu_indices(n, 1)
                i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                good = allowed(i, j)
                up: dict[int, int] = {}

                def top(x: int, up: dict[int, int] = up) -> int:
                    while x in up:
                        x = up[x]
                    return x

                for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    a, b = sorted((top(x), top(y)))
                    if a != b:
                        up[b] = a
                edges += [(top(x), x) for x in up]
            yield named_edges(rows, edges)

    rows = dealt_blocks(members.join(classes.select("node", "n_shingles", "sketch"), "node"), "key", "n_members", block)
    rows = rows.select("key", "low", "high", "own", "node", "n_shingles", "sketch")
    return cut(rows.mapInArrow(returning_memory(compare), "a binary, b binary").distinct(), "near-candidates")


def verified_links(clusters: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """``a, b``: edges that connect the linked classes of a cluster of candidates, by the full sets, and no others.

    The text of one row of each class is fetched by id and its set computed again.
    """
    placed = clusters.withColumnRenamed("label", "cluster").join(classes.select("node", F.col("first_id").alias("doc_id")), "node")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n_cluster"))
    placed = cut(placed.join(sizes, "cluster"), "near-clusters")
    few = placed.count() <= MOST_DIGESTS
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(placed) if few else placed, "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for rows, starts in groups_of(batches, ("cluster", "low", "high"), 2_000):
            sets = []
            texts = rows.column("text").to_pylist()
            for first in range(0, len(texts), 250):
                sets += shingle_sets(texts[first : first + 250], n, words)
            own, low, high, nodes = (rows.column(x).to_pylist() for x in ("own", "low", "high", "node"))
            # Rows may repeat an id with another text: only those whose set is the class's own count.
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, nodes, strict=True)]
            edges: list[tuple[int, int]] = []
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                these = [k for k in range(start, stop) if right[k]]
                if len(these) > 1:
                    mine = [sets[k] for k in these]
                    lengths, blocks = np.array([len(s) for s in mine]), np.array([own[k] for k in these])
                    apart = low[start] != high[start]

                    def linked(mine: list = mine, lengths: np.ndarray = lengths, blocks: np.ndarray = blocks, apart: bool = apart) -> Iterator[np.ndarray]:
                        for k, same in enumerate(meetings(mine)):
                            yield np.flatnonzero((100 * same >= percent * (lengths + lengths[k] - same)) & ~(apart & (blocks == blocks[k])))

                    edges += [(these[x], these[y]) for x, y in forest(len(these), linked())]
            yield named_edges(rows, edges)

    rows = dealt_blocks(texts, "cluster", "n_cluster", block).select("cluster", "low", "high", "own", "node", "text")
    return cut(rows.mapInArrow(returning_memory(compare), "a binary, b binary").where("a != b").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``a, b`` links: the smallest node reachable.

    Each round takes the smallest label among neighbours, then the label of that label; paths halve, and each round's
    labels are written.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "near-labels")
    while True:
        seen = edges.join(labels.toDF("b", "seen"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("near"))
        far = labels.toDF("near", "far")
        step = step.join(far, "near").select("node", "was", F.least("near", "far").alias("label"))
        step = cut(step, "near-labels")
        labels = step.select("node", "label")
        if step.where("was != label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are what stands between ASCII white space, A-Z in lower case; a document's set are its distinct n-word shingles.
    Documents are linked if ``100 * intersection >= percent * union``. ``component_id`` is the smallest id reachable,
    ``kept`` says whether it is the row's own.

    Defined results: a text that is null or has no word has an empty set and is linked with nothing; rows without id are
    linked by their text, are never ``kept`` beside a row with one, and have no component id where no linked row has an
    id; rows that repeat an id are judged by their own texts; an empty table gives an empty result; other columns are
    not read.
    """
    sets = cut(sketches(docs, n), "near-sets")
    full = sets.where("node IS NOT NULL")
    classes = full.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
    )
    classes = cut(classes, "near-classes")
    # A class without any id cannot be fetched again by id; it stays alone.
    keys = listed(classes.where("first_id IS NOT NULL"), percent)
    keys = cut(keys, "near-keys")
    again = keys.groupBy("key").agg(F.count("*").alias("n_members")).where("n_members > 1")
    members = cut(keys.join(again, "key"), "near-members")
    clusters = components(candidate_forest(members, classes, percent, block))
    labels = components(verified_links(clusters, classes, docs, n, percent, block))
    placed = classes.select("node", "first_id", "n_rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("first_id").alias("component_id"), F.sum("n_rows").alias("rows")).where("rows > 1")
    joint = cut(placed.join(smallest, "label").select("node", "component_id"), "near-components")
    rows = attach_small(sets.select("doc_id", "n_shingles", "node"), joint, ["node"])
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near duplicates, with all columns.

    The row with the group's smallest id stays, one row where rows repeat an id and text. Rows without id stay.
    """
    judged = cut(near_duplicates(docs, n, percent).select("doc_id", "kept"), "near-judged")
    # An id that repeats with other texts goes only if none of its rows is kept.
    drop = cut(judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "near-ids")
    gone = drop.where("NOT kept").select("doc_id")
    few = gone.count() <= MOST_IDS
    rows = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = drop.where("kept AND n > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    twice = rows.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return rows.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)
