"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

The CGK random walk turns a word sequence into a longer one in which it stays on a word or goes on, by a random bit for
(step, word). Two sequences a few edits apart fall into step again, so their embeddings have a small Hamming distance, and
a few sampled coordinates of both agree with fair probability. The distance grows with the square of the edits, so items of
more than ``PART`` words are looked for by parts of that many words: if an item has at most a fifth of its words edited, so
has one of its parts. Each part has one signature for each walk and sample; where a window of a document shares one with a
part, the whole item is compared by edit distance with the passages around it.

The benchmark is a query set: blocks of at most ``BLOCK`` items go to the tasks, all documents pass once a block, and no
document is shuffled. Before embedding, an exact count leaves out windows that no part of their size can match: a part of
m words with at most k edits keeps m - 1 - 2k of its word pairs, and the first of them begins at most 2k words after the
passage. Every position that allows for both is tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import MOST_IDS, returning_memory
from kinlink.session import cut

BLOCK = 20_000
PART, WALKS, SAMPLES, WIDTH = 10, 6, 16, 3
MIX = np.uint64(0xD6E8FEB86659FD93)
PAIRS = "doc_id long, item_id long, position long, n_item long, distance long"


def normal_words(text: str | None) -> list[str]:
    """Words between white space in lower case, letters and digits only; words without any are left out."""
    return [w for w in ("".join(filter(str.isalnum, t)) for t in (text or "").lower().split()) if w]


def allowed_edits(n: int, percent: int) -> int:
    return n * (100 - percent) // 100


class Vocabulary(dict):
    """Raw token -> number of the item word it is (from 1), 0 for any other word, -1 for no word."""

    def __init__(self, words: dict[str, int], most: int = 150_000):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, token: str) -> int:
        if len(self) > self.most:
            self.clear()
        word = "".join(filter(str.isalnum, token))
        self[token] = code = self.words.get(word, 0) if word else -1
        return code


class Parts:
    """Item parts of one length: how long their windows are, how many word pairs those keep, and all signatures."""

    def __init__(self, length: int, parts: list[tuple[int, int, np.ndarray]], percent: int, seed: int):
        """``parts`` are (number of the item, place of the part in it, words of the item from there on)."""
        edits = allowed_edits(length, percent)
        self.span, self.reach, self.need = length + edits, 2 * edits, max(1, length - 1 - 2 * edits)
        self.steps = 2 * length
        self.item, self.place = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        random = np.random.default_rng(seed + length)
        self.seeds = random.integers(0, 2**63, (WALKS, self.steps), np.uint64)
        self.samples = [[np.sort(random.choice(self.steps, min(WIDTH, self.steps), replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        table = np.full((len(parts), self.span), -9, np.int64)
        for row, (_, _, words) in zip(table, parts, strict=True):
            row[: len(words)] = words[: self.span]
        self.index = []
        for signature in self.signatures(table):
            order = np.argsort(signature, kind="stable")
            self.index.append((signature[order], order))

    def signatures(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """One signature of each window for each walk and sample."""
        rows, last = np.arange(len(windows)), windows.shape[1] - 1
        for seeds, samples in zip(self.seeds, self.samples, strict=True):
            at = np.zeros(len(windows), np.int64)
            walked = np.empty((self.steps, len(windows)), np.uint64)
            for step in range(self.steps):
                word = windows[rows, np.minimum(at, last)].astype(np.uint64)
                walked[step] = word
                at += (((word + seeds[step]) * MIX) >> np.uint64(63)).astype(np.int64)
            for sample in samples:
                total = np.zeros(len(windows), np.uint64)
                for step in sample:
                    total = (total ^ walked[step]) * MIX
                    total ^= total >> np.uint64(29)
                yield total

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Distinct windows and parts that share a signature, in two rows."""
        found = [np.zeros(0, np.int64)]
        for signature, (keys, order) in zip(self.signatures(windows), self.index, strict=True):
            left, right = np.searchsorted(keys, signature), np.searchsorted(keys, signature, "right")
            n = right - left
            if n.any():
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.repeat(np.arange(len(windows)) * len(self.item), n) + order[np.repeat(left, n) + within])
        return np.stack(np.divmod(np.unique(np.concatenate(found)), len(self.item)))


def edit_distances(items: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Smallest edit distance of each item to a beginning of its window; all items as long as each other."""
    return _table_end(items, windows, np.arange(windows.shape[1] + 1), 1).min(1)


def nearest_passages(items: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each item to any passage of its window, and the first place such a passage begins."""
    # A cell holds distance and beginning in one number, which the smallest of several compares in this order.
    unit = windows.shape[1] + 1
    return np.divmod(_table_end(items, windows, np.arange(unit), unit, free=True).min(1), unit)


def _table_end(items: list[np.ndarray], windows: np.ndarray, columns: np.ndarray, unit: int, free: bool = False) -> np.ndarray:
    """Last row of the edit tables of all items at once, an edit counting ``unit``; ``free`` passages begin anywhere."""
    row = np.broadcast_to(columns, (len(items), len(columns))).astype(np.int64)
    costs = columns * unit
    for k, word in enumerate(np.array(items).T):
        step = np.minimum(row[:, 1:] + unit, row[:, :-1] + unit * (windows != word[:, None]))
        step = np.concatenate([np.full((len(items), 1), (k + 1) * unit), step], 1)
        row = np.minimum.accumulate(step - costs, 1) + costs
    return row


class ItemBlock:
    """A bounded part of the benchmark, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str | None]], percent: int, seed: int = 11):
        self.percent, self.words = percent, {}
        coded = []
        for number, text in rows:
            words = normal_words(text)
            if len(words) > 1 and number is not None:
                coded.append((number, np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64)))
        self.items, self.numbers = [i for _, i in coded], np.array([n for n, _ in coded])
        by_length: dict[int, list] = {}
        for k, item in enumerate(self.items):
            length = min(PART, len(item))
            for place in {*range(0, len(item) - length + 1, length), len(item) - length}:
                by_length.setdefault(length, []).append((k, place, item[place:]))
        self.parts = [Parts(length, parts, percent, seed) for length, parts in by_length.items()]
        pairs = [i[:-1] * (len(self.words) + 1) + i[1:] for _, i in coded]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def search(self, texts: list[str | None], vocabulary: Vocabulary) -> list[tuple[int, int, int, int, int]]:
        """(text, item, word position, item words, distance) of verified matches, the best of each passage among them."""
        tokens = [(t or "").lower().split() for t in texts]
        codes = np.fromiter((c for ws in tokens for c in map(vocabulary.__getitem__, ws)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(ws) for ws in tokens])
        codes, text = codes[codes >= 0], text[codes >= 0]
        if len(codes) < 2 or not len(self.pairs):
            return []
        pair = codes[:-1] * (len(self.words) + 1) + codes[1:]
        hit = (codes[:-1] > 0) & (codes[1:] > 0) & (text[1:] == text[:-1])
        at = np.flatnonzero(hit)
        hit[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)] == pair[at]
        if not hit.any():
            return []
        begins = np.searchsorted(text, np.arange(len(texts) + 1))
        total = np.concatenate([[0], np.cumsum(hit)])
        # Before the first kept pair, each kept word is followed by an edit: it begins within 2k words of the passage.
        reached = lambda starts, reach: starts[total[np.minimum(starts + reach + 1, len(hit))] > total[starts]]
        near = reached(np.arange(len(hit)), max(g.reach for g in self.parts))
        placed = []
        for group in self.parts:
            starts = reached(near, group.reach)
            ends = np.minimum(starts + group.span, begins[text[starts] + 1])
            starts = starts[total[ends - 1] - total[starts] >= group.need]
            for some in np.array_split(starts, len(starts) // 5000 + 1):
                if len(some):
                    windows = self.windows(codes, begins[text[some] + 1], some, group.span)
                    window, part = group.candidates(windows)
                    placed.append(np.stack([some[window] - group.place[part], group.item[part], text[some[window]]], 1))
        return self.verified(codes, total, begins, np.concatenate(placed)) if placed else []

    @staticmethod
    def windows(codes: np.ndarray, ends: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
        """``span`` words from each start on, -9 for those behind the end of its text."""
        where = starts[:, None] + np.arange(span)
        return np.where(where < ends[:, None], codes[np.minimum(where, len(codes) - 1)], -9)

    def verified(self, codes: np.ndarray, total: np.ndarray, begins: np.ndarray, placed: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The passage nearest to the whole item around each (position, item, text)."""
        found = []
        lengths = np.array([len(i) for i in self.items])[placed[:, 1]]
        for n in np.unique(lengths).tolist():
            k = allowed_edits(n, self.percent)
            these = placed[lengths == n]
            # A passage begins at most k words from where its part puts it; places of a few words are looked at together.
            these[:, 0] //= k + 1
            low, width = these[:, 0].min(), np.ptp(these[:, 0]) + 1
            pair, place = np.divmod(np.unique((these[:, 2] * len(self.items) + these[:, 1]) * width + these[:, 0] - low), width)
            these = np.stack([(place + low) * (k + 1), pair % len(self.items), pair // len(self.items)], 1)
            first, end, span = begins[these[:, 2]], begins[these[:, 2] + 1], n + 4 * k + 1
            left = np.clip(these[:, 0] - k, first, end - 1)
            right = np.minimum(left + span, end)
            enough = total[right - 1] - total[left] >= max(1, n - 1 - 2 * k)
            these, left, first, end = these[enough], left[enough], first[enough], end[enough]
            for some in np.array_split(np.arange(len(these)), len(these) * span // 2_000_000 + 1):
                if len(some):
                    windows = self.windows(codes, end[some], left[some], span)
                    apart, at = nearest_passages([self.items[i] for i in these[some, 1]], windows)
                    for j in np.flatnonzero(apart <= k):
                        _, item, text = these[some[j]].tolist()
                        position = int(left[some[j]] + at[j] - first[some[j]])
                        found.append((text, int(self.numbers[item]), position, n, int(apart[j])))
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, position, n_item, distance``: documents with a passage of words close to a benchmark item.

    Words are compared in lower case without marks. A passage counts if its edit distance to the item, in words, is at
    most ``100 - percent`` per cent of the item's words; the best position of each pair is returned. Verbatim passages are
    always found; with edits the signatures find them with high probability (measured in the tests).

    Defined results: null and empty texts hold no passage; items with fewer than two words and items without id match
    nothing; documents without id count as one, rows that repeat an id too; empty tables give an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    items = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    found = None
    while block := [tuple(r) for r in islice(items, BLOCK)]:
        model = ItemBlock(block, percent)

        def search(batches: Iterator[pa.RecordBatch], model: ItemBlock = model) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(model.words)
            names = ["doc_id", "item_id", "position", "n_item", "distance"]
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    some = batch.slice(first, 500)
                    ids = some.column(0).to_pylist()
                    hits = model.search(some.column(1).to_pylist(), vocabulary)
                    best: dict = {}
                    for k, item, position, n, d in hits:
                        key = (ids[k], item)
                        best[key] = min(best.get(key, (d, position, n)), (d, position, n))
                    columns = [[k[0] for k in best], [k[1] for k in best], [v[1] for v in best.values()], [v[2] for v in best.values()], [v[0] for v in best.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        part = rows.mapInArrow(returning_memory(search), PAIRS)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], PAIRS)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "position", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.position", "best.n_item", "best.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark passage, with all columns; rows without id stay."""
    bad = cut(leaks(docs, benchmark, percent).select("doc_id").distinct(), "leaking")
    few = bad.count() <= MOST_IDS
    return docs.join(F.broadcast(bad) if few else bad, "doc_id", "left_anti").select(*docs.columns)
