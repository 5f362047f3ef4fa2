"""Language-model scores by stupid backoff, as joins of n-gram counts.

Documents are dealt into buckets of a few megabytes. A bucket asks for the counts of its distinct n-grams: one row for each
part of the hash space, with the n-grams' hashes as sorted differences and their counts in the bucket. Each part sums the
counts over all buckets and answers every bucket in the order asked; a bucket joins the answers to its documents' n-grams
and sums each document's scores. An n-gram is asked for once a bucket, however often it occurs, so frequent ones make no
large group; the number of buckets and parts follows the input.

Every n-gram is counted over all documents, and a document is scored by what the others hold: its own counts are taken
off, otherwise every n-gram would be known.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import word_count
from kinlink.llm.near import MULTIPLIER, WordHashes, mixed

#: Fixed value: the factor of each step back.
BACKOFF = 0.4
BUCKET_BYTES, PART_BYTES = 4 << 20, 8 << 20


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of one byte each, of which the high ones are mostly zeros and compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Grams:
    """N-grams of a bucket's texts: distinct keys, and for each order the key and document of every occurrence."""

    def __init__(self, texts: list[str | None], order: int, words: WordHashes):
        split = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        hashes = words.of([w for ws in split for w in ws])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        keys, self.ends, rolled = [], [], np.zeros(len(hashes), np.uint64)
        for n in range(1, order + 1):
            # Of the n-gram that ends at each word; only those inside one document count.
            rolled = np.concatenate([np.zeros(1, np.uint64), rolled[:-1]])[: len(rolled)] * MULTIPLIER + hashes
            if n == 1:
                rolled = hashes.copy()
            end = np.arange(n - 1, len(hashes))
            end = end[self.doc[end] == self.doc[end - n + 1]]
            self.ends.append(end)
            keys.append(mixed(rolled[end] + np.uint64(n)))
        self.keys, at, self.counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        self.at = np.split(at, np.cumsum([len(k) for k in keys])[:-1])

    def scores(self, totals: np.ndarray, n_words: int) -> np.ndarray:
        """Sum of the log scores of each document's words, counts of the document itself taken off."""
        last, words = None, len(self.doc)
        left = n_words - self.sizes[self.doc].astype(np.float64)
        best = np.zeros(words)
        for n, (end, at) in enumerate(zip(self.ends, self.at, strict=True), 1):
            code = self.doc[end] * len(self.keys) + at
            _, back, own = np.unique(code, return_inverse=True, return_counts=True)
            others = np.zeros(words)
            others[end] = totals[at].astype(np.float64) - own[back]
            if n == 1:
                # A word no other document holds counts as half an occurrence.
                best = np.log(np.maximum(others, 0.5) / np.maximum(left, 1.0))
            else:
                step = best + math.log(BACKOFF)
                known = others[end] > 0
                step[end[known]] = np.log(others[end[known]] / last[end[known] - 1])
                best = np.where(np.isin(np.arange(words), end), step, best)
            last = others
        return np.bincount(self.doc, best, len(self.sizes))


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every row.

    Words are what stands between ASCII white space. A word's score is the relative frequency of the longest n-gram that
    ends at it and occurs in other rows, times 0.4 for each shorter order; a first word has the first order only.

    Defined results: texts that are null or without words have score 0 and no mean; rows that repeat an id are scored
    each and count as others of one another; a table of one row is scored by half counts; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    size, n_words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0))).first()
    buckets, bits = size // BUCKET_BYTES + 1, max(3, math.ceil(math.log2(size / PART_BYTES + 1)))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, buckets), "bucket")

    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text").to_pylist(), order, WordHashes())
        bounds = np.searchsorted(grams.keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
        steps = np.diff(grams.keys, prepend=np.uint64(0))
        steps[bounds[:-1][np.diff(bounds) > 0]] = grams.keys[bounds[:-1][np.diff(bounds) > 0]]
        parts = np.flatnonzero(np.diff(bounds))
        cuts = [(bounds[p], bounds[p + 1]) for p in parts]
        return pa.table({
            "part": pa.array(parts, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int64()),
            "steps": pa.array([planes(steps[a:b]) for a, b in cuts], pa.binary()),
            "counts": pa.array([planes(grams.counts[a:b]) for a, b in cuts], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(s), dtype=np.uint64) for s in table.column("steps").to_pylist()]
        counts = np.concatenate([from_planes(c) for c in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, counts.astype(np.float64)).astype(np.uint64)[at]
        answers = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "totals": pa.array([planes(t) for t in answers], pa.binary())})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("text").to_pylist(), order, WordHashes())
        parts = np.argsort(answers.column("part").to_numpy(), kind="stable")
        totals = answers.column("totals").to_pylist()
        all_totals = np.concatenate([np.zeros(0, np.uint64), *[from_planes(totals[k]) for k in parts]])
        sums = grams.scores(all_totals, n_words)
        with np.errstate(invalid="ignore", divide="ignore"):
            means = np.where(grams.sizes > 0, sums / grams.sizes, np.nan)
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_words": pa.array(grams.sizes), "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array(means, pa.float64(), from_pandas=True),
        })

    asked = rows.groupBy("bucket").applyInArrow(ask, "part long, bucket long, steps binary, counts binary")
    answered = asked.repartition(max(least, 1 << bits), "part").groupBy("part").applyInArrow(answer, "bucket long, part long, totals binary")
    both = rows.groupBy("bucket").cogroup(answered.groupBy("bucket"))
    return both.applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
