"""Language identification by rank-order profiles of character n-grams.

A language is the list of its most frequent n-grams; a document's own list is compared with each by the out-of-place
distance: how far each n-gram's rank is from its rank in the language, the list length where it is missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import attach_small, returning_memory
from kinlink.session import cut

#: Code points counted at once, which bounds the memory of one text.
CHUNK = 1_000_000


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; is it a letter or a mark that stands with one."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three characters, packed as 21 bits each and sorted, and their counts; none without a letter.

    Letters are lower-cased, all else is one blank, words are padded by blanks and n-grams stay within a word.
    """
    letter, within = letters()
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[32], np.where(within[points], points, 32), [32]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    found, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first in range(0, len(codes), CHUNK):
        c = codes[first : first + CHUNK + 2]
        one = c[:CHUNK]
        two = (c[:-1] << 21 | c[1:])[:CHUNK]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:CHUNK]
        grams = np.concatenate([one[one != 32], two, three[c[1:-1][:CHUNK] != 32]])
        new, n = np.unique(grams, return_counts=True)
        if not first:
            found, numbers = new, n
            continue
        both, at = np.unique(np.concatenate([found, new]), return_inverse=True)
        found, numbers = both, np.bincount(at, np.concatenate([numbers, n])).astype(np.int64)
    return found, numbers


def in_sample(doc_id: Column, share: Column) -> Column:
    """A share of the documents, chosen by a hash of the id."""
    return (F.pmod(F.xxhash64(doc_id, F.lit("profile")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share


def fit_profiles(labelled: DataFrame, per_language: int = 2_000, length: int = 300) -> DataFrame:
    """``lang, gram, rank`` of the ``length`` most frequent n-grams of each language, ties by n-gram.

    ``labelled`` has ``doc_id, text, lang``. About ``per_language`` whole documents of each language are counted, chosen by
    a hash of their id; that bound is the only sampling.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    share = cut(labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("_share")), "language-share")
    sample = attach_small(labelled, share, ["lang"]).where(in_sample(F.col("doc_id"), F.col("_share"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, n = ngram_counts(text)
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(returning_memory(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < length)
    return cut(top.select("lang", "gram", "rank"), "language-profiles")


class Profiles:
    """The profiles as one table of ranks: a row for each n-gram of any language, a column for each language."""

    def __init__(self, rows: list, length: int):
        self.length = length
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for r in rows:
            self.ranks[np.searchsorted(self.grams, r["gram"]), self.langs.index(r["lang"])] = r["rank"]

    def best(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 less the distance as a share of the largest possible."""
        grams, n = ngram_counts(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        top = grams[np.argsort(-n, kind="stable")[: self.length]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == top, at, len(self.grams))]
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        k = int(apart.argmin())
        return self.langs[k], float(1.0 - apart[k] / (self.length * len(top)))


def identify(docs: DataFrame, profiles: DataFrame, length: int = 300) -> DataFrame:
    """All columns of ``docs``, with ``lang_pred`` and ``score`` (0 to 1) from the text alone.

    The profiles come to the driver: at most ``length`` rows a language. Defined results: a text that is null or has no
    letter is ``und`` with score 0, and so is every text if nothing was learned; rows are judged one by one, repeated
    ones alike; columns named as the two new ones are replaced; an empty table gives an empty result.
    """
    model = Profiles(profiles.collect(), length)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.best(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(returning_memory(judge), f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One fold of five, by the checksum of the id as text; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def languages(docs: DataFrame, per_language: int = 2_000, length: int = 300) -> DataFrame:
    """``doc_id, text, held_out, lang_pred, score`` of every document, learned from the folds that are not held out."""
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), per_language, length)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, profiles, length)
