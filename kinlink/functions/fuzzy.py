"""String measures Spark has no expression for, for whole Arrow batches of already paired strings.

A batch is cut into chunks of pairs of like lengths. In a chunk the characters are two matrices of code points, and where
they are equal is one bit per character of the one string for each character of the other. All measures advance such bit
vectors, for all pairs of the chunk at once, one numpy step per character. Words are split, sorted and compared as sets by
Spark's own functions before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send these few functions along with the job, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEASURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("jaro_winkler", "token_sort", "token_set", "partial")]
)
#: Most cells of the comparison of a chunk, one byte each.
MOST_CELLS = 1 << 25
#: All Unicode white space, and the four separators that count as such when words are split.
WHITE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


# --- chunks and bit vectors ----------------------------------------------------------------------------------------
def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _points(texts: list[str], lengths: np.ndarray, beyond: int) -> np.ndarray:
    """Code points, one row a text; ``beyond`` after its end."""
    width = max(1, int(lengths.max(initial=0)))
    points = np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width).copy()
    points[np.arange(width) >= lengths[:, None]] = beyond
    return points


def _chunks(bits: np.ndarray, steps: np.ndarray, same_bits: bool) -> Iterator[np.ndarray]:
    """Positions of pairs of like lengths: at most ``MOST_CELLS`` cells, and one number of bits if ``same_bits``."""
    width = bits if same_bits else -(-bits // 64)
    order = np.lexsort((steps, width))
    start = 0
    while start < len(order):
        last = int(np.searchsorted(width[order], width[order[start]], "right"))
        # Steps ascend: a chunk ends where its longest pair would make it too large.
        cells = (np.arange(1, last - start + 1)) * np.maximum(1, steps[order[start:last]]) * (-(-width[order[start]] // 64) * 64 if same_bits else max(1, width[order[start]]) * 64)
        stop = start + max(1, int(np.searchsorted(cells, MOST_CELLS, "right")))
        yield order[start:stop]
        start = stop


def _equal(bits: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """For each 64 characters of ``bits`` a word per pair and character of ``steps``: where the two are equal."""
    words = []
    for first in range(0, bits.shape[1], 64):
        same = bits[:, None, first : first + 64] == steps[:, :, None]
        packed = np.packbits(same, axis=-1, bitorder="little")
        full = np.zeros((*packed.shape[:2], 8), np.uint8)
        full[:, :, : packed.shape[2]] = packed
        words.append(full.view(np.uint64)[:, :, 0])
    return words


def _ones(n: np.ndarray) -> np.ndarray:
    """The lowest n bits set, n from 0 to 64."""
    table = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
    return table[np.clip(n, 0, 64)]


def _advance(rows: list[np.ndarray], hits: list[np.ndarray]) -> list[np.ndarray]:
    """One character of the longest common subsequence: zeros of the rows are its length. Sums carry from word to word."""
    out, carry = [], None
    for row, hit in zip(rows, hits, strict=True):
        shared = row & hit
        total = row + shared
        if len(rows) > 1:
            over = total < row
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64)
        out.append(total | (row & ~shared))
    return out


def _zeros(rows: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Zeros among the first ``size`` bits."""
    found = 0
    for k, row in enumerate(rows):
        found = found + np.bitwise_count(~row & _ones(size - 64 * k)).astype(np.int64)
    return found


# --- measures of a batch -------------------------------------------------------------------------------------------
def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    n, m = _lengths(left), _lengths(right)
    out = np.zeros(len(left), np.int64)
    swap = n > m
    for at in _chunks(np.minimum(n, m), np.maximum(n, m), False):
        short = [right[k] if swap[k] else left[k] for k in at]
        long = [left[k] if swap[k] else right[k] for k in at]
        size, steps = np.minimum(n, m)[at], np.maximum(n, m)[at]
        equal = _equal(_points(short, size, 0xFFFFFFFF), _points(long, steps, 0xFFFFFFFE))
        rows = [np.full(len(at), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in equal]
        for j in range(equal[0].shape[1]):
            rows = _advance(rows, [e[:, j] for e in equal])
        out[at] = _zeros(rows, size)
    return out


def _ratio_of(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the common subsequence over the summed lengths; 1 for two empty strings."""
    return _ratio_of(common_lengths(left, right), _lengths(left) + _lengths(right))


def set_ratios(shared: list[str], left_rest: list[str], right_rest: list[str]) -> np.ndarray:
    """Best ratio among the shared words and the shared words with either remainder, all given as sorted words.

    A common beginning belongs to the common subsequence, so only the remainders are compared.
    """
    s, a, b = _lengths(shared), _lengths(left_rest), _lengths(right_rest)
    gap = lambda rest: ((s > 0) & (rest > 0)).astype(np.int64)
    with_left, with_right = s + gap(a) + a, s + gap(b) + b
    common = s + gap(np.minimum(a, b)) + common_lengths(left_rest, right_rest)
    best = _ratio_of(common, with_left + with_right)
    contained = np.maximum(_ratio_of(s, s + with_left), _ratio_of(s, s + with_right))
    best = np.where(s > 0, np.maximum(best, contained), best)
    return np.where((with_left == 0) | (with_right == 0), 0.0, best)


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """Best ratio of the first string with a window of its length of the second, windows cut at both ends included."""
    m, n = _lengths(short), _lengths(long)
    out = np.zeros(len(short))
    for at in _chunks(m, n + 2 * m, True):
        size, steps = int(m[at[0]]), n[at]
        equal = _equal(_points([short[k] for k in at], m[at], 0xFFFFFFFF), _points([long[k] for k in at], steps, 0xFFFFFFFE))
        longest = equal[0].shape[1]
        # Nothing is equal outside the string: a window there is one that is cut.
        padded = [np.pad(e, ((0, 0), (size - 1, size - 1))) for e in equal]
        windows = longest + size - 1
        rows = [np.full((len(at), windows), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in equal]
        for k in range(size):
            rows = _advance(rows, [p[:, k : k + windows] for p in padded])
        end = np.arange(1, windows + 1)
        width = np.minimum(end, steps[:, None]) - np.maximum(end - size, 0)
        value = 2 * _zeros(rows, np.int64(size)) / (size + np.maximum(width, 0))
        out[at] = np.where(width > 0, value, 0.0).max(1)
    return out


def partial_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Best ratio of the shorter string with a window of the longer one; both ways if they are equally long."""
    n, m = _lengths(left), _lengths(right)
    out = ((n == 0) & (m == 0)).astype(float)
    full = np.flatnonzero((n > 0) & (m > 0))
    short = [left[k] if n[k] <= m[k] else right[k] for k in full]
    long = [right[k] if n[k] <= m[k] else left[k] for k in full]
    out[full] = _best_windows(short, long)
    even = np.flatnonzero((n == m) & (n > 0) & (out < 1.0))
    out[even] = np.maximum(out[even], _best_windows([right[k] for k in even], [left[k] for k in even]))
    return out


def jaro_winklers(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity, raised by a common prefix of up to four characters once it exceeds 0.7."""
    n, m = _lengths(left), _lengths(right)
    out = ((n == 0) & (m == 0)).astype(float)
    full = np.flatnonzero((n > 0) & (m > 0))
    for part in _chunks(m[full], n[full], False):
        at = full[part]
        la, lb = n[at], m[at]
        a, b = _points([left[k] for k in at], la, 0xFFFFFFFE), _points([right[k] for k in at], lb, 0xFFFFFFFF)
        equal = _equal(b, a)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        used = [np.zeros(len(at), np.uint64) for _ in equal]
        matched = np.zeros(a.shape, bool)
        for i in range(a.shape[1]):
            # The first unused equal character of the other string within reach.
            for w, e in enumerate(equal):
                near = _ones(np.minimum(lb, i + reach + 1) - 64 * w) & ~_ones(i - reach - 64 * w)
                free = e[:, i] & near & ~used[w]
                if w:
                    free = np.where(matched[:, i], np.uint64(0), free)
                used[w] |= free & (~free + np.uint64(1))
                matched[:, i] |= free != 0
        flags = np.unpackbits(np.stack(used, 1).view(np.uint8), axis=1, bitorder="little")[:, : b.shape[1]]
        # Both sides list their matched characters row by row in order, so the k-th of one faces the k-th of the other.
        rows, cols = np.nonzero(matched)
        apart = a[rows, cols] != b[np.nonzero(flags)]
        found = matched.sum(1)
        swaps = np.bincount(rows, apart, len(at)).astype(np.int64) // 2
        some = np.maximum(found, 1)
        jaro = np.where(found > 0, (found / la + found / lb + (found - swaps) / some) / 3, 0.0)
        width = min(4, a.shape[1], b.shape[1])
        prefix = np.cumprod(a[:, :width] == b[:, :width], axis=1).sum(1)
        out[at] = np.where(jaro <= 0.7, jaro, jaro + prefix * 0.1 * (1 - jaro))
    return out


# --- one pair ------------------------------------------------------------------------------------------------------
def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    return float(set_ratios(*[[" ".join(sorted(x))] for x in (left & right, left - right, right - left)])[0])


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winklers([a], [b])[0])


# --- columns -------------------------------------------------------------------------------------------------------
def _words(c: str) -> Column:
    return F.array_remove(F.split(F.col(c), WHITE), "")


def _joined(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


@F.pandas_udf(MEASURES)
def _measure_batch(
    a: pd.Series, b: pd.Series, sorted_a: pd.Series, sorted_b: pd.Series, shared: pd.Series, rest_a: pd.Series, rest_b: pd.Series
) -> pd.DataFrame:
    a, b, sorted_a, sorted_b, shared, rest_a, rest_b = (s.tolist() for s in (a, b, sorted_a, sorted_b, shared, rest_a, rest_b))
    values = jaro_winklers(a, b), ratios(sorted_a, sorted_b), set_ratios(shared, rest_a, rest_b), partial_ratios(a, b)
    return pd.DataFrame(dict(zip([f.name for f in MEASURES.fields], values, strict=True)))


@F.pandas_udf(T.DoubleType())
def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()))


def fuzzy_measures(a: str, b: str) -> Column:
    """All four measures of a pair in one hop to Python."""
    left, right = _words(a), _words(b)
    sets = F.array_intersect(left, right), F.array_except(left, right), F.array_except(right, left)
    return _measure_batch(F.col(a), F.col(b), _joined(left), _joined(right), *[_joined(s) for s in sets])


def sorted_ratio(a: str, b: str) -> Column:
    """The word-order-free ratio alone."""
    return _ratio_batch(_joined(_words(a)), _joined(_words(b)))
