"""String measures: golden values and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlink.functions import fuzzy as Z

WORDS = st.text("ABCDE ", max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_ratio(a, b):
    assert Z.ratio(a, b) == pytest.approx(ratio(a, b))
    assert Z.ratio(a, b) == pytest.approx(Z.ratio(b, a))


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_partial_is_best_window(a, b):
    if not a or not b:
        return
    sides = [(a, b), (b, a)] if len(a) == len(b) else [(a, b) if len(a) < len(b) else (b, a)]
    best = 0.0
    for short, long in sides:
        m, n = len(short), len(long)
        windows = [long[max(0, e - m):min(n, e)] for e in range(1, n + m)]
        best = max(best, *(ratio(short, w) for w in windows))
    assert Z.partial_ratio(a, b) == pytest.approx(best)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_bounds(a, b):
    for f in (Z.jaro_winkler, Z.token_sort_ratio, Z.token_set_ratio, Z.partial_ratio):
        assert 0.0 <= f(a, b) <= 1.0
        if a.strip():
            assert f(a, a) == 1.0


def test_golden():
    assert Z.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert Z.jaro_winkler("DWAYNE", "DUANE") == pytest.approx(0.84, abs=1e-4)
    assert Z.token_sort_ratio("fuzzy was a bear", "bear was fuzzy a") == 1.0
    assert Z.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert Z.partial_ratio("this is a test", "this is a test!") == 1.0


def test_batches_equal_single_pairs_whatever_their_lengths():
    """One batch of short, long, empty and odd strings: words of 64 bits with carries, chunks of like lengths."""
    rng = random.Random(5)
    alphabet = "AB CDÉ\x00😀"
    texts = ["", "A", "A" * 64, "AB" * 32, "AB" * 33, "A" * 200] + ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 9, 63, 64, 65, 130]))) for _ in range(60)]
    left, right = [rng.choice(texts) for _ in range(400)], [rng.choice(texts) for _ in range(400)]
    assert list(Z.common_lengths(left, right)) == [lcs(a, b) for a, b in zip(left, right, strict=True)]
    for batch, one in ((Z.jaro_winklers, Z.jaro_winkler), (Z.partial_ratios, Z.partial_ratio), (Z.ratios, Z.ratio)):
        assert list(batch(left, right)) == [one(a, b) for a, b in zip(left, right, strict=True)]


def jaro(a, b):
    """Straight from the definition, character by character."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                hits.append(c)
                break
    m = len(hits)
    swaps = sum(x != b[j] for x, j in zip(hits, sorted(used), strict=True)) // 2
    value = (m / len(a) + m / len(b) + (m - swaps) / m) / 3 if m else 0.0
    prefix = next((k for k in range(4) if a[k:k + 1] != b[k:k + 1] or k >= min(len(a), len(b))), 4)
    return value if value <= 0.7 else value + prefix * 0.1 * (1 - value)


@settings(max_examples=300, deadline=None)
@given(st.text("ABC", max_size=12), st.text("ABC", max_size=90))
def test_jaro_winkler(a, b):
    assert Z.jaro_winkler(a, b) == pytest.approx(jaro(a, b))
    assert Z.jaro_winkler(b, a) == pytest.approx(jaro(b, a))


def test_columns_split_words_like_python(spark):
    texts = ["A\u00a0B C", "C  B\tA ", "\u3000A\x1cB", "", " ", "É\u2003E", "B B A"]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", Z.fuzzy_measures("a", "b").alias("m"), Z.sorted_ratio("a", "b").alias("s"))
    for r in df.collect():
        assert (r.m.token_sort, r.m.token_set, r.s) == (Z.token_sort_ratio(r.a, r.b), Z.token_set_ratio(r.a, r.b), Z.token_sort_ratio(r.a, r.b))
        assert (r.m.jaro_winkler, r.m.partial) == (Z.jaro_winkler(r.a, r.b), Z.partial_ratio(r.a, r.b))
