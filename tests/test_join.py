"""The set join against brute force, with one block, one token and one string holding much of the data."""

import random

import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.operators.candidates import name_candidates, name_search
from kinlink.operators.setjoin import TEXT_CODE, TRIGRAM_CODE, _meet, _rare_first, best_in_cells, block_pairs, encoded_sets, jaccard_join


def grams(s):
    return {f"  {w} "[i:i + 3] for w in s.lower().split() for i in range(len(w) + 1)}


def jac(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def skewed(n, seed):
    rng = random.Random(seed)
    words = ["GARAGE", "AUTO", "PNEUS", "GOLFE", "PACHA", "RELAIS", "CORSE", "CARROSSERIE", "NICE", "ROUTE", "ATELIER"]
    rows = []
    for i in range(n):
        block = "hot" if rng.random() < 0.5 else f"b{rng.randrange(5)}"
        text = "GARAGE AUTO" if rng.random() < 0.3 else "GARAGE " + " ".join(rng.sample(words[1:], rng.randrange(1, 4)))
        rows.append((f"{seed}-{i:04d}", block, text))
    return rows


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
@pytest.mark.parametrize("rows_per_cell", [7, 200_000])
@pytest.mark.parametrize("code", [TRIGRAM_CODE, TEXT_CODE])
def test_join_equals_brute_force(spark, threshold, rows_per_cell, code):
    left, right = ({(b, t) for _, b, t in skewed(120, seed)} for seed in (1, 2))
    q = spark.createDataFrame(sorted(left), "block string, q string").withColumn("tokens", S.trigrams(F.col("q")))
    r = spark.createDataFrame(sorted(right), "block string, r string").withColumn("tokens", S.trigrams(F.col("r")))
    got = jaccard_join(q, r, ["block"], "q", "r", "tokens", threshold, rows_per_cell=rows_per_cell, code=code).collect()
    want = {(b, x, y): jac(x, y) for b, x in left for c, y in right if b == c and jac(x, y) >= threshold}
    assert len(got) == len(want)
    assert {(g.block, g.q, g.r): pytest.approx(g.sim) for g in got} == want


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_block_pairs_equal_the_prefix_join(spark, threshold):
    left, right = ({(b, t) for _, b, t in skewed(80, seed)} for seed in (5, 6))
    q = spark.createDataFrame(sorted(left), "block string, q string").withColumn("tokens", S.trigrams(F.col("q")))
    r = spark.createDataFrame(sorted(right), "block string, r string").withColumn("tokens", S.trigrams(F.col("r")))
    one, two = (sorted(tuple(x) for x in f(q, r, ["block"], "q", "r", "tokens", threshold).collect()) for f in (jaccard_join, block_pairs))
    assert one == two and one


@pytest.mark.parametrize("short", [1, 20, 1000])
@pytest.mark.parametrize("most_pairs", [0, 1_000_000])
def test_word_search_equals_brute_force(spark, most_pairs, short):
    """GARAGE is in nearly every name, AUTO in a third: word lists cannot bring all of their rows."""
    prospects, registry = skewed(120, 7), [(*row, "AUTO RELAIS" if i % 3 else "") for i, row in enumerate(skewed(200, 8))]
    q = spark.createDataFrame([(p, 1, t, b) for p, b, t in prospects], "prospect_id string, variant_pos int, variant string, code_postal string")
    r = spark.createDataFrame(registry, "siret string, code_postal string, denomination_clean string, enseigne_clean string")
    got = {}
    for row in name_search(q, r, k=5, most_pairs=most_pairs, short=short).collect():
        got.setdefault(row.prospect_id, []).append((row["rank"], row.siret))

    def value(a, b):
        x, y = set(a.lower().split()), set(b.lower().split())
        return len(x & y) + len(x & y) / len(x | y) if x & y else 0

    for pid, block, text in prospects:
        scored = [(-max(value(text, d), value(text, e)), s) for s, b, d, e in registry if b == block]
        assert [s for _, s in sorted(got.get(pid, []))] == [s for x, s in sorted(scored) if x < 0][:5]


@pytest.mark.parametrize("cell", [(7, 11), (8_192, 32_768)])
def test_best_in_cells_equals_brute_force(spark, cell):
    """Titles of a few syllables share tokens with nearly all others; a cell still sends three rows a query, not its pairs."""
    rng = random.Random(21)
    titles = sorted({" ".join("".join(rng.choices(["ta", "re", "on", "her", "ing"], k=3)) for _ in range(3)) for _ in range(150)})
    encode = lambda texts, number: encoded_sets(
        spark.createDataFrame([("b", t, t) for t in texts], "block string, text string, `order` string").withColumn("tokens", S.trigrams(F.col("text"))),
        "tokens", TRIGRAM_CODE, number, "sets",
    )
    q, r = encode([*titles[:60], "zzz"], "q_id"), encode(titles, "r_id")
    got = best_in_cells(q.drop("order"), r, ["block"], 3, 0.3, cell)
    assert got.groupBy("q_id").count().filter(f"count > {3 * -(-len(titles) // cell[1])}").isEmpty()
    found = {}
    for row in got.join(q.select("q_id", F.col("text").alias("q")), "q_id").join(r.select("r_id", F.col("text").alias("r")), "r_id").collect():
        assert row.sim == pytest.approx(jac(row.q, row.r)) and row.shared == len(grams(row.q) & grams(row.r))
        found.setdefault(row.q, []).append((-row.sim, row.r))
    assert found.keys() == set(titles[:60])
    for text, rows in found.items():
        assert [r for _, r in sorted(rows)[:3]] == [r for x, r in sorted((-jac(text, t), t) for t in titles) if -x >= 0.3][:3]


@pytest.mark.parametrize("most_pairs", [0, 200, 1_000_000])
def test_top_k_equals_brute_force(spark, most_pairs):
    prospects, registry = skewed(150, 3), [(*row, "AUTO RELAIS" if i % 3 else "") for i, row in enumerate(skewed(200, 4))]
    q = spark.createDataFrame([(p, 1, t, b) for p, b, t in prospects], "prospect_id string, variant_pos int, variant string, code_postal string")
    r = spark.createDataFrame(registry, "siret string, code_postal string, denomination_clean string, enseigne_clean string")
    got = {}
    for row in name_candidates(q, r, k=4, most_pairs=most_pairs).collect():
        got.setdefault(row.prospect_id, []).append((row["rank"], row.siret))
    for pid, block, text in prospects:
        scored = [(-max(jac(text, d), jac(text, e)), s) for s, b, d, e in registry if b == block]
        best = [s for x, s in sorted(scored) if -x >= 0.2][:4]
        assert [s for _, s in sorted(got.get(pid, []))] == best


def test_word_search_with_many_frequent_words(spark):
    """Names of 30 words that nearly all names share: the work follows the lists, not the sets of words."""
    rng = random.Random(12)
    words = [f"W{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(34)]
    registry = [(f"r{i:04d}", "b", " ".join(rng.sample(words, rng.choice([2, 5, 28, 30]))), "") for i in range(300)]
    prospects = [(f"p{i}", 1, " ".join(rng.sample(words, 30 if i < 25 else 4)), "b") for i in range(30)]
    q = spark.createDataFrame(prospects, "prospect_id string, variant_pos int, variant string, code_postal string")
    r = spark.createDataFrame(registry, "siret string, code_postal string, denomination_clean string, enseigne_clean string")
    got = {}
    for row in name_search(q, r, k=5, most_pairs=0, short=20).collect():
        got.setdefault(row.prospect_id, []).append((row["rank"], row.siret))
    for pid, _, text, _ in prospects:
        x = set(text.split())
        scored = sorted((-len(x & y) - len(x & y) / len(x | y), s) for s, _, d, _ in registry if x & (y := set(d.split())))
        assert [s for _, s in sorted(got[pid])] == [s for _, s in scored][:5]


def test_fewer_meetings_than_pairs(spark):
    """In a hot block the prefix join brings fewer pairs together than the block has, and salts change none of them."""
    names = lambda seed: sorted({" ".join(random.Random(seed * 1000 + i).sample([f"{a}{b}ER" for a in "BCDFGHLMNPRST" for b in "AEIOU"], 2)) for i in range(400)})
    encode = lambda seed, number: encoded_sets(
        spark.createDataFrame([("b", t) for t in names(seed)], "block string, text string").withColumn("tokens", S.trigrams(F.col("text"))), "tokens", TRIGRAM_CODE, number, "sets",
    )
    q, r = encode(1, "q_id"), encode(2, "r_id")
    pairs = q.count() * r.count()
    for threshold in (0.2, 0.4, 0.6):
        met = []
        for cell in (20, 200_000):
            rare = _rare_first(q, r, ["block"])
            cut_off = lambda side, t, number: side.selectExpr(
                "block", number, f"size AS {t}_size", f"posexplode(slice(codes, 1, CAST(size - ceil(size * {threshold}) + 1 AS INT))) AS ({t}_pos, code)",  # noqa: B023
            )
            met.append(_meet(cut_off(rare[0], "q", "q_id"), cut_off(rare[1], "r", "r_id"), ["block", "code"], "true", cell).count())
        assert met[0] == met[1] < pairs


def test_no_cross_join_and_bounded_broadcast(spark):
    """Only the bucket counts carry a broadcast hint; candidates never meet outside an equi-join."""
    q = spark.createDataFrame([("a", "x")], "block string, q string").withColumn("tokens", S.trigrams(F.col("q")))
    r = spark.createDataFrame([("a", "x")], "block string, r string").withColumn("tokens", S.trigrams(F.col("r")))
    plan = jaccard_join(q, r, ["block"], "q", "r", "tokens", 0.2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
