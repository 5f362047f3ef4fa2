"""Quality rules: base rules, then robust multivariate outliers per language and source.

Only DataFrame functions run here. The statistics of a text are expressions of its own row; the estimates are aggregates
over the written table of statistics, five numbers a document, and come back by a join with one row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import SPACES, attach_small
from kinlink.session import cut

NAMES = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeat"]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the text, first ones included, from the word hashes."""
    size = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            twice = lambda r, k: (F.get(rows, k - 1)["g"] == r["g"]) | F.coalesce(F.get(rows, k + 1)["g"] == r["g"], F.lit(False))
            kept = F.filter(rows, lambda r, k: F.coalesce(twice(r, k), F.lit(False)) | F.coalesce(F.get(rows, k + 1)["g"] == r["g"], F.lit(False)))
            return F.array_sort(F.transform(kept, lambda r: r["i"]))

        start = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"))
        total = lambda rows: F.aggregate(starts(rows), start, add, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(placed, total))

    return F.when(size < n, F.lit(0).cast("long")).otherwise(let(windows, covered))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the five statistics of every whole text, as long; a null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    of_words = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), repeated_words(h).alias("repeat")))
    rows = docs.select(
        "doc_id", "lang", "source", of_words.alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select(
        "doc_id", "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.repeat").alias("n_repeat_words"),
    )


def transformed() -> dict[str, Column]:
    """The statistics on scales where ordinary texts lie in one cloud."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x_words": F.log1p("n_words"), "x_length": F.log1p(F.col("word_chars") / words),
        "x_symbols": F.log1p(100.0 * F.col("n_symbols") / words), "x_lines": F.log1p("n_dup_lines"),
        "x_repeat": F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    }


def chi_square_share(x: float, freedom: int) -> float:
    """Share of a chi-square distribution below ``x``, by the series of the incomplete gamma function."""
    a, term, total, k = freedom / 2, 1.0, 1.0, 0
    while term > 1e-16 * total:
        k += 1
        term *= x / 2 / (a + k)
        total += term
    return math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) * total


def chi_square_point(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, freedom) < share else (low, middle)
    return high


def squared_distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor beside the row."""
    solved: list[Column] = []
    for j, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"{prefix}m_{j}")
        for k, z in enumerate(solved):
            rest = rest - F.col(f"{prefix}l_{j}_{k}") * z
        solved.append(rest / F.col(f"{prefix}l_{j}_{j}"))
    return sum((z * z for z in solved[1:]), solved[0] * solved[0])


def language_floors(stats: DataFrame) -> DataFrame:
    """``lang`` and the floor ``f_j`` of each statistic's standard deviation in all groups of the language.

    It is the deviation over all documents of the language (1.4826 times the median absolute one), and at least what one
    more word, symbol, repeated line or repeated window changes in its median document. A statistic that is constant in
    the central part of a group (no symbols, no repeated line) then doesn't make its covariance singular.
    """
    words, chars = F.greatest(F.col("words"), F.lit(1.0)), F.col("chars")
    units = [
        F.log1p(1 / (words + 1)), F.log1p(1 / (words + chars)), F.log1p(100 / words), F.log1p(F.lit(1.0)), F.asin(F.sqrt(F.least(5 / words, F.lit(1.0)))),
    ]
    middle = stats.groupBy("lang").agg(
        F.percentile_approx("n_words", 0.5, 10_000).cast("double").alias("words"), F.percentile_approx("word_chars", 0.5, 10_000).cast("double").alias("chars"),
        *[F.percentile_approx(n, 0.5, 10_000).alias(f"m_{j}") for j, n in enumerate(NAMES)],
    )
    middle = cut(middle, "quality-languages")
    spread = attach_small(stats, middle, ["lang"]).groupBy("lang").agg(
        F.first("words").alias("words"), F.first("chars").alias("chars"),
        *[(1.4826 * F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{j}")), 0.5, 10_000)).alias(f"s_{j}") for j, n in enumerate(NAMES)],
    )
    return cut(spread.select("lang", *[F.greatest(F.col(f"s_{j}"), u).alias(f"f_{j}") for j, u in enumerate(units)]), "quality-floors")


def with_factor(moments: DataFrame, scale: float, floors: DataFrame | None) -> DataFrame:
    """Cholesky factor ``l_j_k`` of ``scale`` times the covariance ``c_j_k``, and ``root``, the root of its determinant.

    The floor of the language is added to each variance, in every group alike; so the determinants of a group's estimates compare.
    """
    rows = attach_small(moments, floors, ["lang"]) if floors is not None else moments.withColumns({f"f_{j}": F.lit(0.0) for j in range(len(NAMES))})
    root = F.lit(1.0)
    for j in range(len(NAMES)):
        for k in range(j + 1):
            left = F.col(f"c_{j}_{k}") * scale
            if j == k:
                left = left + F.col(f"f_{j}") * F.col(f"f_{j}")
            for i in range(k):
                left = left - F.col(f"l_{j}_{i}") * F.col(f"l_{k}_{i}")
            rows = rows.withColumn(f"l_{j}_{k}", F.sqrt(F.greatest(left, F.lit(1e-12))) if j == k else left / F.col(f"l_{k}_{k}"))
        root = root * F.col(f"l_{j}_{j}")
    entries = [f"l_{j}_{k}" for j in range(len(NAMES)) for k in range(j + 1)]
    kept = ["start"] if "start" in moments.columns else []
    return rows.select("lang", "source", *kept, "n_group", *[f"m_{j}" for j in range(len(NAMES))], *entries, root.alias("root"))


def starting_estimates(stats: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Three robust estimates of each language and source, as column ``start``.

    All have medians as location and 1.4826 times the median absolute deviations as scale, at least the floors. They differ
    in the correlations: none, those of the hyperbolic tangents of the standardised values, and those of their spatial signs.
    """
    p, group = len(NAMES), ["lang", "source"]
    middle = stats.groupBy(*group).agg(*[F.percentile_approx(n, 0.5, 10_000).alias(f"m_{j}") for j, n in enumerate(NAMES)])
    middle = cut(middle, "quality-medians")
    spread = attach_small(stats, middle, group).groupBy(*group).agg(
        F.count("*").alias("n_group"), *[F.first(f"m_{j}").alias(f"m_{j}") for j in range(p)],
        *[(1.4826 * F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{j}")), 0.5, 10_000)).alias(f"s_{j}") for j, n in enumerate(NAMES)],
    )
    least = (lambda j: F.col(f"f_{j}")) if floors is not None else (lambda j: F.lit(1e-6))
    spread = attach_small(spread, floors, ["lang"]) if floors is not None else spread
    spread = cut(spread.select(*group, "n_group", *[f"m_{j}" for j in range(p)], *[F.greatest(f"s_{j}", least(j)).alias(f"s_{j}") for j in range(p)]), "quality-scales")
    z = [(F.col(n) - F.col(f"m_{j}")) / F.col(f"s_{j}") for j, n in enumerate(NAMES)]
    length = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    placed = attach_small(stats, spread, group).withColumn("_length", F.greatest(length, F.lit(1e-12)))
    pairs = [(j, k) for j in range(p) for k in range(j + 1)]
    together = placed.groupBy(*group).agg(
        *[F.covar_pop(F.tanh(z[j]), F.tanh(z[k])).alias(f"t_{j}_{k}") for j, k in pairs],
        *[F.avg(z[j] * z[k] / (F.col("_length") * F.col("_length"))).alias(f"u_{j}_{k}") for j, k in pairs],
    )
    rows = attach_small(spread, cut(together, "quality-correlations"), group)

    def correlation(of: str, j: int, k: int) -> Column:
        variances = F.col(f"{of}_{j}_{j}") * F.col(f"{of}_{k}_{k}")
        return F.when(variances > 0, F.col(f"{of}_{j}_{k}") / F.sqrt(variances)).otherwise(0.0)

    correlations = [lambda j, k: F.lit(0.0), lambda j, k: correlation("t", j, k), lambda j, k: correlation("u", j, k)]
    each = [
        F.struct(F.lit(n).alias("start"), *[((F.lit(1.0) if j == k else r(j, k)) * F.col(f"s_{j}") * F.col(f"s_{k}")).alias(f"c_{j}_{k}") for j, k in pairs])
        for n, r in enumerate(correlations)
    ]
    rows = rows.select(*group, "n_group", *[f"m_{j}" for j in range(p)], F.explode(F.array(*each)).alias("e"))
    return cut(with_factor(rows.select(*group, "n_group", *[f"m_{j}" for j in range(p)], "e.*"), 1.0, None), "quality-starts")


def concentrated(stats: DataFrame, found: DataFrame, group: list[str], keep: float, floors: DataFrame | None, name: str) -> DataFrame:
    """The estimates of the share ``keep`` of rows nearest to ``found``, scaled to be consistent at the normal distribution.

    The nearest rows are those within an approximate quantile of the distances.
    """
    p = len(NAMES)
    scale = keep / chi_square_share(chi_square_point(keep, p), p + 2)
    near = attach_small(stats, found, group).where("n_group IS NOT NULL").withColumn("d2", squared_distance())
    limits = cut(near.groupBy(*group).agg(F.percentile_approx("d2", keep, 10_000).alias("d2_most")), f"quality-limit-{name}")
    near = attach_small(near, limits, group).where("d2 <= d2_most")
    moments = near.groupBy(*group).agg(
        F.first("n_group").alias("n_group"), *[F.avg(n).alias(f"m_{j}") for j, n in enumerate(NAMES)],
        *[F.covar_pop(NAMES[j], NAMES[k]).alias(f"c_{j}_{k}") for j in range(p) for k in range(j + 1)],
    )
    return cut(with_factor(moments, scale, floors), f"quality-fit-{name}")


def covariance_estimates(stats: DataFrame, keep: float = 0.75, steps: int = 20, floors: DataFrame | None = None) -> DataFrame:
    """Minimum-covariance-determinant location and factor of each language and source, one row a group.

    Three starts are concentrated twice each; the one with the smallest determinant goes on until its determinant falls
    by less than a hundredth, or for ``steps`` steps. Of all estimates met, the one with the smallest determinant counts.
    """
    group = ["lang", "source"]
    tried = starting_estimates(stats, floors)
    rows = stats.withColumn("start", F.explode(F.array(*[F.lit(n) for n in range(3)])))
    for step in range(2):
        tried = concentrated(rows, tried, [*group, "start"], keep, floors, f"start-{step}")
    best = tried.groupBy(*group).agg(F.min_by(F.struct(*[c for c in tried.columns if c not in group]), F.struct("root", "start")).alias("b"))
    found = cut(best.select(*group, "b.*").drop("start"), "quality-best")
    moving = found
    for step in range(steps):
        moving = concentrated(stats, moving, group, keep, floors, str(step))
        before = found.select(*group, F.col("root").alias("_before"))
        judged = attach_small(moving, before, group)
        moving = cut(judged.where("root < 0.995 * _before").drop("_before"), "quality-moving")
        if moving.isEmpty():
            break
        kept = attach_small(found, moving.select(*group, F.lit(True).alias("_moved")), group).where("_moved IS NULL").drop("_moved")
        found = cut(kept.unionByName(moving), "quality-found")
    return found


def with_wider_estimates(found: DataFrame, clean: DataFrame, floors: DataFrame, least_group: int) -> DataFrame:
    """Estimates of languages and sources in which small groups have that of their language, or of all documents.

    A group is small below ``least_group`` documents, and so is a language. The wider estimates are made only where a
    small group needs them.
    """
    entries = [c for c in found.columns if c not in ("lang", "source")]
    small = cut(found.where(F.col("n_group") < least_group).select("lang", "source"), "quality-small")
    if small.isEmpty():
        return found
    # Of a wider group, rows are the same with one value in place of all sources, then of all languages too.
    needed = small.select("lang").distinct().withColumn("_needed", F.lit(True))
    rows = attach_small(clean, cut(needed, "quality-small-languages"), ["lang"]).where("_needed").withColumn("source", F.lit(None).cast("string"))
    wide = covariance_estimates(rows, floors=floors)
    wider = attach_small(small, wide.drop("source"), ["lang"])
    rest = cut(wider.where(F.col("n_group") < least_group).select("lang", "source"), "quality-small-rest")
    out = found.where(F.col("n_group") >= least_group).unionByName(wider.where(F.col("n_group") >= least_group))
    if rest.isEmpty():
        return cut(out, "quality-estimates")
    every = clean.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    every_floors = language_floors(every)
    whole = covariance_estimates(every, floors=every_floors).select(entries)
    one = rest.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return cut(out.unionByName(one), "quality-estimates")


def judge_quality(docs: DataFrame, cutoff: float | None = None, least_group: int = 4 * len(NAMES)) -> DataFrame:
    """``doc_id, n_words``, the base statistics, ``base_failed``, ``distance2`` and ``kept`` for every row.

    ``kept`` is false if the base rules fail or the transformed statistics lie beyond ``cutoff`` (default: the
    point a normal cloud exceeds once in 100,000) from the estimate of the document's language and source. Documents that
    fail the base rules take no part in estimates. Groups with fewer than ``least_group`` others, by default four
    for each statistic, are judged by the estimate of
    their language, or of all documents where the language has fewer too; a table with fewer rejects nothing.

    Defined results: a null or empty text has no words and fails the base rules, with no distance; null languages and
    sources form groups of their own; repeated rows and ids are judged row by row; an empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = cut(text_statistics(docs).withColumn("base_failed", failed), "quality-statistics")
    placed = stats.withColumns(transformed())
    clean = placed.where(~F.col("base_failed"))
    floors = language_floors(clean)
    found = with_wider_estimates(covariance_estimates(clean, floors=floors), clean, floors, least_group)
    most = cutoff if cutoff is not None else chi_square_point(1 - 1e-5, len(NAMES))
    judged = attach_small(placed, found, ["lang", "source"])
    d2 = F.when(~F.col("base_failed") & (F.col("n_group") >= least_group), squared_distance())
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= most)
    return judged.select("doc_id", *STATISTICS, "base_failed", d2.alias("distance2"), kept.alias("kept"))
