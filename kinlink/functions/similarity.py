"""Similarity expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import text as X


def plain_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text: each word padded with two spaces before and one after.

    All words sit in one string, three spaces apart; the look-ahead yields every three-character window except those
    that would span two words.
    """
    padded = F.concat(F.lit("  "), F.replace(plain_words(c), F.lit(" "), F.lit("   ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(..[^ ]|.[^ ] ))"), F.lit(1)))


def words_of(c: Column) -> Column:
    """Distinct words of a text."""
    return F.filter(F.array_distinct(F.split(plain_words(c), " ")), lambda w: w != "")


def jaccard(left: Column, right: Column) -> Column:
    """Shared over united elements of two sets held as distinct arrays; 0 when either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(left) + F.size(right) - both), F.lit(0.0))


def trigram_similarity(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), jaccard(trigrams(left), trigrams(right)))


def compare_form(c: Column) -> Column:
    """Upper case, no accents, stripped, blank for NULL."""
    return X.strip(X.fold_upper(X.or_blank(c)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length, on strings in compare form."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(1 - F.levenshtein(a, b) / longest)
    )


def common_word_score(a: str, b: str, words: X.WordLists) -> Column:
    """Share of the first column's distinctive words found in the second, half a point for contained words."""
    mine, theirs = (f"array_distinct({X.distinctive_sql(c, words)})" for c in (a, b))
    near = "length(w) >= 4 AND exists(t, v -> length(v) >= 4 AND NOT array_contains(m, v) AND (contains(w, v) OR contains(v, w)))"
    score = f"(size(array_intersect(m, t)) + 0.5D * size(filter(array_except(m, t), w -> {near}))) / size(m)"
    blank = "size(m) = 0 OR size(t) = 0"
    return F.expr(
        f"transform(array({mine}), m -> transform(array({theirs}), t -> IF({blank}, 0D, least({score}, 1D)))[0])[0]"
    )


def name_blend(edit: Column, m: Column, common: Column) -> Column:
    """Best of three weighted blends of the measures."""
    return F.greatest(
        edit * 0.3 + m["jaro_winkler"] * 0.2 + m["token_sort"] * 0.25 + m["token_set"] * 0.15 + common * 0.1,
        m["token_set"] * 0.5 + m["partial"] * 0.3 + common * 0.2,
        m["partial"] * 0.4 + m["token_sort"] * 0.3 + common * 0.3,
    )


def name_bucket(blend: Column) -> Column:
    """Points of the best name blend."""
    c = F.when(blend >= 0.85, 50)
    for floor, points in ((0.70, 40), (0.55, 30), (0.40, 20), (0.25, 10)):
        c = c.when(blend >= floor, points)
    return c.otherwise(0)


def geo_points(cp_a: Column, cp_b: Column, dept_a: Column, dept_b: Column) -> Column:
    cp_a, cp_b, dept_a, dept_b = (X.or_blank(c) for c in (cp_a, cp_b, dept_a, dept_b))
    cps = (cp_a != "") & (cp_b != "")
    return (
        F.when(cps & (cp_a == cp_b), 30)
        .when((dept_a != "") & (dept_b != "") & (dept_a == dept_b), 15)
        .when(cps & (F.substring(cp_a, 1, 2) == F.substring(cp_b, 1, 2)), 15)
        .otherwise(0)
    )


def address_points(number_a: Column, number_b: Column, street_ratio: Column) -> Column:
    """Points for an equal number plus points for alike streets; ``street_ratio`` is NULL when a street is blank."""
    number_a, number_b = X.or_blank(number_a), X.or_blank(number_b)
    number = F.when((number_a != "") & (number_a == number_b), 12).otherwise(0)
    street = F.when(street_ratio >= 0.7, 8).when(street_ratio >= 0.5, 4).otherwise(0)
    return number + street


def total_points(name: Column, geo: Column, address: Column, sole: Column) -> Column:
    total = name + geo + address
    return F.least(F.when(sole & (total >= 20), total + 5).otherwise(total), F.lit(100))
