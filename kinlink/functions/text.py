"""Column stages for names and addresses. Everything here is a built-in Spark expression."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink import constants as K

SPACE = r"[\s\p{Z}]+"


@dataclass(frozen=True)
class WordLists:
    """Word lists of the normalisation job."""

    franchises: tuple[str, ...] = field(default_factory=lambda: tuple(K.FRANCHISES))
    car_brands: tuple[str, ...] = field(default_factory=lambda: tuple(K.CAR_BRANDS))
    legal_forms: tuple[str, ...] = field(default_factory=lambda: tuple(K.LEGAL_FORMS))
    articles: tuple[str, ...] = field(default_factory=lambda: tuple(K.ARTICLES))
    generic: tuple[str, ...] = field(default_factory=lambda: tuple(K.GENERIC_WORDS))

    @property
    def brands(self) -> list[str]:
        """Accent-free brand words, longest first so that the result does not depend on list order."""
        folded = {_fold_py(w) for w in self.franchises + self.car_brands}
        return sorted(folded, key=lambda w: (-len(w), w))


def _fold_py(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks, and those base characters."""
    source, target = [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        base = _fold_py(char)
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def quote(word: str) -> str:
    """Regex-escape one literal word."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


WORD_BREAK = r"[^\p{L}\p{N}_]+"


def keep_words(name: str, dropped, city: str | None = None) -> Column:
    """Words of column ``name`` that are not in ``dropped`` nor in the array column ``city``, joined by a space.

    Splitting once and testing words against a hash set costs a fraction of a whole-word alternation.
    """
    town = f" AND NOT array_contains({city}, w)" if city else ""
    return F.expr(
        f"array_join(filter(split({name}, r'{WORD_BREAK}'), w -> w NOT IN ({sql_list(dropped)}){town}), ' ')"
    )


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold_accents(c: Column) -> Column:
    """Drop combining marks. Plain ASCII text, the common case, skips both passes."""
    source, target = accent_pairs()
    folded = F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def fold_upper(c: Column) -> Column:
    return fold_accents(F.upper(c))


def fold_name(c: Column) -> Column:
    """Upper case without accents; apostrophes, in-word hyphens and slashes become spaces, long dashes hyphens.

    One character pass does accents, apostrophes and slashes; the hyphen passes run only on text that has one.
    """
    source, target = accent_pairs()
    upper = F.upper(c)
    ascii_only = F.translate(upper, "'`/", "   ")
    folded = F.regexp_replace(F.translate(upper, source + "'`‘’/", target + "     "), r"\p{Mn}+", "")
    plain = F.when(upper.rlike(r"[^\x00-\x7F]"), folded).otherwise(ascii_only)
    joined = F.regexp_replace(plain, "-(?<=[A-Z]-)(?=[A-Z])", " ")
    return F.translate(joined, "–—", "--")


def paren_text(c: Column) -> Column:
    """First parenthesised text, blank if there is none."""
    return strip(F.regexp_extract(c, r"\(([^)]+)\)", 1))


def without_parens(c: Column) -> Column:
    """The name without parentheses; untouched when it has no parenthesised text."""
    return F.when(c.rlike(r"\([^)]+\)"), strip(F.regexp_replace(c, r"\([^)]*\)", " "))).otherwise(c)


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def drop_brand_segment(name: str, words: WordLists) -> Column:
    """Of the parts of column ``name`` between " - ", the first that names no brand; the last part if all do.

    Most texts name no brand at all; one pass over the whole text settles those.
    """
    branded = lambda x: "(" + " OR ".join(f"contains({x}, {sql_list([b])})" for b in words.brands) + ")"
    parts = rf"transform(split({name}, ' - '), p -> regexp_replace(p, r'^{SPACE}|{SPACE}$', ''))"
    local = f"transform(array({parts}), ps -> coalesce(get(filter(ps, p -> NOT {branded('p')}), 0), element_at(ps, -1)))[0]"
    return F.expr(f"IF(contains({name}, ' - '), IF({branded(name)}, {local}, get({parts}, 0)), {name})")


def drop_words(c: Column, words) -> Column:
    """Remove whole words, longest first, then collapse spaces. Everything else in the text stays."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    return collapse(F.regexp_replace(c, r"(?U)\b(?:" + "|".join(quote(w) for w in ordered) + r")\b", " "))


def alnum_only(c: Column) -> Column:
    """Runs of anything but A-Z and 0-9 become one space."""
    return F.trim(F.regexp_replace(c, "[^A-Z0-9]+", " "))


def city_words(city: Column) -> Column:
    """The city's folded words of three characters or more."""
    folded = F.regexp_replace(fold_upper(F.coalesce(city, F.lit(""))), "-", " ")
    return F.filter(F.split(folded, SPACE), lambda w: F.length(w) >= 3)


def odd_city_pattern(words: Column) -> Column:
    """Pattern of the city words that hold punctuation and so span several words of a text; NULL without any."""
    odd = F.filter(words, lambda w: w.rlike(WORD_BREAK))
    escaped = F.transform(odd, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(F.size(odd) > 0, F.concat(F.lit(r"(?U)\b(?:"), F.array_join(escaped, "|"), F.lit(r")\b")))


def without_spaced_brands(name: str, words: WordLists, odd_city: str | None = None, segment: str | None = None) -> Column:
    """The folded name without brand part, parentheses, brands of several words and odd city words. ``segment`` is a column
    with the name without brand part, where there is one already."""
    spaced = [b for b in words.brands if " " in b]
    c = F.regexp_replace(F.col(segment) if segment else drop_brand_segment(name, words), r"\([^)]*\)", " ")
    if spaced:
        first = "".join(sorted({b[0] for b in spaced}))
        c = F.regexp_replace(c, rf"(?U)(?=[{first}])\b(?:" + "|".join(spaced) + r")\b", " ")
    if odd_city:
        odd = F.col(odd_city)
        c = F.when(odd.isNull(), c).otherwise(F.regexp_replace(c, F.coalesce(odd, F.lit("")), F.lit(" ")))
    return c


def name_core(name: str, words: WordLists, city: str | None = None) -> Column:
    """Column ``name`` without single-word brands, legal forms, articles and city words, in A-Z, 0-9 and spaces."""
    single = [b for b in words.brands if " " not in b]
    return alnum_only(keep_words(name, [*single, *words.legal_forms, *words.articles], city))


def distinctive_sql(name: str, words: WordLists) -> str:
    """SQL of the words that tell a name apart, longest first; words of equal length keep their order."""
    tokens = f"filter(split(coalesce({name}, ''), r'{SPACE}'), w -> length(w) >= 2)"
    telling = f"filter(ws, w -> length(w) >= 3 AND w NOT IN ({sql_list([*words.generic, *words.articles])}))"
    fallback = f"filter(ws, w -> w NOT IN ({sql_list(words.articles)}))"
    chosen = f"transform(array({tokens}), ws -> transform(array({telling}), t -> IF(size(t) > 0, t, {fallback}))[0])[0]"
    ranked = f"sort_array(transform({chosen}, (w, i) -> struct(-length(w) AS n, i AS i, w AS w)))"
    return f"transform({ranked}, s -> s.w)"


def distinctive_words(name: str, words: WordLists) -> Column:
    return F.expr(distinctive_sql(name, words))


def street_clean(street: Column) -> Column:
    """Abbreviate street types, drop articles and punctuation."""
    c = fold_upper(street)
    for long, short in K.STREET_SHORT:
        c = F.regexp_replace(c, rf"(?U)\b{long}\b", short)
    c = F.regexp_replace(c, r"(?U)\b(?:" + "|".join(K.STREET_ARTICLES) + r")\b", "")
    return alnum_only(c)


NUMBER_THEN_STREET = r"^(\d+)\s*[,\s]\s*(.*)"
NUMBER_SUFFIX_STREET = r"(?i)^(\d+\s*(?:BIS|TER)?)\s+(.+)"


def address_parts(name: str) -> Column:
    """Struct (number, street) of the folded address line in column ``name``."""
    folded = F.col(name)
    plain = F.struct(
        F.regexp_extract(folded, NUMBER_THEN_STREET, 1).alias("number"),
        F.regexp_extract(folded, NUMBER_THEN_STREET, 2).alias("street"),
    )
    glued = F.struct(
        F.regexp_extract(folded, NUMBER_SUFFIX_STREET, 1).alias("number"),
        F.regexp_extract(folded, NUMBER_SUFFIX_STREET, 2).alias("street"),
    )
    none = F.struct(F.lit("").alias("number"), folded.alias("street"))
    return F.when(folded.rlike(NUMBER_THEN_STREET), plain).when(folded.rlike(NUMBER_SUFFIX_STREET), glued).otherwise(none)


def cut_town(street: Column) -> Column:
    return strip(F.regexp_replace(strip(street), r",?\s*\d{5}\s+.*$", ""))


def join_address(*parts: Column) -> Column:
    """Non-blank parts joined by a space; NULL when all are blank."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def search_text(*parts: Column) -> Column:
    """Search column of the registry: folded, letters, digits and single spaces only, blank instead of NULL."""
    joined = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    return alnum_only(fold_upper(joined))


def first_nonblank(*columns: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
