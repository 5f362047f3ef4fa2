"""Identifiers in stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions import rules as R
from kinlink.functions import text as X

HIDDEN = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->"
)
# Every way to write a space as an entity; one between digit groups would hide an identifier.
SPACES = (
    r"(?i)&(?:nbsp|ensp|emsp|emsp13|emsp14|thinsp|numsp|puncsp|hairsp|tab|newline|zerowidthspace|#0*(?:9|10|13|32|160|819[2-9]|820[0-3]|8239|8287|12288)"
    r"|#x0*(?:9|a|d|20|a0|200[0-9ab]|202f|205f|3000))(?:;|(?![0-9A-Za-z]))"
)
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def visible_text(html: Column) -> Column:
    """Text of a page: hidden elements, comments and tags become spaces, spaces and common entities are decoded."""
    c = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), r"<[^>]*>", " ")
    c = F.regexp_replace(c, SPACES, " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extract_ids(
    text: Column,
    patterns: tuple[str, ...] = (K.LONG_ID_PATTERN, K.SHORT_ID_PATTERN, K.BARE_ID_PATTERN),
    lengths: tuple[int, ...] = (9, 14),
    parity: str = "standard",
) -> Column:
    """First checksum-valid identifier: patterns in priority order, each in text order; NULL if none.

    Later patterns are looked at only where the earlier ones found nothing valid.
    """

    def first_valid(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), R.digits_of)
        return F.get(F.filter(found, lambda d: R.valid_checksum(d, lengths, parity)), 0)

    return F.coalesce(*[first_valid(p) for p in patterns])


def page_id(text: Column, prefer_long: bool = False, parity: str = "standard") -> Column:
    """Identifier of a page. By default a labelled short id hides a later bare long one; ``prefer_long`` undoes that."""
    long, short, bare = K.LONG_ID_PATTERN, K.SHORT_ID_PATTERN, K.BARE_ID_PATTERN
    return extract_ids(text, (long, bare, short) if prefer_long else (long, short, bare), parity=parity)


def site_urls(df: DataFrame, site: str = "site_web", paths: list[str] | None = None) -> DataFrame:
    """The addresses tried for each row's site, in order (``path_ord``): legal paths, then the home page."""
    raw = X.strip(X.or_blank(F.col(site)))
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    base = F.regexp_replace(full, "/+$", "")
    turns = F.array(*[F.lit(p) for p in [*(K.LEGAL_PATHS if paths is None else paths), ""]])
    known = df.filter(raw != "")
    return known.select("*", base.alias("__base"), F.posexplode(turns).alias("path_ord", "__path")).select(
        *df.columns, "path_ord", F.concat("__base", "__path").alias("page_url")
    )


def first_page_id(
    urls: DataFrame, pages: DataFrame, *, query_id: str = "prospect_id", url: str = "url", html: str = "html",
    prefer_long: bool = False,
) -> DataFrame:
    """First identifier found along each row's addresses. Only pages somebody asks for are parsed, each once."""
    asked = urls.select(F.col("page_url").alias(url)).distinct()
    read = pages.select(url, html).join(asked, url, "left_semi")
    ids = read.select(url, page_id(visible_text(F.col(html)), prefer_long).alias("page_id_found"))
    ids = ids.filter(F.col("page_id_found").isNotNull()).groupBy(url).agg(F.min("page_id_found").alias("page_id_found"))
    hits = urls.select(query_id, "path_ord", F.col("page_url").alias(url)).join(ids, url)
    return hits.groupBy(query_id).agg(
        F.min_by("page_id_found", "path_ord").alias("page_id_found"), F.min_by(url, "path_ord").alias("page_url")
    )
