"""SQL fragments of the checks. They follow the definitions, not the Spark expressions."""

from __future__ import annotations

from kinlink import constants as K
from workload import tables as T


def upper_fold(x: str) -> str:
    return f"strip_accents(upper(replace({x}, 'ß', 'SS')))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold_name(x: str) -> str:
    c = f"regexp_replace({upper_fold(x)}, '[''`‘’]', ' ', 'g')"
    for _ in range(2):  # the second pass takes single letters between two hyphens
        c = f"regexp_replace({c}, '([A-Z])-([A-Z])', '\\1 \\2', 'g')"
    return f"replace(replace(replace({c}, '/', ' '), '–', '-'), '—', '-')"


def alternation(words) -> str:
    return "|".join(sorted({w for w in words}, key=lambda w: (-len(w), w)))


BRANDS = [w.replace("Ë", "E") for w in K.FRANCHISES + K.CAR_BRANDS]


def drop_words(x: str, words) -> str:
    return f"regexp_replace({x}, '\\b(?:{alternation(words)})\\b', ' ', 'g')"


def segment(x: str) -> str:
    parts = f"list_transform(string_split({x}, ' - '), lambda p: {strip('p')})"
    local = f"list_filter({parts}, lambda p: NOT regexp_matches(p, '{alternation(BRANDS)}'))"
    return f"CASE WHEN contains({x}, ' - ') THEN coalesce({local}[1], {parts}[-1]) ELSE {x} END"


def alnum(x: str) -> str:
    return collapse(f"regexp_replace({x}, '[^A-Z0-9\\s]', ' ', 'g')")


def city_pattern(city: str) -> str:
    words = f"list_filter(string_split_regex(replace({upper_fold(city)}, '-', ' '), '\\s+'), lambda w: len(w) >= 3)"
    escaped = f"list_transform({words}, lambda w: regexp_escape(w))"
    return f"CASE WHEN len({words}) > 0 THEN '\\b(?:' || array_to_string({escaped}, '|') || ')\\b' ELSE '[^\\s\\S]' END"


def core(folded: str, pattern: str | None) -> str:
    c = f"regexp_replace({segment(folded)}, '\\([^)]*\\)', ' ', 'g')"
    for words in (BRANDS, K.LEGAL_FORMS, K.ARTICLES):
        c = collapse(drop_words(c, words))
    if pattern:
        c = f"regexp_replace({c}, {pattern}, ' ', 'g')"
    return alnum(c)


def clean_name(folded: str, pattern: str | None) -> str:
    c = core(folded, pattern)
    return f"CASE WHEN len({c}) < 3 THEN {alnum(folded)} ELSE {c} END"


def quoted(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def distinctive(clean: str) -> str:
    tokens = f"list_filter(string_split({clean}, ' '), lambda w: len(w) >= 2)"
    common = quoted(K.GENERIC_WORDS + K.ARTICLES)
    telling = f"list_filter({tokens}, lambda w: len(w) >= 3 AND NOT list_contains({common}, w))"
    rest = f"list_filter({tokens}, lambda w: NOT list_contains({quoted(K.ARTICLES)}, w))"
    chosen = f"CASE WHEN len({telling}) > 0 THEN {telling} ELSE {rest} END"
    ranked = f"list_sort(list_transform({chosen}, lambda w, i: {{'n': -len(w), 'i': i, 'w': w}}))"
    return f"list_transform({ranked}, lambda s: s.w)"


def street_clean(x: str) -> str:
    c = upper_fold(x)
    for long, short in K.STREET_SHORT:
        c = f"regexp_replace({c}, '\\b{long}\\b', '{short}', 'g')"
    c = f"regexp_replace({c}, '\\b(?:{'|'.join(K.STREET_ARTICLES)})\\b', '', 'g')"
    return alnum(c)


def search_text(*parts: str) -> str:
    joined = " || ' ' || ".join(f"coalesce({p}, '')" for p in parts)
    return collapse(f"regexp_replace({upper_fold(joined)}, '[^A-Z0-9 ]', ' ', 'g')")


def words(x: str) -> str:
    plain = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"


def trigrams(x: str) -> str:
    per_word = f"list_transform({words(x)}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"
    return f"list_distinct(flatten({per_word}))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif(len({a}) + len({b}) - {both}, 0), 0.0)"


def lcs(a: str, b: str) -> str:
    """Common subsequence length of strings up to 60 characters, one bit per character of ``a``."""
    mask = f"list_sum(list_transform(range(0, len({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN (1::BIGINT << i) ELSE 0::BIGINT END))::BIGINT"
    start = f"((1::BIGINT << len({a})) - 1)"
    step = f"((s + (s & {mask})) | (s - (s & {mask}))) & {start}"
    row = f"list_reduce(string_split({b}, ''), lambda s, ch: {step}, {start})"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len({a}) - bit_count({row})::INT END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * {lcs(a, b)} / (len({a}) + len({b})) END)"


def token_sort(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"


REGISTRY = T.duck(T.REGISTRY_SQL)
CLEAN_REGISTRY = f"""
SELECT *, {search_text('denomination', 'denomination_usuelle')} AS denomination_clean,
       {search_text('enseigne', 'enseigne2')} AS enseigne_clean, {search_text('voie')} AS voie_clean
FROM ({REGISTRY})
"""
FUNDING = T.duck(T.FUNDING_SQL)
AGREEMENTS = T.duck(T.AGREEMENTS_SQL)
ACTIVITY_LABELS = T.duck(T.ACTIVITY_LABELS_SQL)
DEPT_REGION = T.duck(T.DEPT_REGION_SQL)
PROSPECTS = T.duck(T.PROSPECTS_SQL)
SITE_PAGES = T.duck(T.SITE_PAGES_SQL)
SITES = T.duck(T.SITES_SQL)


# --- pair scoring --------------------------------------------------------------------------------------------------
def partial(a: str, b: str) -> str:
    """Best window ratio; both directions when the lengths are equal."""

    def windows(short: str, long: str) -> str:
        window = f"substr({long}, greatest(0, e - len({short})) + 1, least(len({long}), e) - greatest(0, e - len({short})))"
        inner = f"list_transform([{window}], lambda w: {ratio(short, 'w')})[1]"
        return f"list_max(list_transform(range(1, len({long}) + len({short})), lambda e: {inner}))"

    one, two = windows(a, b), windows(b, a)
    return f"""(CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END
      WHEN len({a}) < len({b}) THEN {one} WHEN len({a}) > len({b}) THEN {two} ELSE greatest({one}, {two}) END)"""


def measures(pairs: str) -> str:
    """All measures of the distinct pairs (a, b) of a relation, on their compare forms."""
    toks = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    return f"""
SELECT a, b, edit, common_words, jaro_winkler, token_sort, token_set, partial,
       greatest(edit * 0.3 + jaro_winkler * 0.2 + token_sort * 0.25 + token_set * 0.15 + common_words * 0.1,
                token_set * 0.5 + partial * 0.3 + common_words * 0.2,
                partial * 0.4 + token_sort * 0.3 + common_words * 0.3) AS blend
FROM (
  SELECT a, b,
         CASE WHEN fa = '' OR fb = '' THEN 0.0 WHEN fa = fb THEN 1.0 ELSE 1 - levenshtein(fa, fb) / greatest(len(fa), len(fb)) END::DOUBLE AS edit,
         CASE WHEN len(da) = 0 OR len(db) = 0 THEN 0.0 ELSE least(1.0, (len(list_intersect(da, db)) + 0.5 * len(list_filter(da,
           lambda w: NOT list_contains(db, w) AND len(w) >= 4 AND len(list_filter(db, lambda v: NOT list_contains(da, v) AND len(v) >= 4 AND (contains(w, v) OR contains(v, w)))) > 0))) / len(da)) END::DOUBLE AS common_words,
         jaro_winkler_similarity(fa, fb)::DOUBLE AS jaro_winkler,
         {ratio('sa', 'sb')}::DOUBLE AS token_sort, {partial('fa', 'fb')}::DOUBLE AS partial,
         (CASE WHEN sa = '' OR sb = '' THEN 0.0 WHEN sect = '' THEN {ratio('wa', 'wb')}
              ELSE greatest({ratio('wa', 'wb')}, {ratio('sect', 'wa')}, {ratio('sect', 'wb')}) END)::DOUBLE AS token_set
  FROM (SELECT *, trim(sect || ' ' || array_to_string(list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))), ' ')) AS wa,
               trim(sect || ' ' || array_to_string(list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))), ' ')) AS wb
        FROM (SELECT *, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS sect
              FROM (SELECT *, {toks('fa')} AS ta, {toks('fb')} AS tb, {token_sort('fa')} AS sa, {token_sort('fb')} AS sb,
                           list_distinct({distinctive('fa')}) AS da, list_distinct({distinctive('fb')}) AS db
                    FROM (SELECT a, b, {strip(upper_fold('a'))} AS fa, {strip(upper_fold('b'))} AS fb FROM (SELECT DISTINCT a, b FROM {pairs}))))))
"""


def bucket(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85 THEN 50 WHEN {x} >= 0.70 THEN 40 WHEN {x} >= 0.55 THEN 30 WHEN {x} >= 0.40 THEN 20 WHEN {x} >= 0.25 THEN 10 ELSE 0 END"


def street_points(number: str, ref_number: str, ratio_: str) -> str:
    return f"""(CASE WHEN coalesce({number}, '') <> '' AND {number} = {ref_number} THEN 12 ELSE 0 END
      + CASE WHEN {ratio_} >= 0.7 THEN 8 WHEN {ratio_} >= 0.5 THEN 4 ELSE 0 END)"""


def geo(cp: str, ref_cp: str) -> str:
    both = f"coalesce({cp}, '') <> '' AND coalesce({ref_cp}, '') <> ''"
    return f"(CASE WHEN {both} AND {cp} = {ref_cp} THEN 30 WHEN {both} AND substr({cp}, 1, 2) = substr({ref_cp}, 1, 2) THEN 15 ELSE 0 END)"


def body(naf: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ACTIVITY_FUNDING.items())
    return f"(CASE substr(replace(coalesce({naf}, ''), '.', ''), 1, 2) {cases} END)"


def brand(name: str) -> str:
    tests = " OR ".join(f"contains(lower(coalesce({name}, '')), '{b}')" for b in K.FUNDED_BRANDS)
    return f"(CASE WHEN {tests} THEN '{K.BRAND_FUNDING_BODY}' END)"


# --- candidates: (entity, pos, text, block) against the active registry --------------------------------------------
def candidates(queries: str, registry: str, blocks: list[tuple[str, str]], texts: list[str], k: int, kind: str) -> str:
    """Top k ids per query row of ``queries`` (prospect_id, pos, text, block columns), best text per id."""
    make = words if kind == "words" else trigrams
    score = "n + n / (nq + nr - n)" if kind == "words" else "n / (nq + nr - n)"
    keep = "n > 0" if kind == "words" else "n / (nq + nr - n) >= 0.2"
    on = " AND ".join(f"q.{a} = r.{b}" for a, b in blocks)
    refs = " UNION ALL ".join(f"SELECT siret, {', '.join(b for _, b in blocks)}, {t} AS ref FROM {registry} WHERE {t} <> ''" for t in texts)
    distinct = "list_distinct(" + make("ref") + ")"
    asked = "list_distinct(" + make("text") + ")"
    return f"""
SELECT prospect_id, pos, siret, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY prospect_id, pos ORDER BY sim DESC, siret) AS rank FROM (
    SELECT prospect_id, pos, siret, max({score}) AS sim FROM (
      SELECT q.prospect_id, q.pos, r.siret, len(list_intersect(q.t, r.t)) AS n, len(q.t) AS nq, len(r.t) AS nr
      FROM (SELECT *, {asked} AS t FROM {queries} WHERE coalesce(text, '') <> '') q
      JOIN (SELECT *, {distinct} AS t FROM ({refs})) r ON {on})
    WHERE n > 0 AND {keep} GROUP BY prospect_id, pos, siret)) WHERE rank <= {k}
"""
