"""Normalisation queries, over every line of every document and every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import text as X
from kinlink.operators import normalize as N
from kinlink.operators.registry import clean_search_columns
from workload import duck as D
from workload import tables as T

WORDS = N.DEFAULT_WORDS
QUERIES, SQL = {}, {}

# A line as a business name: sentence ends become separators, a word before a comma goes into parentheses.
def line_name():
    return F.regexp_replace(F.replace(F.col("line"), F.lit(". "), F.lit(" - ")), "([a-z]+),", "($1)")


def line_city():
    return F.when(F.col("lang") == "fr", "leau-Tion").when(F.col("lang") == "en", "Thing the of").otherwise("Einheit Ción")


NAME_SQL = "regexp_replace(replace(line, '. ', ' - '), '([a-z]+),', '(\\1)', 'g')"
CITY_SQL = "CASE WHEN lang = 'fr' THEN 'leau-Tion' WHEN lang = 'en' THEN 'Thing the of' ELSE 'Einheit Ción' END"


def _names(spark, sf):
    return T.lines(spark, sf).select("doc_id", "line_no", line_name().alias("nom"), line_city().alias("ville"))


NAMES_SQL = f"SELECT doc_id, line_no, {NAME_SQL} AS nom, {CITY_SQL} AS ville FROM ({T.LINES_DUCK})"


def _query(name, column, sql_expr, out):
    def run(spark, sf):
        return _names(spark, sf).select("doc_id", "line_no", column(F.col("nom")).alias(out))

    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id, line_no, {sql_expr('nom')} AS {out} FROM ({NAMES_SQL})"


_query("fold_accents", X.fold_accents, lambda x: f"strip_accents({x})", "folded")
_query("fold_name", X.fold_name, D.fold_name, "folded")
_query(
    "drop_words",
    lambda c: X.drop_words(X.fold_name(c), WORDS.legal_forms + WORDS.articles),
    lambda x: D.collapse(D.drop_words(D.fold_name(x), D.K.LEGAL_FORMS + D.K.ARTICLES)),
    "kept",
)


def drop_brand_segment(spark, sf):
    df = _names(spark, sf).withColumn("folded", X.fold_name(F.col("nom")))
    return df.select("doc_id", "line_no", X.drop_brand_segment("folded", WORDS).alias("kept"))


QUERIES["drop_brand_segment"] = drop_brand_segment
SQL["drop_brand_segment"] = f"SELECT doc_id, line_no, {D.segment('f')} AS kept FROM (SELECT *, {D.fold_name('nom')} AS f FROM ({NAMES_SQL}))"


def paren_part(spark, sf):
    df = _names(spark, sf)
    return df.select("doc_id", "line_no", X.paren_text(F.col("nom")).alias("inside"), X.without_parens(F.col("nom")).alias("outside"))


QUERIES["paren_part"] = paren_part
_INSIDE = "regexp_extract(nom, '\\(([^)]+)\\)', 1)"
SQL["paren_part"] = f"""
SELECT doc_id, line_no, {D.strip(_INSIDE)} AS inside,
       CASE WHEN regexp_matches(nom, '\\([^)]+\\)') THEN {D.strip("regexp_replace(nom, '\\([^)]*\\)', ' ', 'g')")} ELSE nom END AS outside
FROM ({NAMES_SQL})
"""


def clean_name(spark, sf):
    df = N.with_city(_names(spark, sf), "ville")
    return N.with_clean_name(df, "nom", "nom_clean", "__city").select("doc_id", "line_no", "nom_clean")


_FOLDED = f"SELECT *, {D.fold_name('nom')} AS f, {D.city_pattern('ville')} AS pattern FROM ({NAMES_SQL})"
QUERIES["clean_name"] = clean_name
SQL["clean_name"] = f"SELECT doc_id, line_no, {D.clean_name('f', 'pattern')} AS nom_clean FROM ({_FOLDED})"


def distinctive_words(spark, sf):
    df = _names(spark, sf).withColumn("clean", X.alnum_only(X.fold_name(F.col("nom"))))
    return df.select("doc_id", "line_no", F.array_join(X.distinctive_words("clean", WORDS), "|").alias("words"))


QUERIES["distinctive_words"] = distinctive_words
SQL["distinctive_words"] = f"""
SELECT doc_id, line_no, array_to_string({D.distinctive('c')}, '|') AS words
FROM (SELECT doc_id, line_no, {D.alnum(D.fold_name('nom'))} AS c FROM ({NAMES_SQL}))
"""


def name_variants(spark, sf):
    df = N.normalize_names(_names(spark, sf))
    return df.select("doc_id", "line_no", "nom_clean", "nom_parentheses", F.array_join("nom_variantes", "|").alias("variants"))


QUERIES["name_variants"] = name_variants
_LEAD = f"""CASE WHEN array_to_string({D.distinctive('v')}, ' ') NOT IN ('', v)
            THEN array_to_string({D.distinctive('v')}[1:3], ' ') END"""
# One row per distinct variant, put in order by first position: base variants first, then their leading words.
SQL["name_variants"] = f"""
WITH a AS ({_FOLDED}),
b AS (SELECT *, {D.strip("regexp_extract(f, '\\(([^)]+)\\)', 1)")} AS paren, CASE WHEN contains(f, ' - ') THEN {D.segment('f')} END AS seg FROM a),
c AS (SELECT *, {D.fold_name('paren')} AS pf, {D.fold_name("coalesce(seg, '')")} AS sf FROM b),
d AS (SELECT doc_id, line_no, {D.clean_name('f', 'pattern')} AS c0, {D.clean_name('pf', 'pattern')} AS p0,
             {D.clean_name('sf', 'pattern')} AS s0 FROM c),
e AS (SELECT *, unnest([1, 2, 3]) AS pos, unnest([CASE WHEN len(p0) >= 3 THEN p0 END, CASE WHEN len(c0) >= 3 THEN c0 END, nullif(s0, '')]) AS v FROM d),
g AS (SELECT doc_id, line_no, v, min(pos) AS pos FROM e WHERE v IS NOT NULL GROUP BY ALL),
h AS (SELECT doc_id, line_no, v, pos FROM g UNION ALL SELECT doc_id, line_no, {_LEAD} AS v, pos + 10 FROM g),
k AS (SELECT doc_id, line_no, v, min(pos) AS pos FROM h WHERE v IS NOT NULL GROUP BY ALL)
SELECT doc_id, line_no, c0 AS nom_clean, p0 AS nom_parentheses, coalesce(string_agg(v, '|' ORDER BY pos), '') AS variants
FROM d LEFT JOIN k USING (doc_id, line_no) GROUP BY doc_id, line_no, c0, p0
"""


def explode_variants(spark, sf):
    df = N.normalize_names(_names(spark, sf))
    return N.explode_variants(df, ["doc_id", "line_no"], 4).withColumn("variant_pos", F.col("variant_pos").cast("long"))


QUERIES["explode_variants"] = explode_variants
SQL["explode_variants"] = f"""
SELECT doc_id, line_no, i AS variant_pos, vs[i] AS variant FROM (
  SELECT doc_id, line_no, vs, unnest(range(1, least(len(vs), 4) + 1)) AS i
  FROM (SELECT doc_id, line_no, string_split(variants, '|') AS vs FROM ({SQL['name_variants']}) WHERE variants <> ''))
"""


def normalize_prospects(spark, sf):
    df = N.normalize_prospects(T.prospects(spark, sf))
    return df.select(
        "prospect_id", "code_postal", "departement", "nom_clean", "nom_parentheses",
        F.array_join("nom_variantes", "|").alias("variants"), "adresse_numero", "adresse_voie", "adresse_voie_clean",
    )


_P = f"""
SELECT prospect_id AS doc_id, 0 AS line_no, nom, ville, replace(code_postal, '.0', '') AS cp, adresse FROM ({D.PROSPECTS})
"""
_ADDR = D.strip(D.upper_fold("adresse"))
ADDRESS_SQL = f"""
SELECT *, {D.street_clean('voie')} AS voie_clean FROM (
  SELECT *, CASE WHEN regexp_matches(a, '^(\\d+)\\s*[,\\s]\\s*(.*)') OR regexp_matches(a, '(?i)^(\\d+\\s*(?:BIS|TER)?)\\s+(.+)')
             THEN {D.strip("regexp_replace(trim(street), ',?\\s*\\d{5}\\s+.*$', '', 'g')")} ELSE a END AS voie
  FROM (SELECT *, CASE WHEN regexp_matches(a, '^(\\d+)\\s*[,\\s]\\s*(.*)') THEN regexp_extract(a, '^(\\d+)\\s*[,\\s]\\s*(.*)', 1)
                   WHEN regexp_matches(a, '(?i)^(\\d+\\s*(?:BIS|TER)?)\\s+(.+)') THEN trim(regexp_extract(a, '(?i)^(\\d+\\s*(?:BIS|TER)?)\\s+(.+)', 1))
                   ELSE '' END AS numero,
              CASE WHEN regexp_matches(a, '^(\\d+)\\s*[,\\s]\\s*(.*)') THEN regexp_extract(a, '^(\\d+)\\s*[,\\s]\\s*(.*)', 2)
                   ELSE regexp_extract(a, '(?i)^(\\d+\\s*(?:BIS|TER)?)\\s+(.+)', 2) END AS street
        FROM (SELECT *, {_ADDR} AS a FROM (%s)))
)
"""
DEPARTMENT_SQL = """CASE WHEN len({cp}) < 2 THEN '' WHEN {cp} LIKE '97%' THEN substr({cp}, 1, 3)
  WHEN {cp} LIKE '20%' AND regexp_full_match({cp}, '[0-9]{{5}}') THEN CASE WHEN CAST({cp} AS INT) <= 20190 THEN '2A' ELSE '2B' END
  WHEN {cp} LIKE '20%' THEN '2A' ELSE substr({cp}, 1, 2) END"""
QUERIES["normalize_prospects"] = normalize_prospects
SQL["normalize_prospects"] = f"""
WITH n AS ({SQL['name_variants'].replace(NAMES_SQL, _P)}), p AS ({ADDRESS_SQL % _P})
SELECT p.doc_id AS prospect_id, p.cp AS code_postal, {DEPARTMENT_SQL.format(cp='p.cp')} AS departement,
       nom_clean, nom_parentheses, variants, numero AS adresse_numero, voie AS adresse_voie, voie_clean AS adresse_voie_clean
FROM p JOIN n ON p.doc_id = n.doc_id
"""


def _addresses(spark, sf):
    """Every line as an address line; half of them already start with digits once the letters n and o are read as such."""
    return T.lines(spark, sf).select("doc_id", "line_no", F.concat(F.col("line_no"), F.when(F.col("lang") == "fr", "bis ").when(F.col("lang") == "de", ", Rue de la ").otherwise(" Avenue du "), "line", F.lit(", 75001 Paris")).alias("adresse"))


def parse_address(spark, sf):
    df = N.normalize_address(_addresses(spark, sf))
    return df.select("doc_id", "line_no", "adresse_numero", "adresse_voie", "adresse_voie_clean")


_A = f"""SELECT doc_id, line_no, CAST(line_no AS STRING) || CASE WHEN lang = 'fr' THEN 'bis ' WHEN lang = 'de' THEN ', Rue de la ' ELSE ' Avenue du ' END
  || line || ', 75001 Paris' AS adresse FROM ({T.LINES_DUCK})"""
QUERIES["parse_address"] = parse_address
SQL["parse_address"] = f"""
SELECT doc_id, line_no, numero AS adresse_numero, voie AS adresse_voie, voie_clean AS adresse_voie_clean FROM ({ADDRESS_SQL % _A})
"""

_query("clean_street", lambda c: X.street_clean(F.concat(F.lit("Avenue de l'"), c)), lambda x: D.street_clean(f"'Avenue de l''' || {x}"), "street")


def join_address(spark, sf):
    df = T.raw_registry(spark, sf)
    return df.select("siret", X.join_address(F.col("numero_voie"), F.col("type_voie"), F.col("voie")).alias("adresse"))


QUERIES["join_address"] = join_address
SQL["join_address"] = f"""
SELECT siret, nullif(concat_ws(' ', nullif(numero_voie, ''), nullif(type_voie, ''), nullif(voie, '')), '') AS adresse FROM ({D.REGISTRY})
"""


def clean_columns(spark, sf):
    """Search columns over the registry and over every document line as a trade name."""
    trade = T.lines(spark, sf).select(
        F.concat_ws("-", "doc_id", "line_no").alias("siret"), F.lit(None).cast("string").alias("denomination"),
        F.col("line").alias("denomination_usuelle"), F.col("lang").alias("enseigne"), F.lit("").alias("enseigne2"),
        F.col("line").alias("voie"),
    )
    both = T.raw_registry(spark, sf).select(*trade.columns).unionByName(trade)
    return clean_search_columns(both).select("siret", "denomination_clean", "enseigne_clean", "voie_clean")


QUERIES["clean_search_columns"] = clean_columns
SQL["clean_search_columns"] = f"""
SELECT siret, {D.search_text('denomination', 'denomination_usuelle')} AS denomination_clean,
       {D.search_text('enseigne', 'enseigne2')} AS enseigne_clean, {D.search_text('voie')} AS voie_clean
FROM (SELECT siret, denomination, denomination_usuelle, enseigne, enseigne2, voie FROM ({D.REGISTRY})
      UNION ALL SELECT CAST(doc_id AS STRING) || '-' || CAST(line_no AS STRING), NULL, line, lang, '', line FROM ({T.LINES_DUCK}))
"""
