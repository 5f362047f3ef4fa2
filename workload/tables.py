"""Inputs of the registered queries: projections of the given tables into registry, prospect and label shape.

The projections are plain SQL both Spark and DuckDB read, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinlink.operators.registry import clean_search_columns
from kinlink.session import sizes_as_rows

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sizes_as_rows(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(table: DataFrame) -> DataFrame:
    """``table`` over all cores, also where its file gives fewer partitions: joins here make dozens of rows of each of its rows."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Shared SQL over the given tables; ``{name}`` stands for a table."""
    used = {t: dealt(load(spark, sf, t)) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def check_digit(number: str, width: int) -> str:
    """SQL of the mod-10 check digit for ``width`` digits of a number."""
    terms = []
    for place in range(width):
        digit = f"CAST(substr(lpad(CAST({number} AS STRING), {width}, '0'), {width - place}, 1) AS INT)"
        terms.append(f"(CASE WHEN {digit} < 5 THEN 2 * {digit} ELSE 2 * {digit} - 9 END)" if place % 2 == 0 else digit)
    return f"CAST((10 - (({' + '.join(terms)}) % 10)) % 10 AS STRING)"


def long_id(number: str) -> str:
    """SQL of a checksum-valid 14-digit id."""
    return f"lpad(CAST({number} AS STRING), 13, '0') || {check_digit(number, 10)}"


BRAND_NO = "replace(p_brand, 'Brand#', '')"
POSTCODE = f"lpad({BRAND_NO}, 2, '0') || CASE WHEN p_size <= 25 THEN '000' ELSE '190' END"

REGISTRY_SQL = f"""
SELECT {long_id('p_partkey')} AS siret,
       lpad(CAST(p_partkey AS STRING), 9, '0') AS siren,
       CASE WHEN p_brand = 'Brand#7' THEN NULL WHEN p_brand = 'Brand#8' THEN '' ELSE upper(p_name) END AS denomination,
       CASE WHEN p_type = 'SMALL' THEN p_type WHEN p_type = 'LARGE' THEN '' ELSE NULL END AS denomination_usuelle,
       CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type || ' ' || p_name END AS enseigne,
       CASE WHEN p_size > 40 THEN p_brand ELSE NULL END AS enseigne2,
       lpad(CAST(p_size AS STRING), 2, '0') || '.20Z' AS naf,
       CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size AS STRING) END AS numero_voie,
       CASE WHEN p_size > 45 THEN '' ELSE 'RUE' END AS type_voie,
       CASE WHEN p_brand = 'Brand#9' THEN NULL ELSE 'de la ' || p_type || ' ' || p_name END AS voie,
       {POSTCODE} AS code_postal,
       CASE WHEN p_brand = 'Brand#5' THEN NULL ELSE p_brand END AS commune,
       CASE WHEN p_size < 10 THEN '01' WHEN p_size < 20 THEN '11' WHEN p_size < 30 THEN '21'
            WHEN p_size < 40 THEN 'NN' WHEN p_size < 45 THEN '99' ELSE '53' END AS tranche_effectif,
       CASE WHEN p_type = 'MEDIUM' THEN '' ELSE '19' || lpad(CAST(p_size AS STRING), 2, '0') || '-01-01' END AS date_creation,
       CASE WHEN p_type = 'PROMO' THEN 'F' WHEN p_brand = 'Brand#1' THEN NULL ELSE 'A' END AS etat_administratif,
       CASE WHEN {BRAND_NO} = '20' THEN '2A' ELSE lpad({BRAND_NO}, 2, '0') END AS departement
FROM {{part}}
"""

# Every line counts; some parts' rows carry an id the registry does not have, so the relation is sparse.
FUNDING_SQL = f"""
SELECT {long_id('CASE WHEN p_partkey % 7 = 3 THEN p_partkey + 500000000 ELSE p_partkey END')} AS siret, idcc, opco_proprietaire, opco_gestion FROM (
  SELECT l_partkey AS p_partkey,
         lpad(CAST(min(l_suppkey) AS STRING), 4, '0') AS idcc,
         CASE WHEN max(l_quantity) > 48 THEN 'OWNER ' || max(l_returnflag) WHEN max(l_quantity) > 46 THEN '' ELSE NULL END AS opco_proprietaire,
         CASE WHEN min(l_quantity) < 2 THEN 'MANAGER ' || min(l_linestatus) ELSE NULL END AS opco_gestion
  FROM {{lineitem}} GROUP BY l_partkey)
"""

AGREEMENTS_SQL = """
SELECT lpad(CAST(s_suppkey AS STRING), 4, '0') AS idcc, s_name || ' in ' || n_name AS libelle
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > 0
"""

ACTIVITY_LABELS_SQL = """
SELECT DISTINCT lpad(CAST(p_size AS STRING), 2, '0') || '.20Z' AS naf, 'activity ' || CAST(p_size AS STRING) AS label
FROM {part} WHERE p_size < 45
"""

DEPT_REGION_SQL = """
SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS dept, r_name AS region
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

PROSPECTS_SQL = f"""
SELECT 'P' || CAST(p_partkey AS STRING) AS prospect_id,
       CASE WHEN p_type = 'LARGE' THEN 'Midas - ' || p_name || ' Garage'
            WHEN p_type = 'MEDIUM' THEN 'SARL le ' || p_name || ' (' || p_type || ' ' || p_name || ')'
            WHEN p_type = 'SMALL' THEN 'l''atelier-' || p_name || ' ' || p_brand
            WHEN p_type = 'PROMO' THEN 'Renault'
            ELSE 'Ets ' || p_name || ' services' END AS nom,
       CASE WHEN p_size < 35 THEN CAST(p_size AS STRING) || ' rue de la ' || p_type || ' ' || p_name || ', ' || {POSTCODE} || ' ' || p_brand
            ELSE 'Rue de la ' || p_type || ' ' || p_name END AS adresse,
       CASE WHEN p_type = 'STANDARD' THEN {POSTCODE} || '.0' ELSE {POSTCODE} END AS code_postal,
       p_brand AS ville, '' AS departement, '' AS telephone,
       CASE WHEN p_type = 'PROMO' THEN 'site' || CAST(p_partkey AS STRING) || '.example' ELSE '' END AS site_web,
       '' AS email, p_type AS secteur_recherche, 'g' || CAST(p_partkey AS STRING) AS place_id, '' AS rating, '' AS avis
FROM {{part}}
"""

# Stored pages of the prospects' sites: every given page, with an identifier line added to its text.
SITE_PAGES_SQL = f"""
SELECT page_id,
       'https://site' || CAST(page_id AS STRING) || '.example' ||
         CASE WHEN url LIKE '%/fr/%' THEN '/mentions-legales' WHEN url LIKE '%/de/%' THEN '/contact' ELSE '' END AS url,
       html || '<p>' || CASE WHEN url LIKE 'https://www%' THEN 'SIREN : ' || substr({long_id('page_id')}, 1, 8) || '0'
                             WHEN url LIKE 'https://m.%' THEN 'SIRET ' || {long_id('page_id + 900000000')}
                             ELSE 'SIRET: ' || {long_id('page_id')} END || '</p>' AS html
FROM {{pages}}
"""

SITES_SQL = """
SELECT 'S' || CAST(page_id AS STRING) AS prospect_id, 'Midas ' || CAST(page_id AS STRING) AS nom,
       CASE WHEN url LIKE '%.html' THEN ' https://site' || CAST(page_id AS STRING) || '.example/ '
            ELSE 'site' || CAST(page_id AS STRING) || '.example' END AS site_web
FROM {pages}
"""

LINES_DUCK = """
SELECT doc_id, lang, i AS line_no, lines[i] AS line FROM (
  SELECT doc_id, lang, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document."""
    from pyspark.sql import functions as F

    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")
    # Always dealt: the file's splits say nothing, it may have a single row group.
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    docs = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs.select("doc_id", "lang", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return clean_search_columns(run(spark, sf, REGISTRY_SQL))


def raw_registry(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, REGISTRY_SQL)


def funding(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, FUNDING_SQL)


def agreements(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, AGREEMENTS_SQL)


def activity_labels(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, ACTIVITY_LABELS_SQL)


def dept_region(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, DEPT_REGION_SQL)


def prospects(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, PROSPECTS_SQL)
