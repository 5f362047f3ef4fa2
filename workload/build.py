"""Sources, sinks, registry build, counts and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink import constants as K
from kinlink.functions import text as X
from kinlink.functions.rules import department_of
from kinlink.operators import quality as Q
from kinlink.operators import registry as R
from kinlink.plans.build import build_registry, registry_frame
from kinlink.session import scratch_path
from kinlink.sources import readers, sinks
from workload import duck as D
from workload import tables as T
from workload.text import DEPARTMENT_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


# --- sources -------------------------------------------------------------------------------------------------------
ESTABLISHMENTS_SQL = f"""
SELECT CASE WHEN p_size = 13 THEN '123' ELSE ' ' || {T.long_id('p_partkey')} END AS siret,
       lpad(CAST(p_partkey AS STRING), 9, '0') AS siren, p_type AS ignored,
       CASE WHEN p_type = 'PROMO' THEN 'F' ELSE 'A' END AS etatAdministratifEtablissement,
       ' ' || p_type || ', "' || p_name || '" ' AS enseigne1Etablissement,
       CASE WHEN p_type = 'SMALL' THEN p_name ELSE '' END AS denominationUsuelleEtablissement,
       lpad(CAST(p_size AS STRING), 2, '0') || '.20Z' AS activitePrincipaleEtablissement,
       CAST(p_size AS STRING) AS numeroVoieEtablissement, 'Rue' AS typeVoieEtablissement,
       'de l''été ' || p_name AS libelleVoieEtablissement, {T.POSTCODE} AS codePostalEtablissement,
       p_brand AS libelleCommuneEtablissement, '11' AS trancheEffectifsEtablissement,
       '2001-02-03' AS dateCreationEtablissement
FROM {{part}}
"""
UNITS_SQL = """
SELECT lpad(CAST(l_partkey AS STRING), 9, '0') AS siren,
       CASE WHEN l_quantity > 45 THEN '' ELSE 'Société ' || l_returnflag || l_linestatus END AS "denominationUniteLegale",
       CASE WHEN l_quantity > 40 THEN '' ELSE 'Usuelle ' || CAST(CAST(l_quantity AS INT) AS STRING) END AS "denominationUsuelle1UniteLegale"
FROM {lineitem}
"""


def _write_csv(df, name, one_file=False):
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(1) if one_file else df).write.option("header", True).option("escape", '"').csv(path)
    return path


def _establishments_csv(spark, sf):
    return _write_csv(T.run(spark, sf, ESTABLISHMENTS_SQL), "establishments")


_ESTABLISHMENTS = f"""
SELECT trim(siret) AS siret, siren, '' AS denomination, '' AS denomination_usuelle,
       denominationUsuelleEtablissement AS denomination_usuelle_etab, trim(enseigne1Etablissement) AS enseigne, '' AS enseigne2,
       activitePrincipaleEtablissement AS naf, numeroVoieEtablissement AS numero_voie, typeVoieEtablissement AS type_voie,
       libelleVoieEtablissement AS voie, codePostalEtablissement AS code_postal, libelleCommuneEtablissement AS commune,
       trancheEffectifsEtablissement AS tranche_effectif, dateCreationEtablissement AS date_creation,
       etatAdministratifEtablissement AS etat_administratif
FROM ({T.duck(ESTABLISHMENTS_SQL)}) WHERE len(trim(siret)) = 14
"""


@query(_ESTABLISHMENTS)
def read_registry_csv(spark, sf):
    return readers.read_registry_csv(spark, _establishments_csv(spark, sf))


def _units_frame(spark, sf):
    """Legal units in a known file order: supplier key, quantity, order, line."""
    items = T.load(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    usual = F.concat(F.lit("Usuelle "), F.col("l_quantity").cast("int").cast("string"))
    return items.select(
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("siren"),
        F.when(F.col("l_quantity") > 45, "").otherwise(F.concat(F.lit("Société "), "l_returnflag", "l_linestatus")).alias("denominationUniteLegale"),
        F.when(F.col("l_quantity") > 40, "").otherwise(usual).alias("denominationUsuelle1UniteLegale"),
        "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice",
    )


#: Rows one task sorts.
UNITS_PER_RANGE = 500_000
UNIT_ORDER = ["l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice"]


def _units_csv(spark, sf):
    """Range-partitioned and sorted, so that file names and rows follow the order; as many ranges as the rows need."""
    units = _units_frame(spark, sf)
    ranges = max(4, -(-units.count() // UNITS_PER_RANGE))
    ordered = units.repartitionByRange(ranges, *UNIT_ORDER).sortWithinPartitions(*UNIT_ORDER)
    return _write_csv(ordered.drop(*UNIT_ORDER), "units")


_UNITS = f"""
SELECT siren, denomination, denomination_usuelle FROM (
  SELECT lpad(CAST(l_partkey AS STRING), 9, '0') AS siren,
         CASE WHEN l_quantity > 45 THEN '' ELSE 'Société ' || l_returnflag || l_linestatus END AS denomination,
         CASE WHEN l_quantity > 40 THEN '' ELSE 'Usuelle ' || CAST(CAST(l_quantity AS INT) AS STRING) END AS denomination_usuelle,
         row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(UNIT_ORDER)}) AS rn
  FROM lineitem WHERE l_quantity <= 45) WHERE rn = 1
"""


@query(_UNITS)
def read_legal_units(spark, sf):
    return readers.read_legal_units(spark, _units_csv(spark, sf))


@query(f"""
SELECT nom, adresse, replace(code_postal, '.0', '') AS code_postal, ville, '' AS departement, '' AS telephone,
       site_web, '' AS email, secteur_recherche, place_id, '' AS rating, '' AS avis
FROM (SELECT CASE WHEN secteur_recherche = 'PROMO' THEN '' ELSE nom END AS nom, * EXCLUDE (nom) FROM ({D.PROSPECTS})) WHERE nom <> ''
""")
def read_prospects(spark, sf):
    df = T.prospects(spark, sf)
    named = df.select(
        F.when(F.col("secteur_recherche") == "PROMO", None).otherwise(F.col("nom")).alias(" Name"),
        F.col("adresse").alias("Address"), F.col("code_postal").alias("CP"), F.col("ville").alias("city"),
        F.col("site_web").alias("Website"), F.col("secteur_recherche").alias("category"), "place_id",
    )
    return readers.read_prospects(spark, _write_csv(named, "prospects"))


def _responses(spark, sf):
    """Stored name-search responses: the parts of a brand as results of the prospects in that brand's postcode."""
    reg = T.raw_registry(spark, sf)
    place = F.struct(
        "siret", "code_postal", F.col("naf").alias("activite_principale"),
        F.col("tranche_effectif").alias("tranche_effectif_salarie"), "date_creation",
        X.join_address(F.col("numero_voie"), F.col("type_voie"), F.col("voie")).alias("adresse"), "etat_administratif",
        F.col("enseigne").alias("nom_enseigne"), F.col("commune").alias("libelle_commune"), "numero_voie",
        F.col("voie").alias("libelle_voie"),
    )
    company = F.struct(
        "siren", F.col("denomination").alias("nom_complet"), F.col("denomination_usuelle").alias("sigle"),
        "etat_administratif", place.alias("siege"),
        F.when(F.col("tranche_effectif") != "53", F.array(place)).alias("matching_etablissements"),
        F.when(F.col("commune").isNotNull(), F.array(F.struct(F.col("commune").alias("prenoms"), F.col("naf").alias("nom")))).alias("dirigeants"),
    )
    body = F.to_json(F.struct(F.array(company).alias("results")))
    return reg.select(
        F.concat(F.lit("P"), F.col("siren").cast("long").cast("string")).alias("prospect_id"), F.lit(1).alias("step"),
        F.lit(1).alias("variant_pos"), F.coalesce("denomination", F.lit("x")).alias("variant"), body.alias("response"),
    )


@query(f"""
SELECT 'P' || CAST(CAST(siren AS BIGINT) AS STRING) AS prospect_id, 1 AS result_pos, siren, denomination AS nom_complet,
       denomination_usuelle AS sigle, etat_administratif, siret AS siege_siret, code_postal AS siege_cp,
       CASE WHEN tranche_effectif <> '53' THEN 1 ELSE 0 END AS places, commune AS leader
FROM ({D.REGISTRY})
""")
def read_name_search_json(spark, sf):
    path = scratch_path(spark, "responses")
    _responses(spark, sf).write.json(path)
    parsed = readers.read_name_search_json(spark, path)
    return parsed.select(
        "prospect_id", "result_pos", "siren", "nom_complet", "sigle", "etat_administratif", F.col("siege.siret").alias("siege_siret"),
        F.col("siege.code_postal").alias("siege_cp"), F.coalesce(F.size("matching_etablissements"), F.lit(0)).alias("places"),
        F.get("dirigeants", 0)["prenoms"].alias("leader"),
    ).withColumn("places", F.when(F.col("places") < 0, 0).otherwise(F.col("places")))


_REGISTRY_TABLE = ", ".join(K.REGISTRY_COLUMNS)


@query(f"SELECT {_REGISTRY_TABLE} FROM ({D.CLEAN_REGISTRY})")
def write_registry(spark, sf):
    path = scratch_path(spark, "registry")
    sinks.write_registry(T.registry(spark, sf), path)
    return readers.read_registry(spark, path)


@query(f"SELECT {_REGISTRY_TABLE} FROM ({D.CLEAN_REGISTRY})")
def full_refresh(spark, sf):
    path = scratch_path(spark, "refresh")
    sinks.full_refresh(T.prospects(spark, sf), path)
    sinks.full_refresh(T.registry(spark, sf).select(*K.REGISTRY_COLUMNS), path)
    return spark.read.parquet(path)


_CLEANED = ", ".join(
    f"{c} AS {c}" if c in ("siret", "siren") else f"nullif({c}, '') AS {c}" for c in K.REGISTRY_COLUMNS[:15]
)
_JOINED = f"""
SELECT e.* EXCLUDE (denomination, denomination_usuelle, denomination_usuelle_etab), coalesce(u.denomination, '') AS denomination,
       trim(coalesce(u.denomination_usuelle, '') || ' ' || e.denomination_usuelle_etab) AS denomination_usuelle
FROM ({_ESTABLISHMENTS}) e LEFT JOIN ({_UNITS}) u USING (siren)
"""
_BUILT = f"SELECT {_CLEANED}, {DEPARTMENT_SQL.format(cp='code_postal')} AS departement FROM ({_JOINED}) WHERE etat_administratif = 'A'"


@query(f"""
SELECT *, {D.search_text('denomination', 'denomination_usuelle')} AS denomination_clean,
       {D.search_text('enseigne', 'enseigne2')} AS enseigne_clean, {D.search_text('voie')} AS voie_clean FROM ({_BUILT})
""")
def registry_build(spark, sf):
    return build_registry(spark, _establishments_csv(spark, sf), _units_csv(spark, sf), scratch_path(spark, "built"))


# --- build steps ---------------------------------------------------------------------------------------------------
@query(f"SELECT siret, etat_administratif FROM ({D.REGISTRY}) WHERE etat_administratif = 'A'")
def keep_active(spark, sf):
    return R.keep_active(T.raw_registry(spark, sf)).select("siret", "etat_administratif")


@query(f"SELECT siret, etat_administratif FROM ({D.REGISTRY}) WHERE etat_administratif IS NULL OR etat_administratif = 'A'")
def drop_inactive(spark, sf):
    return R.drop_inactive(T.raw_registry(spark, sf)).select("siret", "etat_administratif")


NAMES_SQL = """
SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, upper(s_name) AS denomination,
       CASE WHEN s_acctbal < 3000 THEN '' ELSE 'usual ' || s_name END AS denomination_usuelle FROM {supplier}
"""
LOCAL_SQL = """
SELECT CAST(p_partkey AS STRING) AS siret, CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE lpad(CAST(l_suppkey AS STRING), 9, '0') END AS siren,
       CASE WHEN p_type = 'SMALL' THEN '' WHEN p_type = 'LARGE' THEN NULL ELSE p_name END AS denomination,
       CASE WHEN p_size < 20 THEN '' ELSE p_name END AS denomination_usuelle, p_name AS denomination_usuelle_etab
FROM {part} LEFT JOIN (SELECT l_partkey, max(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey) ON p_partkey = l_partkey
"""


@query(f"""
SELECT e.siret, e.siren, coalesce(u.denomination, '') AS denomination,
       concat_ws(' ', nullif(u.denomination_usuelle, ''), nullif(e.denomination_usuelle_etab, '')) AS denomination_usuelle
FROM ({T.duck(LOCAL_SQL)}) e LEFT JOIN ({T.duck(NAMES_SQL)}) u USING (siren)
""")
def attach_legal_names(spark, sf):
    return R.attach_legal_names(T.run(spark, sf, LOCAL_SQL), T.run(spark, sf, NAMES_SQL))


_BACKFILLED = f"""
SELECT e.siret, e.siren,
       CASE WHEN coalesce(e.denomination, '') = '' AND u.siren IS NOT NULL THEN u.denomination ELSE e.denomination END AS denomination,
       CASE WHEN coalesce(e.denomination, '') = '' AND u.siren IS NOT NULL THEN u.denomination_usuelle ELSE e.denomination_usuelle END AS denomination_usuelle,
       e.denomination_usuelle_etab
FROM ({T.duck(LOCAL_SQL)}) e LEFT JOIN ({T.duck(NAMES_SQL)}) u USING (siren)
"""


@query(_BACKFILLED)
def backfill_names(spark, sf):
    return R.backfill_names(T.run(spark, sf, LOCAL_SQL), T.run(spark, sf, NAMES_SQL))


SPARSE_SQL = f"""SELECT siret, siren, CASE WHEN denomination = denomination_usuelle THEN denomination ELSE '' END AS denomination,
  denomination_usuelle, denomination_usuelle_etab FROM ({LOCAL_SQL})"""
_SPARSE_FILLED = _BACKFILLED.replace(T.duck(LOCAL_SQL), T.duck(SPARSE_SQL))


@query(f"""
WITH n AS (SELECT count(*) FILTER (coalesce(denomination, '') <> '') AS named, count(*) AS total FROM ({T.duck(SPARSE_SQL)}))
SELECT * FROM ({_SPARSE_FILLED}) WHERE (SELECT named < total // 2 FROM n)
UNION ALL SELECT * FROM ({T.duck(SPARSE_SQL)}) WHERE (SELECT named >= total // 2 FROM n)
""")
def backfill_if_sparse(spark, sf):
    return R.backfill_if_sparse(T.run(spark, sf, SPARSE_SQL), T.run(spark, sf, NAMES_SQL))


CODES_SQL = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '97' || CAST(o_custkey AS STRING)
  WHEN o_orderpriority = '2-HIGH' THEN '20' || lpad(CAST(o_custkey AS STRING), 3, '0')
  WHEN o_orderpriority = '3-MEDIUM' THEN substr(CAST(o_custkey AS STRING), 1, 2)
  WHEN o_orderstatus = 'F' THEN NULL ELSE lpad(CAST(o_custkey AS STRING), 5, '0') END AS code_postal FROM {orders}
"""


@query(f"""
SELECT o_orderkey, {DEPARTMENT_SQL.format(cp='cp')} AS full_dept,
       CASE WHEN len(cp) < 2 THEN '' WHEN cp LIKE '97%' THEN substr(cp, 1, 3)
            WHEN cp LIKE '200%' OR cp LIKE '201%' THEN CASE WHEN len(cp) = 5 AND CAST(cp AS INT) <= 20190 THEN '2A' ELSE '2B' END
            WHEN cp LIKE '20%' THEN '2A' ELSE substr(cp, 1, 2) END AS short_dept
FROM (SELECT o_orderkey, coalesce(code_postal, '') AS cp FROM ({T.duck(CODES_SQL)}))
""")
def department(spark, sf):
    cp = F.col("code_postal")
    df = T.run(spark, sf, CODES_SQL)
    return df.select("o_orderkey", department_of(cp).alias("full_dept"), department_of(cp, "short").alias("short_dept"))


NEW_LABELS_SQL = """SELECT lpad(CAST(o_custkey AS STRING), 4, '0') AS idcc, 'order ' || CAST(o_orderkey AS STRING) AS libelle, o_orderkey AS seq
FROM {orders} WHERE o_orderstatus = 'O'"""


@query(f"""
WITH n AS (SELECT idcc, arg_max(libelle, seq) AS libelle FROM ({T.duck(NEW_LABELS_SQL)}) GROUP BY idcc)
SELECT idcc, libelle FROM n UNION ALL SELECT idcc, libelle FROM ({D.AGREEMENTS}) WHERE idcc NOT IN (SELECT idcc FROM n)
""")
def upsert_labels(spark, sf):
    return R.upsert_labels(T.agreements(spark, sf), T.run(spark, sf, NEW_LABELS_SQL), order=["seq"])


# --- counts and checks ---------------------------------------------------------------------------------------------
@query(f"SELECT count(*) AS total, count(*) FILTER (etat_administratif = 'A') AS active FROM ({D.REGISTRY})")
def registry_stats(spark, sf):
    return Q.registry_stats(T.raw_registry(spark, sf))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (etat_administratif = 'A') AS actifs, count(*) FILTER (denomination <> '') AS avec_denom,
       count(*) FILTER (enseigne <> '') AS avec_enseigne FROM ({D.REGISTRY})
""")
def quality_counts(spark, sf):
    return Q.quality_counts(T.raw_registry(spark, sf))


@query(f"SELECT siret, denomination, code_postal FROM ({D.REGISTRY}) WHERE code_postal = '12000' ORDER BY siret LIMIT 5")
def validate_build(spark, sf):
    return Q.sample_of_postcode(T.raw_registry(spark, sf), "12000").select("siret", "denomination", "code_postal")


@query(f"""
SELECT siret, denomination_clean, sim FROM (SELECT *, {D.jaccard(D.trigrams('denomination_clean'), D.trigrams("'RED GEAR'"))} AS sim
FROM ({D.CLEAN_REGISTRY}) WHERE code_postal IN ('12000', '12190', '13000')) WHERE sim >= 0.15 ORDER BY sim DESC, siret LIMIT 5
""")
def similarity_probe(spark, sf):
    near = F.col("code_postal").isin("12000", "12190", "13000")
    found = Q.similarity_probe(T.registry(spark, sf), "denomination_clean", "RED GEAR", near)
    return found.select("siret", "denomination_clean", "sim")


@query("""SELECT coded, labelled, round(labelled * 100.0 / coded, 1)::DOUBLE AS coverage_pct FROM (
SELECT count(*) AS coded, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents)""")
def label_coverage(spark, sf):
    docs = T.load(spark, sf, "documents").select("doc_id")
    out = Q.label_coverage(docs, T.load(spark, sf, "labels"), "doc_id")
    return out.withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(T.load(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey")


@query(f"SELECT siret FROM ({D.REGISTRY})")
def assert_unique_key(spark, sf):
    return Q.assert_unique_key(T.raw_registry(spark, sf), "siret").select("siret")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf):
    docs = T.load(spark, sf, "documents").select("doc_id", "lang", "source")
    return Q.missing_labels(docs, T.load(spark, sf, "labels"), "doc_id")


@query("""SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 20""")
def missing_label_ranking(spark, sf):
    known = T.load(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return Q.missing_label_ranking(T.load(spark, sf, "lineitem").select("l_suppkey"), known, "l_suppkey")


RESULTS_SQL = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS STRING) END AS siret, o_orderpriority AS methode FROM {orders}"


@query(f"""SELECT matched, total, CAST(round_even(matched * 100.0 / total, 0) AS INT) AS percent FROM (
SELECT count(*) FILTER (siret <> '') AS matched, count(*) AS total FROM ({T.duck(RESULTS_SQL)}))""")
def match_report(spark, sf):
    return Q.match_report(T.run(spark, sf, RESULTS_SQL))


@query(f"SELECT methode, count(*) AS count FROM ({T.duck(RESULTS_SQL)}) GROUP BY methode")
def method_counts(spark, sf):
    return Q.method_counts(T.run(spark, sf, RESULTS_SQL))
