"""Candidates, measures, choices, stages and the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as PT

from kinlink.functions import similarity as S
from kinlink.functions import text as X
from kinlink.operators import candidates as C
from kinlink.operators import scoring as P
from kinlink.operators.normalize import explode_variants, normalize_prospects
from kinlink.plans import cascade as M
from kinlink.session import cut, scratch_path
from kinlink.sources import readers, sinks
from kinlink.streaming.match_stream import distinct_prospects, last_matches, match_stream, read_matches
from workload import duck as D
from workload import tables as T
from workload.text import SQL as TEXT_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


# --- measures on pairs of names that share a brand -----------------------------------------------------------------
PAIRS_SQL = """
SELECT DISTINCT l.p_name AS a, r.b AS b FROM (SELECT DISTINCT p_name, p_brand FROM {part}) l
JOIN (SELECT DISTINCT p_brand, p_type || ' ' || p_name AS b FROM {part} UNION SELECT DISTINCT p_brand, p_name FROM {part}) r ON l.p_brand = r.p_brand
"""
PAIRS = f"({T.duck(PAIRS_SQL)})"


def _pairs(spark, sf):
    return T.run(spark, sf, PAIRS_SQL)


@query(f"SELECT a, b, {D.jaccard(D.trigrams('a'), D.trigrams('b'))} AS sim FROM {PAIRS}")
def trigram_similarity(spark, sf):
    return _pairs(spark, sf).select("a", "b", S.trigram_similarity(F.col("a"), F.col("b")).alias("sim"))


def _measure(name: str):
    @query(f"SELECT a, b, round({name}, 9) AS {name} FROM ({D.measures(PAIRS)})")
    def run(spark, sf):
        return P.pair_measures(_pairs(spark, sf), "a", "b").select("a", "b", F.round(name, 9).alias(name))

    return run


for _m, _shown in (
    ("edit", "edit_similarity"), ("jaro_winkler", "jaro_winkler"), ("token_sort", "token_sort_ratio"), ("token_set", "token_set_ratio"),
    ("partial", "partial_ratio"), ("common_words", "common_word_score"),
):
    _measure(_m)
    QUERIES[_shown], SQL[_shown] = QUERIES.pop("run"), SQL.pop("run")


@query(f"SELECT a, b, {D.bucket('blend')} AS points FROM ({D.measures(PAIRS)})")
def name_points(spark, sf):
    df = _pairs(spark, sf).withColumn("names", F.array("a"))
    return P.name_points(df, names="names", refs=["b"], out="points").select("a", "b", "points")


GEO_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE lpad(CAST(l_partkey AS STRING), 5, '0') END AS cp_a,
       lpad(CAST(l_partkey + l_suppkey - 5 AS STRING), 5, '0') AS cp_b, l_returnflag AS dept_a, l_linestatus AS dept_b FROM {lineitem}
"""


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cp_a <> '' AND cp_b <> '' AND cp_a = cp_b THEN 30
WHEN dept_a = dept_b THEN 15 WHEN cp_a <> '' AND substr(cp_a, 1, 2) = substr(cp_b, 1, 2) THEN 15 ELSE 0 END AS points FROM ({T.duck(GEO_SQL)})""")
def geo_points(spark, sf):
    points = S.geo_points(F.col("cp_a"), F.col("cp_b"), F.col("dept_a"), F.col("dept_b"))
    return T.run(spark, sf, GEO_SQL).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", points.alias("points"))


STREETS_SQL = """
SELECT l.p_partkey, l.p_size AS size_a, r.p_size AS size_b, l.p_name AS a, r.p_type || ' ' || r.p_name AS b
FROM {part} l JOIN {part} r ON l.p_brand = r.p_brand AND l.p_retailprice = r.p_retailprice
UNION ALL SELECT p_partkey, p_size, p_size + 1, p_name, CASE WHEN p_size < 10 THEN '' ELSE p_brand || ' ' || p_name || ' ' || p_type END FROM {part}
"""


def _number_sql(c):
    return f"CASE WHEN {c} = 3 THEN '' ELSE CAST({c} AS STRING) END"


@query(f"""
WITH s AS ({T.duck(STREETS_SQL)}), m AS (SELECT a, b, {D.ratio(D.token_sort(D.strip(D.upper_fold('a'))), D.token_sort(D.strip(D.upper_fold('b'))))} AS r
  FROM (SELECT DISTINCT a, b FROM s WHERE a <> '' AND b <> ''))
SELECT p_partkey, s.a, s.b, {D.street_points(_number_sql('size_a'), _number_sql('size_b'), 'r')} AS points FROM s LEFT JOIN m ON s.a = m.a AND s.b = m.b
""")
def address_points(spark, sf):
    number = lambda c: F.when(F.col(c) == 3, "").otherwise(F.col(c).cast("string"))
    df = P.street_ratio(T.run(spark, sf, STREETS_SQL), "a", "b")
    return df.select("p_partkey", "a", "b", S.address_points(number("size_a"), number("size_b"), F.col("street_ratio")).alias("points"))


# A part meets those of its brand and size in its range of keys, a dozen in a table of any size.
TOTAL_SQL = """
SELECT l.p_partkey AS id_a, r.p_partkey AS id_b, l.p_name AS name_a, r.p_name AS name_b, l.p_type || ' ' || r.p_name AS sign_b,
       CAST(l.p_size + CASE l.p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 30 ELSE 0 END AS STRING) AS cp_a, CAST(r.p_size AS STRING) AS cp_b, l.p_type AS dept_a, r.p_type AS dept_b,
       CAST(l.p_size + CASE l.p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS STRING) AS num_a, CAST(r.p_size AS STRING) AS num_b, l.p_type || ' ' || l.p_name AS street_a,
       r.p_name || ' ' || r.p_type AS street_b, l.p_partkey = r.p_partkey AS sole
FROM {part} l JOIN {part} r ON l.p_brand = r.p_brand AND l.p_size = r.p_size AND floor(l.p_partkey / 15000) = floor(r.p_partkey / 15000)
"""


@query(f"""
WITH t AS ({T.duck(TOTAL_SQL)}), pairs AS (SELECT name_a AS a, name_b AS b FROM t UNION SELECT name_a, sign_b FROM t),
m AS MATERIALIZED ({D.measures('pairs')}),
st AS (SELECT a, b, {D.ratio(D.token_sort(D.strip(D.upper_fold('a'))), D.token_sort(D.strip(D.upper_fold('b'))))} AS r FROM (SELECT DISTINCT street_a AS a, street_b AS b FROM t)),
u AS (SELECT t.*, {D.bucket('greatest(m1.blend, m2.blend)')} AS name_points, r,
  CASE WHEN cp_a = cp_b THEN 30 WHEN dept_a = dept_b THEN 15 WHEN substr(cp_a, 1, 2) = substr(cp_b, 1, 2) THEN 15 ELSE 0 END AS geo_points
  FROM t JOIN m m1 ON m1.a = name_a AND m1.b = name_b JOIN m m2 ON m2.a = name_a AND m2.b = sign_b JOIN st ON st.a = street_a AND st.b = street_b),
v AS (SELECT *, {D.street_points('num_a', 'num_b', 'r')} AS address_points FROM u)
SELECT id_a, id_b, name_points, geo_points, address_points,
  least(100, name_points + geo_points + address_points + CASE WHEN sole AND name_points + geo_points + address_points >= 20 THEN 5 ELSE 0 END) AS score FROM v
""")
def total_points(spark, sf):
    df = P.score_total(
        T.run(spark, sf, TOTAL_SQL), name="name_a", refs=["name_b", "sign_b"], postcodes=("cp_a", "cp_b"),
        departments=("dept_a", "dept_b"), numbers=("num_a", "num_b"), streets=("street_a", "street_b"), sole="sole",
    )
    return df.select("id_a", "id_b", "name_points", "geo_points", "address_points", "score")


# --- candidates ----------------------------------------------------------------------------------------------------
def _normalized(spark, sf):
    return normalize_prospects(T.prospects(spark, sf))


def _registry(spark, sf):
    """The registry as a written table, the form it has in use."""
    return cut(T.registry(spark, sf), "registry")


def _variants(spark, sf, cap=5):
    return explode_variants(cut(_normalized(spark, sf), "prospects"), ["prospect_id", "code_postal", "departement"], cap)


BASE = f"""
p AS MATERIALIZED (SELECT n.*, q.nom, string_split(n.variants, '|') AS vs FROM ({TEXT_SQL['normalize_prospects']}) n
  JOIN ({D.PROSPECTS}) q USING (prospect_id)),
reg AS MATERIALIZED ({D.CLEAN_REGISTRY}), act AS MATERIALIZED (SELECT * FROM reg WHERE etat_administratif = 'A')"""


def _variants_sql(cap: int, source: str = "p") -> str:
    return f"""(SELECT prospect_id, i AS pos, vs[i] AS text, code_postal, departement FROM (
      SELECT *, unnest(range(1, least(len(vs), {cap}) + 1)) AS i FROM {source} WHERE variants <> ''))"""


NAMES = ["denomination_clean", "enseigne_clean"]
_BY_CP = D.candidates(_variants_sql(5), "act", [("code_postal", "code_postal")], NAMES, 10, "trigrams")


@query(f"WITH {BASE} SELECT prospect_id, pos AS variant_pos, siret, sim, rank FROM ({_BY_CP})")
def name_candidates(spark, sf):
    found = C.name_candidates(_variants(spark, sf), C.active_only(_registry(spark, sf)))
    return _wide(found)


def _wide(df):
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


_HALF = "CASE WHEN nom LIKE 'Ets %' THEN '00000' ELSE code_postal END"
_SHIFTED = f"(SELECT * EXCLUDE (code_postal), {_HALF} AS code_postal FROM p)"
_NEAR = D.candidates(_variants_sql(5, _SHIFTED), "act", [("code_postal", "code_postal")], NAMES, 5, "trigrams")
_FALLBACK = f"""
near AS MATERIALIZED ({_NEAR}),
gap AS MATERIALIZED (SELECT v.* FROM {_variants_sql(5, _SHIFTED)} v WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.prospect_id = v.prospect_id AND n.pos = v.pos)),
far AS ({D.candidates('gap', 'act', [('departement', 'departement')], NAMES, 5, 'trigrams')}),
merged AS MATERIALIZED (SELECT *, 'postcode' AS block_kind FROM near UNION ALL SELECT *, 'department' FROM far)"""


def _fallback(spark, sf):
    """Prospects named "Ets ..." get a postcode nobody has, so that only the department can find them."""
    shifted = F.when(F.col("nom").like("Ets %"), "00000").otherwise(F.col("code_postal"))
    p = cut(_normalized(spark, sf).withColumn("code_postal", shifted), "prospects")
    variants = explode_variants(p, ["prospect_id", "code_postal", "departement"], 5)
    return C.name_candidates_with_fallback(variants, C.active_only(_registry(spark, sf)), k=5)


@query(f"WITH {BASE}, {_FALLBACK} SELECT prospect_id, pos AS variant_pos, siret, sim, rank, block_kind FROM merged")
def department_fallback(spark, sf):
    return _wide(_fallback(spark, sf))


@query(f"""WITH {BASE}, {_FALLBACK},
firsts AS (SELECT *, row_number() OVER (PARTITION BY prospect_id, siret ORDER BY pos) AS seen FROM merged)
SELECT prospect_id, siret, sim, pos AS variant_pos, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY sim DESC, pos, rank) AS rn
FROM firsts WHERE seen = 1) WHERE rn <= 10""")
def best_variant_merge(spark, sf):
    return _wide(C.best_variant_merge(_fallback(spark, sf)).drop("variant_rank"))


_ADDRESS = "(SELECT prospect_id, 1 AS pos, adresse_voie_clean AS text, code_postal, adresse_numero, departement FROM p WHERE adresse_numero <> '')"
_AT = D.candidates(_ADDRESS, "act", [("code_postal", "code_postal"), ("adresse_numero", "numero_voie")], ["voie_clean"], 10, "trigrams")


@query(f"WITH {BASE} SELECT prospect_id, siret, sim, rank FROM ({_AT})")
def address_candidates(spark, sf):
    return _wide(C.address_candidates(cut(_normalized(spark, sf), "prospects"), C.active_only(_registry(spark, sf))))


_STREET = "(SELECT prospect_id, 1 AS pos, adresse_voie_clean AS text, code_postal FROM p)"


@query(f"WITH {BASE} SELECT prospect_id, siret, sim, rank FROM ({D.candidates(_STREET, 'act', [('code_postal', 'code_postal')], ['voie_clean'], 5, 'trigrams')})")
def street_candidates(spark, sf):
    return _wide(C.street_candidates(cut(_normalized(spark, sf), "prospects"), C.active_only(_registry(spark, sf))))


_TURNS = """(SELECT prospect_id, ord AS pos, adresse_voie_clean AS text, alt AS code_postal, adresse_numero FROM
  (SELECT * EXCLUDE (code_postal), CASE WHEN code_postal LIKE '20%' THEN '20090' ELSE code_postal END AS code_postal FROM p)
  JOIN (VALUES ('200', '20190', 0), ('200', '20167', 1), ('200', '20000', 2)) t(prefix, alt, ord) ON prefix = substr(code_postal, 1, 3)
  WHERE alt <> code_postal AND departement IN ('2A', '2B', '97') AND adresse_numero <> '')"""
_TURN_HITS = D.candidates(_TURNS, "act", [("code_postal", "code_postal"), ("adresse_numero", "numero_voie")], ["voie_clean"], 10, "trigrams")


@query(f"""WITH {BASE}, h AS MATERIALIZED ({_TURN_HITS})
SELECT prospect_id, siret, sim, rank FROM h WHERE pos = (SELECT min(pos) FROM h h2 WHERE h2.prospect_id = h.prospect_id)""")
def nearby_postcode_fallback(spark, sf):
    """Prospects of the island under a postcode of it that no establishment has; its neighbours are tried in turn."""
    moved = F.when(F.col("code_postal").startswith("20"), "20090").otherwise(F.col("code_postal"))
    p = cut(_normalized(spark, sf).withColumn("code_postal", moved), "prospects")
    table = {"200": ["20190", "20167", "20090", "20000"]}
    active = C.active_only(_registry(spark, sf))
    keys = ("code_postal", "departement", "adresse_numero", "adresse_voie_clean")
    found = M.once_each(p, lambda firsts: C.nearby_address_candidates(firsts, active, table=table), keys)
    return _wide(found.select("prospect_id", "siret", "sim", "rank"))


@query(f"WITH {BASE} SELECT prospect_id, pos AS variant_pos, siret, sim, rank FROM ({D.candidates(_variants_sql(4), 'act', [('code_postal', 'code_postal')], NAMES, 5, 'words')})")
def name_search(spark, sf):
    return _wide(C.name_search(_variants(spark, sf, 4), C.active_only(_registry(spark, sf))))


GEOCODES_SQL = """SELECT DISTINCT 'Rue de la ' || p_type || ' ' || p_name AS adresse, {cp} AS code_postal, CAST(p_size AS STRING) AS housenumber,
'Boulevard de ' || p_name AS street FROM {{part}} WHERE p_size > 34 AND p_size < 45""".format(cp=T.POSTCODE)


@query(f"""WITH {BASE}, g AS (SELECT adresse, code_postal, min({{'h': housenumber, 's': street}}) AS g FROM ({T.duck(GEOCODES_SQL)}) GROUP BY ALL),
a AS (SELECT p.*, q.adresse FROM p JOIN ({D.PROSPECTS}) q USING (prospect_id))
SELECT prospect_id, CASE WHEN adresse_numero = '' AND g IS NOT NULL THEN g.h ELSE adresse_numero END AS adresse_numero,
CASE WHEN adresse_numero = '' AND g IS NOT NULL THEN {D.street_clean('g.s')} ELSE adresse_voie_clean END AS adresse_voie_clean
FROM a LEFT JOIN g ON a.adresse = g.adresse AND a.code_postal = g.code_postal""")
def geocode_fill(spark, sf):
    out = C.geocode_fill(_normalized(spark, sf), T.run(spark, sf, GEOCODES_SQL))
    return out.select("prospect_id", "adresse_numero", "adresse_voie_clean")


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
_TITLES = f"(SELECT CAST(page_id AS STRING) AS siret, CAST(page_id AS STRING) AS prospect_id, 1 AS pos, {_TITLE} AS text, {_TITLE} AS title, regexp_extract(url, 'example\\.[a-z]+/([a-z]+)/', 1) AS lang FROM pages)"


@query(f"SELECT prospect_id, siret, sim, rank FROM ({D.candidates(_TITLES, _TITLES, [('lang', 'lang')], ['title'], 3, 'trigrams')})")
def similar_titles(spark, sf):
    """The three most similar titles of every page among the pages of its language."""
    pages = T.load(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("siret"), F.col("page_id").cast("string").alias("prospect_id"),
        F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract("url", r"example\.[a-z]+/([a-z]+)/", 1).alias("lang"),
    )
    found = C.similar_candidates(
        pages.drop("siret"), pages.drop("prospect_id"), query_id=["prospect_id"], query="title", query_blocks={"block": "lang"},
        texts=["title"], ref_blocks={"block": "lang"}, k=3,
    )
    return _wide(found)


# --- choices -------------------------------------------------------------------------------------------------------
SCORES_SQL = "SELECT DISTINCT l_orderkey AS prospect_id, l_linenumber AS position, l_partkey AS siret, l_quantity * 2 AS score FROM {lineitem}"


@query(f"""SELECT prospect_id, position, siret, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id
ORDER BY score DESC, position, siret) AS rank FROM ({T.duck(SCORES_SQL)})) WHERE rank <= 3""")
def top_k_per_entity(spark, sf):
    order = [F.desc("score"), F.col("position"), F.col("siret")]
    best = C.top_k_per_entity(T.run(spark, sf, SCORES_SQL), ["prospect_id"], order, 3)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT prospect_id, position, siret, score FROM (SELECT *, row_number() OVER (PARTITION BY prospect_id
ORDER BY score DESC, position, siret) AS rank FROM ({T.duck(SCORES_SQL)})) WHERE rank = 1""")
def best_candidate(spark, sf):
    return M.best_candidate(T.run(spark, sf, SCORES_SQL), ["position", "siret"])


@query(f"""SELECT s.* FROM ({T.duck(SCORES_SQL)}) s WHERE NOT EXISTS (SELECT 1 FROM ({T.duck(SCORES_SQL)}) e
WHERE e.prospect_id = s.prospect_id AND e.position < s.position AND e.score >= 65)""")
def early_stop(spark, sf):
    return M.early_stop(T.run(spark, sf, SCORES_SQL), "position")


@query(f"SELECT *, count(*) OVER (PARTITION BY prospect_id) AS candidates FROM ({T.duck(SCORES_SQL)})")
def sole_candidate(spark, sf):
    return M.sole_candidate(T.run(spark, sf, SCORES_SQL))


# --- stages --------------------------------------------------------------------------------------------------------
def _ratio_cte(name: str, source: str, a: str, b: str) -> str:
    form = lambda x: D.token_sort(D.strip(D.upper_fold(x)))
    return f"{name} AS MATERIALIZED (SELECT a, b, {D.ratio(form('a'), form('b'))} AS r FROM (SELECT DISTINCT {a} AS a, {b} AS b FROM {source} WHERE {a} <> '' AND {b} <> ''))"


def _address_stage(source: str, tag: str) -> str:
    """CTEs of stage 3 over the prospects of ``source``; the last one is ``{tag}_best``."""
    asked = f"(SELECT prospect_id, 1 AS pos, adresse_voie_clean AS text, code_postal, adresse_numero FROM {source} WHERE adresse_numero <> '')"
    near = ", ".join(f"('{p}', '{a}', {i})" for p, alts in D.K.NEARBY_POSTCODES.items() for i, a in enumerate(alts))
    turns = f"""(SELECT prospect_id, ord AS pos, adresse_voie_clean AS text, alt AS code_postal, adresse_numero FROM {source}
      JOIN (VALUES {near}) t(prefix, alt, ord) ON prefix = substr(code_postal, 1, 3)
      WHERE alt <> code_postal AND departement IN ('2A', '2B', '97') AND adresse_numero <> '' AND prospect_id NOT IN (SELECT prospect_id FROM {tag}_here))"""
    on = [("code_postal", "code_postal"), ("adresse_numero", "numero_voie")]
    return f"""
{tag}_here AS MATERIALIZED ({D.candidates(asked, 'act', on, ['voie_clean'], 10, 'trigrams')}),
{tag}_alt AS MATERIALIZED ({D.candidates(turns, 'act', on, ['voie_clean'], 10, 'trigrams')}),
{tag}_all AS (SELECT * FROM {tag}_here UNION ALL SELECT * FROM {tag}_alt a WHERE pos = (SELECT min(pos) FROM {tag}_alt b WHERE b.prospect_id = a.prospect_id)),
{tag}_rows AS MATERIALIZED (SELECT c.*, count(*) OVER (PARTITION BY c.prospect_id) AS n, s.nom, s.nom_clean, s.adresse_numero, s.adresse_voie_clean, r.numero_voie,
  {D.upper_fold("coalesce(r.denomination, '')")} AS den, {D.upper_fold("coalesce(r.enseigne, '')")} AS ens,
  {D.street_clean("coalesce(r.voie, '')")} AS street FROM {tag}_all c JOIN {source} s USING (prospect_id) JOIN act r USING (siret)),
{tag}_pairs AS (SELECT nom_clean AS a, den AS b FROM {tag}_rows WHERE den <> '' UNION SELECT nom_clean, ens FROM {tag}_rows WHERE ens <> ''),
{tag}_m AS MATERIALIZED ({D.measures(f'{tag}_pairs')}), {_ratio_cte(f'{tag}_st', f'{tag}_rows', 'adresse_voie_clean', 'street')},
{tag}_scored AS MATERIALIZED (SELECT x.*, {D.bucket('coalesce(greatest(m1.blend, m2.blend), 0)')} AS name_points, {D.street_points('adresse_numero', 'numero_voie', 'r')} AS address_points
  FROM {tag}_rows x LEFT JOIN {tag}_m m1 ON m1.a = nom_clean AND m1.b = den LEFT JOIN {tag}_m m2 ON m2.a = nom_clean AND m2.b = ens
  LEFT JOIN {tag}_st ON {tag}_st.a = adresse_voie_clean AND {tag}_st.b = street),
{tag}_final AS (SELECT *, CASE WHEN n = 1 THEN least(95, 55 + address_points) ELSE name_points + 45 END::DOUBLE AS score FROM {tag}_scored),
{tag}_best AS MATERIALIZED (SELECT prospect_id, siret, score, CASE WHEN n = 1 THEN 'ADDRESS_UNIQUE' ELSE 'ADDRESS_MULTI' END AS methode FROM (
  SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY score DESC, rank) AS rn FROM {tag}_final WHERE score > 0) WHERE rn = 1 AND (n = 1 OR score >= 50))"""


def _trigram_stage(source: str, tag: str) -> str:
    near = D.candidates(_variants_sql(5, source), "act", [("code_postal", "code_postal")], NAMES, 5, "trigrams")
    return f"""
{tag}_near AS MATERIALIZED ({near}),
{tag}_gap AS MATERIALIZED (SELECT v.* FROM {_variants_sql(5, source)} v WHERE departement <> '' AND NOT EXISTS (SELECT 1 FROM {tag}_near n WHERE n.prospect_id = v.prospect_id AND n.pos = v.pos)),
{tag}_far AS ({D.candidates(f'{tag}_gap', 'act', [('departement', 'departement')], NAMES, 5, 'trigrams')}),
{tag}_first AS (SELECT *, row_number() OVER (PARTITION BY prospect_id, siret ORDER BY pos) AS seen FROM (SELECT * FROM {tag}_near UNION ALL SELECT * FROM {tag}_far)),
{tag}_top AS (SELECT * FROM (SELECT prospect_id, siret, row_number() OVER (PARTITION BY prospect_id ORDER BY sim DESC, pos, rank) AS rn FROM {tag}_first WHERE seen = 1) WHERE rn <= 10),
{tag}_rows AS MATERIALIZED (SELECT c.*, count(*) OVER (PARTITION BY c.prospect_id) AS n, s.vs, s.adresse_numero, s.adresse_voie_clean, s.code_postal, r.code_postal AS r_cp, r.numero_voie,
  {D.upper_fold("coalesce(r.denomination, '')")} AS den, {D.upper_fold("coalesce(r.enseigne, '')")} AS ens,
  {D.street_clean("coalesce(r.voie, '')")} AS street FROM {tag}_top c JOIN {source} s USING (prospect_id) JOIN act r USING (siret)),
{tag}_long AS MATERIALIZED (SELECT prospect_id, siret, unnest(vs[1:4]) AS a, den, ens FROM {tag}_rows),
{tag}_refs AS (SELECT prospect_id, siret, a, den AS b FROM {tag}_long WHERE den <> '' UNION ALL SELECT prospect_id, siret, a, ens FROM {tag}_long WHERE ens <> ''),
{tag}_m AS MATERIALIZED ({D.measures(f'{tag}_refs')}), {_ratio_cte(f'{tag}_st', f'{tag}_rows', 'adresse_voie_clean', 'street')},
{tag}_name AS (SELECT prospect_id, siret, max(blend) AS blend FROM {tag}_refs JOIN {tag}_m USING (a, b) GROUP BY ALL),
{tag}_final AS MATERIALIZED (SELECT x.*, ({D.bucket('coalesce(blend, 0)')}) + {D.geo('code_postal', 'r_cp')} + CASE WHEN n = 1 THEN 5 ELSE 0 END
  + CASE WHEN adresse_numero <> '' THEN {D.street_points('adresse_numero', 'numero_voie', 'r')} ELSE 0 END::DOUBLE AS score
  FROM {tag}_rows x LEFT JOIN {tag}_name USING (prospect_id, siret) LEFT JOIN {tag}_st ON {tag}_st.a = adresse_voie_clean AND {tag}_st.b = street),
{tag}_best AS MATERIALIZED (SELECT prospect_id, siret, score, 'TRIGRAM_FUZZY' AS methode FROM (
  SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY score DESC, rn) AS first FROM {tag}_final WHERE score > 0) WHERE first = 1 AND score >= 45)"""


def _search_stage(source: str, tag: str) -> str:
    def step(no: int, src: str, block: str, cap: int, k: int) -> str:
        t = f"{tag}{no}"
        return f"""
{t}_hits AS MATERIALIZED (SELECT c.*, v.text FROM ({D.candidates(_variants_sql(cap, src), 'act', [(block, block)], NAMES, k, 'words')}) c
  JOIN {_variants_sql(cap, src)} v USING (prospect_id, pos)),
{t}_rows AS MATERIALIZED (SELECT h.*, s.vs, s.adresse_numero, s.adresse_voie_clean, s.code_postal, r.code_postal AS r_cp,
  concat_ws(' ', nullif(r.denomination, ''), nullif(r.denomination_usuelle, '')) AS full_name,
  {D.upper_fold("concat_ws(' ', nullif(r.numero_voie, ''), nullif(r.type_voie, ''), nullif(r.voie, ''))")} AS address
  FROM {t}_hits h JOIN {src} s USING (prospect_id) JOIN act r USING (siret)),
{t}_known AS MATERIALIZED (SELECT *, adresse_numero <> '' AND address <> '' AS known, {D.street_clean('address')} AS street, regexp_extract(address, '^(\\d+)', 1) AS number FROM {t}_rows),
{t}_refs AS MATERIALIZED (SELECT prospect_id, pos, rank, unnest([text] || vs[1:3]) AS a, full_name AS b FROM {t}_rows WHERE full_name <> ''),
{t}_m AS MATERIALIZED ({D.measures(f'{t}_refs')}),
{_ratio_cte(f'{t}_st', f'(SELECT * FROM {t}_known WHERE known)', 'adresse_voie_clean', 'street')},
{t}_name AS (SELECT prospect_id, pos, rank, max(blend) AS blend FROM {t}_refs JOIN {t}_m USING (a, b) GROUP BY ALL),
{t} AS MATERIALIZED (SELECT x.prospect_id, {no} * 100 + x.pos AS position, x.rank, siret, (({D.bucket('coalesce(blend, 0)')}) + {D.geo('code_postal', 'r_cp')}
  + CASE WHEN known THEN {D.street_points('adresse_numero', 'number', 'r')} ELSE 0 END)::DOUBLE AS score
  FROM {t}_known x LEFT JOIN {t}_name USING (prospect_id, pos, rank) LEFT JOIN {t}_st ON {t}_st.a = adresse_voie_clean AND {t}_st.b = street)"""

    rest = f"{tag}_rest AS MATERIALIZED (SELECT * FROM {source} WHERE departement <> '' AND prospect_id NOT IN (SELECT prospect_id FROM {tag}1 WHERE score >= 65))"
    return f"""{step(1, source, 'code_postal', 4, 5)}, {rest}, {step(2, f'{tag}_rest', 'departement', 3, 10)},
{tag}_all AS MATERIALIZED (SELECT * FROM {tag}1 UNION ALL SELECT * FROM {tag}2),
{tag}_tried AS (SELECT * FROM {tag}_all x WHERE NOT EXISTS (SELECT 1 FROM {tag}_all e WHERE e.prospect_id = x.prospect_id AND e.position < x.position AND e.score >= 65)),
{tag}_best AS MATERIALIZED (SELECT prospect_id, siret, score, CASE WHEN score >= 65 THEN 'API_RECHERCHE_EXACT' ELSE 'API_RECHERCHE_PROBABLE' END AS methode FROM (
  SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY score DESC, position, rank) AS first FROM {tag}_tried WHERE score > 0) WHERE first = 1 AND score >= 40)"""


def _shown(results):
    return results.select("prospect_id", "result.siret", "result.score", "result.methode")


@query(f"WITH {BASE}, {_search_stage('p', 's')} SELECT * FROM s_best")
def match_by_name_search(spark, sf):
    p = cut(_normalized(spark, sf), "prospects")
    return _shown(M.match_by_name_search(p, C.active_only(_registry(spark, sf))))


@query(f"WITH {BASE}, {_address_stage('p', 'd')} SELECT * FROM d_best")
def match_by_address(spark, sf):
    return _shown(M.match_by_address(cut(_normalized(spark, sf), "prospects"), _registry(spark, sf)))


@query(f"WITH {BASE}, {_address_stage('p', 'd')} SELECT prospect_id, siret, n AS candidates, name_points, address_points, score FROM d_final")
def method_score_address(spark, sf):
    p = cut(_normalized(spark, sf), "prospects")
    active = C.active_only(_registry(spark, sf))
    here = cut(C.address_candidates(p, active), "address")
    rest = p.join(here.select("prospect_id").distinct(), "prospect_id", "left_anti")
    scored = M.score_address_candidates(here.unionByName(C.nearby_address_candidates(rest, active).drop("alt_ord")), p, active)
    return scored.select("prospect_id", "siret", "candidates", "name_points", "address_points", "score")


@query(f"WITH {BASE}, {_trigram_stage('p', 't')} SELECT * FROM t_best")
def match_by_trigram(spark, sf):
    return _shown(M.match_by_trigram(cut(_normalized(spark, sf), "prospects"), _registry(spark, sf)))


@query(f"WITH {BASE}, {_trigram_stage('p', 't')} SELECT prospect_id, siret, n AS candidates, score FROM t_final")
def method_score_trigram(spark, sf):
    p = cut(_normalized(spark, sf), "prospects")
    active = C.active_only(_registry(spark, sf))

    def scored(firsts):
        variants = explode_variants(firsts, ["prospect_id", "code_postal", "departement"], 5)
        found = C.best_variant_merge(C.name_candidates_with_fallback(variants, active, k=5))
        return M.score_trigram_candidates(found, firsts, active).select("prospect_id", "siret", "candidates", "score")

    return M.once_each(p, scored)


# Stored responses: the parts of a prospect's brand and size in its range of keys, dealt over both steps and three variants. Some companies are
# closed, some establishments are closed or elsewhere, some companies have only a head office.
STORED_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY prospect_id, step, variant_pos ORDER BY place_no) AS result_pos FROM (
  SELECT 'P' || CAST(asked AS STRING) AS prospect_id, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS step, 1 + p_partkey % 3 AS variant_pos,
         CASE WHEN p_partkey % 3 = 0 THEN upper(asked_name) ELSE upper(asked_name) || ' SERVICES' END AS variant, p_partkey AS place_no,
         lpad(CAST(p_partkey AS STRING), 9, '0') AS siren,
         CASE WHEN p_partkey % 6 = 0 THEN p_type || ' ' || p_name WHEN p_partkey % 6 = 1 THEN 'Holding ' || p_brand ELSE p_name END AS nom_complet,
         CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE NULL END AS sigle,
         CASE WHEN p_partkey % 11 = 0 THEN 'C' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'A' END AS company_state,
         {T.long_id('p_partkey')} AS head_siret, CASE WHEN p_partkey % 8 = 0 THEN '75001' ELSE {T.POSTCODE} END AS head_cp,
         CAST(p_size AS STRING) || ' rue ' || p_type || ' ' || p_name AS head_address,
         CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {T.long_id('p_partkey + 300000000')} END AS first_siret,
         CASE WHEN p_partkey % 3 = 0 THEN '99000' ELSE {T.POSTCODE} END AS first_cp,
         CASE WHEN p_partkey % 5 = 1 THEN 'F' WHEN p_partkey % 5 = 2 THEN NULL ELSE 'A' END AS first_state,
         'rue de la ' || p_type || ' ' || p_name AS first_address,
         {T.long_id('p_partkey + 600000000')} AS second_siret, {T.POSTCODE} AS second_cp, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'F' END AS second_state,
         CAST(p_size AS STRING) || ' avenue ' || p_name AS second_address, p_partkey % 9 = 4 AS alone, p_type AS last_name
  FROM (SELECT p_partkey AS asked, p_name AS asked_name, p_brand AS asked_brand, p_size AS asked_size FROM {{part}})
  JOIN {{part}} ON p_brand = asked_brand AND p_size = asked_size AND floor(p_partkey / 15000) = floor(asked / 15000))
"""


def _stored_responses(spark, sf):
    place = lambda k: F.struct(
        F.col(f"{k}_siret").alias("siret"), F.col(f"{k}_cp").alias("code_postal"), F.col(f"{k}_address").alias("adresse"),
        (F.lit("A") if k == "head" else F.col(f"{k}_state")).alias("etat_administratif"),
    )
    company = F.struct(
        "siren", "nom_complet", "sigle", F.col("company_state").alias("etat_administratif"), place("head").alias("siege"),
        F.when(~F.col("alone"), F.array(place("first"), place("second"))).alias("matching_etablissements"),
        F.array(F.struct(F.lit("Ann").alias("prenoms"), F.col("last_name").alias("nom"))).alias("dirigeants"),
    )
    rows = T.run(spark, sf, STORED_SQL).withColumn("company", company)
    grouped = rows.groupBy("prospect_id", "step", "variant_pos", "variant").agg(F.sort_array(F.collect_list(F.struct("result_pos", "company"))).alias("found"))
    return grouped.select("prospect_id", "step", "variant_pos", "variant", F.to_json(F.struct(F.col("found.company").alias("results"))).alias("response"))


def _stored_sql() -> str:
    here = lambda k: f"(NOT alone AND {k}_cp = s.code_postal AND coalesce({k}_state, 'A') = 'A')"
    pick = lambda f: f"CASE WHEN {here('first')} THEN first_{f} WHEN {here('second')} THEN second_{f} ELSE head_{f} END"
    return f"""
w_rows AS MATERIALIZED (SELECT r.prospect_id, step, variant_pos AS pos, result_pos AS rank, variant AS text, s.vs, s.adresse_numero, s.adresse_voie_clean, s.code_postal,
  {pick('cp')} AS r_cp, nom_complet || ' ' || coalesce(sigle, '') AS full_name, coalesce(nullif({pick('siret')}, ''), head_siret) AS siret,
  {D.upper_fold(pick('address'))} AS address, coalesce(company_state, 'A') <> 'A' AS closed FROM ({T.duck(STORED_SQL)}) r JOIN p s USING (prospect_id)),
w_known AS MATERIALIZED (SELECT *, adresse_numero <> '' AS known, {D.street_clean('address')} AS street, regexp_extract(address, '^(\\d+)', 1) AS number FROM w_rows),
w_refs AS MATERIALIZED (SELECT prospect_id, step, pos, rank, unnest([text] || vs[1:3]) AS a, full_name AS b FROM w_rows),
w_m AS MATERIALIZED ({D.measures('w_refs')}),
{_ratio_cte('w_st', '(SELECT * FROM w_known WHERE known)', 'adresse_voie_clean', 'street')},
w_name AS (SELECT prospect_id, step, pos, rank, max(blend) AS blend FROM w_refs JOIN w_m USING (a, b) GROUP BY ALL),
w_all AS MATERIALIZED (SELECT x.prospect_id, x.step * 100 + x.pos AS position, x.rank, siret, CASE WHEN closed THEN 0 ELSE ({D.bucket('coalesce(blend, 0)')}) + {D.geo('code_postal', 'r_cp')}
  + CASE WHEN known THEN {D.street_points('adresse_numero', 'number', 'r')} ELSE 0 END END::DOUBLE AS score
  FROM w_known x LEFT JOIN w_name USING (prospect_id, step, pos, rank) LEFT JOIN w_st ON w_st.a = adresse_voie_clean AND w_st.b = street),
w_tried AS (SELECT * FROM w_all x WHERE NOT EXISTS (SELECT 1 FROM w_all e WHERE e.prospect_id = x.prospect_id AND e.position < x.position AND e.score >= 65)),
w_best AS MATERIALIZED (SELECT prospect_id, siret, score, CASE WHEN score >= 65 THEN 'API_RECHERCHE_EXACT' ELSE 'API_RECHERCHE_PROBABLE' END AS methode FROM (
  SELECT *, row_number() OVER (PARTITION BY prospect_id ORDER BY score DESC, position, rank) AS first FROM w_tried WHERE score > 0) WHERE first = 1 AND score >= 40)"""


@query(f"WITH {BASE}, {_stored_sql()} SELECT * FROM w_best")
def match_stored_responses(spark, sf):
    """Stages 1 and 2 from stored responses instead of a registry search."""
    p = cut(_normalized(spark, sf), "prospects")
    return _shown(M.match_by_name_search(p, responses=readers.parse_name_search(_stored_responses(spark, sf))))


# --- the cascade ---------------------------------------------------------------------------------------------------
# Stored pages under the prospects' own sites, so that the last stage has something to find.
_CASCADE_PAGES = T.SITE_PAGES_SQL
_PAGE_STAGE = f"""
g_best AS MATERIALIZED (SELECT prospect_id, found AS siret, CASE WHEN r.siret IS NULL THEN 65.0 ELSE 80.0 END::DOUBLE AS score,
  CASE WHEN r.siret IS NULL THEN 'SCRAPE_NON_VALIDE' ELSE 'SCRAPE_MENTIONS_LEGALES' END AS methode FROM (%s) JOIN p3 USING (prospect_id)
  LEFT JOIN reg r ON r.siret = found WHERE len(found) = 14)"""


def _page_stage_sql() -> str:
    from workload import lookup

    return _PAGE_STAGE % lookup._FOUND.replace(D.SITES, f"SELECT prospect_id, site_web FROM ({D.PROSPECTS}) WHERE site_web <> ''")


def _cascade_sql() -> str:
    left = lambda new, old, best: f"{new} AS MATERIALIZED (SELECT * FROM {old} WHERE prospect_id NOT IN (SELECT prospect_id FROM {best}))"
    return f"""{BASE}, {_search_stage('p', 's')}, {left('p1', 'p', 's_best')}, {_address_stage('p1', 'd')}, {left('p2', 'p1', 'd_best')},
{_trigram_stage('p2', 't')}, {left('p3', 'p2', 't_best')}, {_page_stage_sql()},
hits AS (SELECT * FROM s_best UNION ALL SELECT * FROM d_best UNION ALL SELECT * FROM t_best UNION ALL SELECT * FROM g_best),
every AS MATERIALIZED (SELECT p.prospect_id, p.nom, coalesce(h.siret, '') AS siret, coalesce(h.score, 0.0)::DOUBLE AS score, coalesce(h.methode, 'NON_TROUVE') AS methode FROM p LEFT JOIN hits h USING (prospect_id)),
live AS MATERIALIZED (SELECT e.prospect_id, nom, CASE WHEN a.siret IS NULL AND e.siret <> '' THEN '' ELSE e.siret END AS siret,
  CASE WHEN a.siret IS NULL AND e.siret <> '' THEN 0.0 ELSE score END::DOUBLE AS score, CASE WHEN a.siret IS NULL AND e.siret <> '' THEN 'RADIE' ELSE methode END AS methode
  FROM every e LEFT JOIN act a ON a.siret = e.siret)"""


def _cascade(spark, sf):
    return M.match_cascade(
        T.prospects(spark, sf), _registry(spark, sf), funding=T.funding(spark, sf), agreements=T.agreements(spark, sf),
        pages=T.run(spark, sf, _CASCADE_PAGES),
    )


@query(f"""WITH {_cascade_sql()} SELECT prospect_id, l.siret, score, methode,
CASE WHEN methode = 'RADIE' THEN '' ELSE coalesce(nullif(opco_proprietaire, ''), nullif(opco_gestion, ''), {D.body('r.naf')}, {D.brand('nom')}, 'À déterminer') END AS opco,
CASE WHEN methode = 'RADIE' THEN '' WHEN coalesce(nullif(opco_proprietaire, ''), nullif(opco_gestion, '')) IS NOT NULL THEN coalesce(f.idcc, '') ELSE '' END AS idcc
FROM live l LEFT JOIN ({D.FUNDING}) f ON f.siret = l.siret LEFT JOIN reg r ON r.siret = l.siret""")
def match_cascade(spark, sf):
    out = _cascade(spark, sf)
    return out.select("prospect_id", "result.siret", "result.score", "result.methode", "result.opco", "result.idcc")


@query(SQL["match_cascade"])
def match_cascade_by_id(spark, sf):
    """The cascade with registry columns from a copy in buckets of the id, and the registry by departments for the searches."""
    search, by_id = scratch_path(spark, "registry"), scratch_path(spark, "by-id")
    registry = _registry(spark, sf)
    sinks.write_registry(registry, search)
    sinks.write_by_id(registry, by_id)
    out = M.match_cascade(
        T.prospects(spark, sf), readers.read_registry(spark, search), funding=T.funding(spark, sf), agreements=T.agreements(spark, sf),
        pages=T.run(spark, sf, _CASCADE_PAGES), by_id=readers.read_by_id(spark, by_id), asked_departments=True,
    )
    return out.select("prospect_id", "result.siret", "result.score", "result.methode", "result.opco", "result.idcc")


@query(f"""WITH {_cascade_sql()} SELECT methode, count(*) AS count FROM every GROUP BY methode""")
def union_stages(spark, sf):
    """Every prospect comes out of the stages once; counted per method."""
    p, reg = cut(_normalized(spark, sf), "prospects"), _registry(spark, sf)
    active = C.active_only(reg)
    results = M.union_stages(p, [
        lambda rest: M.match_by_name_search(rest, active), lambda rest: M.match_by_address(rest, reg),
        lambda rest: M.match_by_trigram(rest, reg), lambda rest: M.match_by_page_id(rest, reg, T.run(spark, sf, _CASCADE_PAGES)),
    ])
    return results.groupBy("result.methode").agg(F.count(F.lit(1)).alias("count"))


@query(f"""WITH {_cascade_sql()} SELECT q.nom, q.adresse, l.siret, CASE WHEN l.siret <> '' THEN 'À contacter' ELSE 'Non enrichi' END AS statut_prospection,
l.methode AS methode_matching, 28 AS width FROM live l JOIN ({D.PROSPECTS}) q USING (prospect_id)""")
def write_enriched(spark, sf):
    path = scratch_path(spark, "enriched")
    sinks.write_enriched(_cascade(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("nom", "adresse", X.or_blank(F.col("siret")).alias("siret"), "statut_prospection", "methode_matching", F.lit(len(back.columns)).alias("width"))


@query(f"""WITH {_cascade_sql()} SELECT prospect_id, siret, score, methode FROM live""")
def prospect_stream(spark, sf):
    """The whole cascade over the prospect table arriving as a stream of two deliveries; the second repeats a half of the first."""
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    p = cut(T.prospects(spark, sf), "arriving")
    at = lambda rows, minutes: rows.withColumn("seen_at", F.timestamp_seconds(F.lit(1700000000 + 60 * minutes)))
    for rows in (at(p, 0), at(p.filter(F.pmod(F.xxhash64("prospect_id"), F.lit(2)) == 0), 15)):
        rows.write.mode("append").parquet(source)
    registry = _registry(spark, sf)
    pages, funding, agreements = T.run(spark, sf, _CASCADE_PAGES), T.funding(spark, sf), T.agreements(spark, sf)

    def match(batch):
        return _shown(M.match_cascade(batch.drop("seen_at"), registry, funding=funding, agreements=agreements, pages=pages))

    schema = at(p, 0).schema
    arriving = spark.readStream.schema(schema).parquet(source)
    match_stream(distinct_prospects(arriving, key="prospect_id", time="seen_at"), match, out, state).awaitTermination()
    shown = PT.StructType([PT.StructField(c, PT.StringType()) for c in ("prospect_id", "siret")] + [PT.StructField("score", PT.DoubleType()), PT.StructField("methode", PT.StringType())])
    return last_matches(read_matches(spark, out, shown))
