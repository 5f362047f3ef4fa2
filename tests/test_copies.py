"""Equal names, addresses and prospects are worked on once, and every row still gets its result."""

from pyspark.sql import functions as F

from kinlink.operators import normalize as N
from kinlink.plans import cascade as M

COLUMNS = "prospect_id string, nom string, adresse string, code_postal string, ville string, departement string"
CONTENTS = [
    ("SARL Pneus du Golfe (Ajaccio)", "12 rue de la Paix, 20000 Ajaccio", "20000", "Ajaccio", ""),
    ("Garage Fabre", None, "13001", None, "13"), (None, "3 rue Longue", None, "Nice", None), ("Garage Fabre", "3 rue Longue", "06000", "Nice", ""),
]


def _rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_names_and_addresses_are_cleaned_once(spark, monkeypatch):
    df = spark.createDataFrame([(f"p{i:03d}", *CONTENTS[i % 4]) for i in range(40)], COLUMNS)
    seen = {}

    def counting(name):
        work = getattr(N, name)

        def run(rows, *args, **options):
            seen[name] = rows.count()
            return work(rows, *args, **options)

        monkeypatch.setattr(N, name, run)
        return work

    names, address = counting("normalize_names"), counting("normalize_address")
    got = N.normalize_prospects(df)
    assert seen == {"normalize_names": 4, "normalize_address": 3}
    given = got.select("prospect_id", *COLUMNS.replace(" string", "").split(", ")[1:])
    assert _rows(got) == _rows(address(names(given)))


def test_equal_prospects_are_matched_once(spark, monkeypatch):
    df = N.normalize_prospects(spark.createDataFrame([(f"p{i:03d}", *CONTENTS[i % 4]) for i in range(40)], COLUMNS))
    seen = []

    def run(firsts):
        seen.append(firsts.count())
        return firsts.select("prospect_id", "nom", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))

    got = M.once_each(df, run)
    assert seen == [4]
    assert sorted(map(tuple, got.select("prospect_id", "nom", "n").collect()), key=str) == sorted(
        ((f"p{i:03d}", CONTENTS[i % 4][0], n) for i in range(40) for n in (1, 2)), key=str
    )


def test_stages_search_equal_prospects_once(spark, monkeypatch):
    p = N.normalize_prospects(spark.createDataFrame([(f"p{i:03d}", *CONTENTS[1]) for i in range(30)], COLUMNS))
    registry = spark.createDataFrame(
        [("1" * 14, "GARAGE FABRE", "GARAGE FABRE", "13001")], "siret string, denomination string, denomination_clean string, code_postal string"
    )
    more = ["siren", "denomination_usuelle", "enseigne", "enseigne_clean", "naf", "tranche_effectif", "date_creation", "commune", "numero_voie", "type_voie", "voie", "voie_clean"]
    registry = registry.select("*", F.lit("13").alias("departement"), F.lit("A").alias("etat_administratif"), *[F.lit("").alias(c) for c in more])
    asked, search, words = [], M.C.name_candidates_with_fallback, M.C.name_search
    watch = lambda f: lambda variants, *a, **o: (asked.append(variants.select("prospect_id").distinct().count()), f(variants, *a, **o))[1]
    monkeypatch.setattr(M.C, "name_candidates_with_fallback", watch(search))
    monkeypatch.setattr(M.C, "name_search", watch(words))
    for match in (M.match_by_trigram, M.match_by_name_search):
        assert [r.siret for r in match(p, registry).select("result.siret").collect()] == ["1" * 14] * 30
    assert asked and max(asked) == 1
