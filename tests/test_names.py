"""Golden values of names and addresses."""

import pytest
from pyspark.sql import functions as F

from kinlink.functions import rules as R
from kinlink.functions import similarity as S
from kinlink.operators.normalize import normalize_prospects

NAMES = [
    ("Cors'Auto", "Ajaccio", "CORS AUTO", "CORS AUTO; CORS"),
    ("Equip'Auto", "Ajaccio", "EQUIP AUTO", "EQUIP AUTO; EQUIP"),
    ("Auto-Relais", "Ajaccio", "AUTO RELAIS", "AUTO RELAIS; RELAIS"),
    ("AJACCIO AUTO RAPID'SERVICES", "Ajaccio", "AUTO RAPID SERVICES", "AUTO RAPID SERVICES; RAPID"),
    ("AD CARROSSERIE ROCCASERRA", "Ajaccio", "CARROSSERIE ROCCASERRA", "CARROSSERIE ROCCASERRA; ROCCASERRA"),
    ("Sarl Garage Du Golfe", "Ajaccio", "GARAGE GOLFE", "GARAGE GOLFE; GOLFE"),
    ("Speedy", "Ajaccio", "SPEEDY", "SPEEDY"),
    ("Eurotyre - Garage 2A Pneus – Carrosserie", "Ajaccio", "GARAGE 2A PNEUS", "GARAGE 2A PNEUS; GARAGE PNEUS 2A"),
    ("Garage le grand ajaccio", "Sarrola-Carcopino", "GARAGE GRAND AJACCIO", "GARAGE GRAND AJACCIO; AJACCIO GRAND"),
    (
        "Point S - Ajaccio (Auto Pneus Services Ajaccio)", "Ajaccio", "POINT S AJACCIO AUTO PNEUS SERVICES AJACCIO",
        "AUTO PNEUS SERVICES; POINT S AJACCIO AUTO PNEUS SERVICES AJACCIO; AJACCIO AUTO PNEUS SERVICES AJACCIO; "
        "SERVICES PNEUS AUTO; AJACCIO AJACCIO POINT; AJACCIO AJACCIO",
    ),
    ("Chez St.Jean été", "St.Jean", "ETE", "ETE"),
    ("", "", "", ""),
]
ADDRESSES = [
    ("15 Rue Jean Nicoli, 20090 Ajaccio", "15", "R JEAN NICOLI"),
    ("29 Rue Paul Colonna d'Istria, 20090 Ajaccio", "29", "R PAUL COLONNA ISTRIA"),
    ("32 Avenue du Docteur Noël Franchini, 20000 Ajaccio", "32", "AV DOCTEUR NOEL FRANCHINI"),
    ("Route de Baleone, 20167 Afa", "", "RTE BALEONE 20167 AFA"),
    ("12 bis rue X", "12", "BIS R X"),
    ("12bis rue X", "12BIS", "R X"),
    (None, "", ""),
]


@pytest.fixture(scope="module")
def names(spark):
    df = spark.createDataFrame([(n, c, "20090", "") for n, c, _, _ in NAMES], "nom string, ville string, code_postal string, adresse string")
    return {r.nom: r for r in normalize_prospects(df).collect()}


@pytest.mark.parametrize("name, city, clean, variants", NAMES)
def test_names(names, name, city, clean, variants):
    assert names[name].nom_clean == clean
    assert "; ".join(names[name].nom_variantes) == variants


def test_cleaning_is_idempotent(spark, names):
    clean = [r.nom_clean for r in names.values() if not r.nom_clean.startswith(("SPEEDY", "POINT"))]
    df = spark.createDataFrame([(c, "", "", "") for c in clean], "nom string, ville string, code_postal string, adresse string")
    assert all(r.nom == r.nom_clean for r in normalize_prospects(df).collect())


def test_addresses(spark):
    df = spark.createDataFrame([("x", "", "75001", a) for a, _, _ in ADDRESSES], "nom string, ville string, code_postal string, adresse string")
    got = [(r.adresse_numero, r.adresse_voie_clean) for r in normalize_prospects(df).collect()]
    assert got == [(n, s) for _, n, s in ADDRESSES]


def test_decomposed_accents(spark):
    df = spark.createDataFrame([("été Œuvre",)], "s string")
    from kinlink.functions.text import fold_name

    assert df.select(fold_name(F.col("s"))).first()[0] == "ETE ŒUVRE"


@pytest.mark.parametrize("a, b, value", [
    ("CORS AUTO", "CORSE AUTOMOBILE", 8 / 19), ("EQUIP AUTO", "EQUIP AUTO CORSE", 11 / 17), ("PACHA", "LE PACHA", 6 / 9),
    ("word", "two words", 4 / 11), ("", "x", 0.0), ("x", "x", 1.0),
])
def test_trigrams(spark, a, b, value):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    one, other = df.select(S.trigram_similarity(F.col("a"), F.col("b")), S.trigram_similarity(F.col("b"), F.col("a"))).first()
    assert one == other == pytest.approx(value)


def test_checksum_rules(spark):
    rows = [("44306184100047", True, False), ("97980724500019", True, True), ("443 061 841", True, True), ("979807245", True, True), ("12345678901234", False, False), (None, False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = df.select(R.valid_checksum(F.col("s")), R.valid_checksum(F.col("s"), parity="odd")).collect()
    assert [(bool(a), bool(b)) for a, b in got] == [r[1:] for r in rows]


def test_departments(spark):
    df = spark.createDataFrame([("20090",), ("20190",), ("20200",), ("97400",), ("75001",), (None,)], "cp string")
    got = df.select(R.department_of(F.col("cp")), R.department_of(F.col("cp"), "short")).collect()
    assert [tuple(r) for r in got] == [("2A", "2A"), ("2A", "2A"), ("2B", "2A"), ("974", "974"), ("75", "75"), ("", "")]
