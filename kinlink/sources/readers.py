"""Readers. Everything arrives as text; nothing is inferred."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink import constants as K
from kinlink.functions import text as X
from kinlink.session import Markers

#: Text one task of an aggregate over all rows of a CSV input sorts.
BYTES_PER_TASK = 64 << 20
CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}

_PLACE = [
    ("siret", "string"), ("code_postal", "string"), ("activite_principale", "string"),
    ("tranche_effectif_salarie", "string"), ("date_creation", "string"), ("adresse", "string"),
]
_LOCAL = [
    ("etat_administratif", "string"), ("nom_enseigne", "string"), ("libelle_commune", "string"),
    ("numero_voie", "string"), ("libelle_voie", "string"),
]


def _struct(fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n, _ in fields])


NAME_SEARCH_SCHEMA = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        *[T.StructField(n, T.StringType()) for n in ("siren", "nom_complet", "sigle", "etat_administratif")],
                        T.StructField("siege", _struct(_PLACE + _LOCAL)),
                        T.StructField("matching_etablissements", T.ArrayType(_struct(_PLACE + _LOCAL))),
                        T.StructField("dirigeants", T.ArrayType(_struct([("prenoms", ""), ("nom", "")]))),
                    ]
                )
            ),
        )
    ]
)


def _read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, all columns text, blanks instead of NULL left to the caller.

    With ``multi_line`` quoted values may hold line breaks; a file is then read by one task, so leave it off for the
    registry's large files.
    """
    return spark.read.options(**CSV).option("inferSchema", False).option("multiLine", multi_line).csv(path)


def _project(df: DataFrame, headers: dict[str, str]) -> list:
    """Wanted columns by header name, trimmed; a missing column reads as blank."""
    present = set(df.columns)
    return [
        (X.strip(X.or_blank(F.col(f"`{src}`"))) if src in present else F.lit("")).alias(out)
        for out, src in headers.items()
    ]


def read_registry_csv(spark: SparkSession, path: str, headers: dict[str, str] | None = None, digits: int = 14) -> DataFrame:
    """Establishments: wanted columns by header, trimmed; rows whose id has the wrong length are dropped.

    Only the wanted columns are parsed out of the file.
    """
    headers = headers or K.REGISTRY_HEADERS
    raw = _read_text_csv(spark, path)
    needed = [c for c in ("siret", "siren", "etat_administratif") if headers[c] not in raw.columns]
    if needed:
        raise ValueError(f"missing columns: {needed}")
    return raw.select(*_project(raw, headers)).filter(F.length("siret") == digits)


def read_legal_units(spark: SparkSession, path: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Legal units with at least one name; the first row of a unit wins, in file order.

    File order is (file, offset of the split, row within the split); the pick is an aggregate, so copies of a unit
    collapse before the shuffle. It sorts, so rows carry the number of their file instead of its path, and of a large
    input each task gets about ``BYTES_PER_TASK``.
    """
    headers = headers or K.LEGAL_UNIT_HEADERS
    raw = _read_text_csv(spark, path)
    cols = [X.or_blank(F.col(f"`{src}`")).alias(out) for out, src in headers.items()]
    rows = raw.select(
        *cols, F.input_file_name().alias("__file"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("i"),
    )
    files = enumerate(sorted(raw.inputFiles(), key=unquote))
    numbers = spark.createDataFrame([(f, n) for n, f in files], "__file string, f int")
    rows = rows.join(F.broadcast(numbers), "__file", "left").select(*headers, F.struct("f", "b", "i").alias("__place"))
    rows = rows.filter((F.col("denomination") != "") | (F.col("denomination_usuelle") != ""))
    tasks = int(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // BYTES_PER_TASK
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "siren")
    first = rows.groupBy("siren").agg(
        F.min_by(F.struct("denomination", "denomination_usuelle"), F.col("__place")).alias("u")
    )
    return first.select("siren", "u.denomination", "u.denomination_usuelle")


def prospects_from(raw: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Prospect table from any frame: header aliases, blanks for NULL, rows without a name dropped."""
    headers = headers or K.PROSPECT_HEADERS
    named = {}
    for column in raw.columns:
        for field, aliases in headers.items():
            if column.lower().strip() in aliases:
                named[field] = column
    if "nom" not in named:
        raise ValueError(f"no name column among {raw.columns}")
    cols = {f: X.or_blank(F.col(f"`{named[f]}`").cast("string")) if f in named else F.lit("") for f in headers}
    cols["code_postal"] = X.strip(F.replace(cols["code_postal"], F.lit(".0"), F.lit("")))
    return raw.select(*[c.alias(f) for f, c in cols.items()]).filter(F.col("nom") != "")


def read_prospects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return prospects_from(_read_text_csv(spark, path, multi_line))


def with_prospect_id(df: DataFrame) -> DataFrame:
    """A repeatable id per prospect row: hash of its content plus a counter among equal rows.

    Equal rows are counted inside their hash group only, so no global ordering is needed.
    """
    digest = F.sha2(F.concat_ws("\u0001", *[X.or_blank(F.col(c).cast("string")) for c in df.columns]), 256)
    distinct = df.withColumn("__d", digest).groupBy("__d", *df.columns).agg(F.count(F.lit(1)).alias("__n"))
    # A row repeated very often is expanded in chunks spread over tasks, not by the one task that counted it.
    chunk = 100_000
    chunks = distinct.selectExpr("*", f"explode(sequence(0L, (__n - 1) div {chunk})) AS __c").repartition("__d", "__c")
    copies = chunks.selectExpr("*", f"explode(sequence(__c * {chunk} + 1, least(__n, (__c + 1) * {chunk}))) AS __i")
    return copies.select(F.concat_ws("-", "__d", "__i").alias("prospect_id"), *df.columns)


def parse_name_search(responses: DataFrame, body: str = "response") -> DataFrame:
    """One row per result of stored name-search responses, with its 1-based position; other columns are kept."""
    kept = [c for c in responses.columns if c != body]
    parsed = responses.select(*kept, F.from_json(body, NAME_SEARCH_SCHEMA).alias("__json"))
    rows = parsed.select(*kept, F.posexplode("__json.results").alias("result_pos", "r"))
    return rows.select(*kept, (F.col("result_pos") + 1).alias("result_pos"), "r.*")


def read_name_search_json(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one JSON line per query: prospect_id, step, variant_pos, variant, response (JSON text)."""
    schema = "prospect_id string, step int, variant_pos int, variant string, response string"
    return parse_name_search(spark.read.schema(schema).json(path))


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of a published table's current version; the folder itself where no version was published."""
    published = Markers(spark, f"{path}/_published").names()
    return f"{path}/{published[-1]}" if published else path


def read_by_id(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_by_id``, or its current version. Joins on its id don't shuffle it.

    The session's catalog gets a table over the folder, as Spark knows the buckets of tables only.
    """
    path = current_version(spark, path)
    key, _, buckets = Markers(spark, f"{path}/_buckets").names()[0].rpartition("@")
    name = f"by_id_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/_columns").schema)
        clustered = f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {clustered} LOCATION '{path}'")
    return spark.table(name)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry as written by ``write_registry``, or its current version, in its fixed column order."""
    path = current_version(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in K.REGISTRY_COLUMNS])
    return spark.read.schema(schema).parquet(path).select(*K.REGISTRY_COLUMNS)
