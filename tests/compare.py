"""Run registered queries in Spark and their SQL in DuckDB and compare rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinlink.session import SETTINGS  # noqa: E402
from workload.tables import TABLES  # noqa: E402

#: The smallest tables, on which the tests run.
SF = "/root/testdata/sf0.001"


def session(cores: int = 8) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName("kinlink")
    for k, v in {
        **SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | int):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    for name, words in {"text": ("string", "varchar"), "int": ("int", "long"), "float": ("double", "float", "decimal"), "bool": ("bool",)}.items():
        if any(w in t for w in words):
            return name
    return t


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, run, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = run(spark, sf)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    t1 = time.time()
    note = f"{sum(rows.values())} rows, spark {t1 - t0:.1f}s"
    if sql is None:
        return False, note + ", no sql"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    note += f", sql {time.time() - t1:.1f}s"
    if sorted(names) != cols:
        return False, f"{note}: columns {cols} != {sorted(names)}"
    kinds = {c: (kind(str(df.schema[c].dataType)), kind(types[c])) for c in cols}
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if rows != want:
        return False, f"{note}: {sum(want.values())} wanted; extra {list((rows - want).items())[:3]} missing {list((want - rows).items())[:3]}"
    if not rows:
        return False, note + ": empty"
    return not wrong, note + (f": types {wrong}" if wrong else "")


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in only or queries:
        t = time.time()
        try:
            ok, note = compare(spark, con, sf, queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, note[:1800], flush=True)
        bad += [] if ok else [name]
    print(len(only or queries) - len(bad), "ok;", "failed:", bad)
