"""Agreements of several labels: codes cut to four digits name several suppliers once their keys have five."""

import os

import duckdb
import pytest
from compare import SF, compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinlink.operators.search import search_count, search_prospects
from kinlink.plans.cascade import enrich_results, unmatched_results
from workload.tables import TABLES, agreements, funding, prospects, raw_registry


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The smallest tables with every supplier under a key of four digits and ten of five."""
    folder = str(tmp_path_factory.mktemp("long"))
    con = duckdb.connect()
    changed = {
        "lineitem": f"SELECT * REPLACE (l_suppkey + 1000 AS l_suppkey) FROM '{SF}/lineitem.parquet'",
        "supplier": f"SELECT * EXCLUDE (i) REPLACE (CASE WHEN i = 0 THEN s_suppkey + 1000 ELSE (s_suppkey + 1000) * 10 + i - 1 END AS s_suppkey, 9.0 AS s_acctbal) FROM '{SF}/supplier.parquet', range(11) t(i)",
    }
    for t in TABLES:
        if t in changed:
            con.execute(f"COPY ({changed[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["require_criterion", "search_count", "write_extract", "search_prospects"])
def test_query_with_several_labels(spark, long_keys, name):
    ok, note = compare(spark, connect(long_keys), long_keys, entry.queries()[name], entry.oracle_sql()[name])
    assert ok or note.endswith(": empty"), note


def test_count_is_that_of_the_search(spark, long_keys):
    tables = raw_registry(spark, long_keys), funding(spark, long_keys)
    labels, asked = agreements(spark, long_keys), {"departments": [f"{d:02d}" for d in range(1, 26)], "naf": "2"}
    rows = search_prospects(*tables, labels, **asked).count()
    assert search_count(*tables, **asked, agreements=labels).first().total == rows > search_count(*tables, **asked).first().total


def test_cascade_result_stays_one_row(spark, long_keys):
    p = prospects(spark, long_keys).limit(1)
    code = funding(spark, long_keys).first().idcc
    result = unmatched_results(p).withColumn("result", F.col("result").withField("idcc", F.lit(code)))
    labels = agreements(spark, long_keys).filter(f"idcc = '{code}'")
    assert labels.count() == 11
    out = enrich_results(result, raw_registry(spark, long_keys), None, labels).collect()
    assert [r.result.convention_collective for r in out] == [min(r.libelle for r in labels.collect())]
