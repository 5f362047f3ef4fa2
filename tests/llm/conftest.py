import brute
import pytest


@pytest.fixture(scope="session")
def rows():
    return brute.awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], brute.COLUMNS)
