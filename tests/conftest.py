import pytest
from compare import SF, connect, session

from kinlink.session import remove_scratch


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    remove_scratch(spark)
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)
