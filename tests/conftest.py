import pytest

from urlsieve.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def page_urls(spark, sf):
    return [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
