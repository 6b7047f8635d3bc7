import pytest

from regfeed.session import build_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
