import pytest

from stratograph.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "2"})
    yield session
    session.stop()
