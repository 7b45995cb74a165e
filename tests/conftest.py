import pytest

from tokenledger.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def store(spark, tmp_path):
    from tokenledger.operators.store import Store

    return Store(spark, str(tmp_path / "store"))
