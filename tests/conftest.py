import pytest

from latticeq.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session("tests", cpus=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
