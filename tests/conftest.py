import pytest

from siftmill.session import build

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
