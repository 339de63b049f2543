import pytest

from talkmill.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
