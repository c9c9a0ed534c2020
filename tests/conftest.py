import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g", spark__speculation="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
