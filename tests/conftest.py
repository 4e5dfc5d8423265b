import pytest

from quern.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "quern-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
