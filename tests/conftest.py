import pytest

from strandwise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, 4, **{"spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
