import pytest

from twinarm.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a frame as dictionaries, sorted by the given columns."""

    def read(df, *order):
        found = [r.asDict() for r in df.collect()]
        return sorted(found, key=lambda r: tuple((r[o] is None, r[o]) for o in order)) if order else found

    return read
