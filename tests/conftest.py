import pytest

from weirflow.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    yield session
    release(session)
    session.stop()
