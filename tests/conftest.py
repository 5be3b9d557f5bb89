import pytest

from barworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("barworks-tests", cores=8, shuffle=4)
    yield session
    session.stop()
