import pytest

from loamdex.session import local_session, sweep


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, memory="4g", partitions=4)
    yield session
    sweep(session)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
