import pytest

from factloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="8", shuffle_partitions=8)
    yield s
    s.stop()
