import pytest

from framelake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, memory="4g", shuffle_partitions=4)
    yield s
    s.stop()
