import pytest

from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
