import os

import pytest

os.environ.setdefault("TRACKLAKE_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from tracklake.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
