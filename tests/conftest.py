import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.session import local_session

    session = local_session(cores=8, partitions=8)
    yield session
    session.stop()
