import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from foldwise.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="8g")
    yield session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
