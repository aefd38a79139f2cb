import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from spindrift.session import local_session

    session = local_session(cores=8, shuffle_partitions=8, app="tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
