import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("tests", 8, 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    import compare

    return compare.duck(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
