import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from suite.check import session

    yield session("8")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
