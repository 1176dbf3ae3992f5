import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, ship_package

    s = local_session("4", "6g", 4)
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
