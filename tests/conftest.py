import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wafermill.session import local_session

    return local_session("8", "tests")


@pytest.fixture(scope="session")
def duck():
    from compare import duck_connection

    return duck_connection(SF_DIR)
