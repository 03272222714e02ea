import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from quillstack.session import local_session

    yield local_session(4, 4)


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / os.environ.get("TEST_SF", "sf0.001"))
