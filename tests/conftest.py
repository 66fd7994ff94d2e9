import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from semcorpus.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4, memory="8g")


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
