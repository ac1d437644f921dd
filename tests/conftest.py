import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tableloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tableloom-tests", "4", 4)
