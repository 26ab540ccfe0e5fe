import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from benthos.session import local_session

    s = local_session(4, "tests", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
