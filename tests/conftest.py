import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from pollmirror.session import local_session

    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
