import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark():
    from quillmill.session import local_session

    s = local_session(8, 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
