import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import local_session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return local_session(4)
