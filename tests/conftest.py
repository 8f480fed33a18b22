import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(cores=4, shuffle=4, name="tests", memory="3g")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
