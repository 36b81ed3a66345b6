import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import build_session

    s = build_session("local[8]", "tests", 8, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/tidewater-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
