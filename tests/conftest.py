import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilwork.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
