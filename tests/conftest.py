import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from turnlens.session import get_session
    s = get_session("local[4]", 4, app_name="turnlens-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF001
