import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesforge.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, app_name="seriesforge-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
