import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from encore.session import get_session
    s = get_session("local[8]", app="encore-tests", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()
