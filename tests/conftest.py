import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session(4, app="tessera-tests", memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
