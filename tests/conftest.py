import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkarch.session import session
    from sparkarch.shipping import ship

    s = ship(session(4, 4))
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
