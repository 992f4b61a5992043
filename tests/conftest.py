import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paths import SF_SMALL


@pytest.fixture(scope="session")
def spark():
    from stockroom.session import get_session
    s = get_session("local[4]", 8)
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s


@pytest.fixture(scope="session")
def t_small(spark):
    from stockroom.sources.tables import from_testdata
    return from_testdata(spark, SF_SMALL)
