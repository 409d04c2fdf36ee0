import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from hearthmark.session import build_session
    return build_session("tests", "local[8]")


@pytest.fixture(scope="session")
def con():
    from compare import duck
    return duck(SF)


@pytest.fixture(scope="session")
def tables(spark):
    from hearthmark.sources.tables import Tables
    return Tables(spark, SF)
