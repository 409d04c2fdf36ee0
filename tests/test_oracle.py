"""Every registered query against its SQL on DuckDB."""

import os

import pytest
from compare import compare

from hearthmark.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, msg = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok is not False, msg
