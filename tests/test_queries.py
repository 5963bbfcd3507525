"""Registered queries against their SQL. ISOHALINE_ALL=1 runs every one of them."""

import os

import pytest

from catalog import ORACLES, QUERIES
from check import difference, duck

SF = "/root/testdata/sf0.001"
SOME = (
    "dedup_levels select_batch qc_audit profile_medians depth_profile regional_months heat_content_all month_depth_grid "
    "climatology_all coverage_probe method_eval plan_violations question_selections"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("ISOHALINE_ALL") else SOME)
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
