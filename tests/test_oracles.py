"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import differences
from trailframe.plans.oracle import ORACLES
from trailframe.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert differences(frame, entry.oracle_sql()[name], SF_DIR) is None


def test_entry_runs(spark):
    rows = {r["mode"]: r["samples"] for r in entry.entry(spark).collect()}
    assert rows == {"frontier": 13, "target": 16, "action": 472, "stop": 31}
