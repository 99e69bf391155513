"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from rollcall.plans.catalog import QUERIES
from rollcall.plans.oracle import ORACLE
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(spark, SF, name, con)
    assert ok, msg


def test_scenarios_reach_the_hard_branches(con):
    """The gate means something only if its oracle has rejects, late attempts and every broken rule."""
    resolved = con.sql(ORACLE["resolve_collisions"]).df()
    assert (resolved["status"] == "rejected").sum() > 0 and resolved["attempt"].max() > 2
    rejected = con.sql(ORACLE["profiles_rejected"]).df()
    assert set(rejected["variant"]) == {"v1", "v2"}
    assert set(rejected["reason"]) == {"username_unique", "username_not_null", "username_length"}
    assert set(con.sql(ORACLE["seed_report"]).df()["status"]) == {"existing", "created", "rejected"}
    assert con.sql(ORACLE["constraint_report"]).df()["rule"].nunique() == 7
