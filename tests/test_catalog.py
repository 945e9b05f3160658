"""Every registered query next to its SQL, over the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import check_oracle  # noqa: E402

from recollect.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not Path(SF_DIR).is_dir():
        pytest.skip("no test tables")
    return check_oracle.open_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, tables, name):
    made = []

    def query(session, sf_dir):
        made.append(catalog.queries()[name](session, sf_dir))
        return made[0]

    rows, _, difference = check_oracle.compare(spark, tables, query, catalog.oracle_sql().get(name), SF_DIR)
    assert difference is None
    assert rows > 0 or name in catalog.oracle_sql()
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
