"""Every registered query beside its SQL on the smallest tables, and what their plans look like."""

import os
import re

import oracle
import pytest

from curatrix.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, connection, name):
    assert oracle.compare(spark, SF, name, connection) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    "name", ["term_coverage", "rank_chunks", "near_dedup", "select_urls", "collected_urls", "cosine_top_k", "best_patterns", "robots_allowed"]
)
def test_no_pairing_of_all_rows(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_and_columns_reach_the_scan(spark):
    frame = registry.queries()["cache_misses"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan.split("LeftAnti")[0]
    plan = registry.queries()["url_domain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
