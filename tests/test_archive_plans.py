"""Projections of archives meet what they look up within the archive's row: no table goes to the driver or is shuffled for it."""

import pytest

from assaylake.operators import analytic as Y
from assaylake.operators import archives as A
from assaylake.plans.nested import corpus
from assaylake.plans.registry import Tables
from assaylake.sources.settled import settled


@pytest.fixture(scope="module")
def archives(spark):
    return corpus(Tables(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("project", [A.results, A.integrity_violations, Y.lineage, Y.device_context, Y.analytic_rows])
def test_lookups_stay_within_the_row(archives, project):
    plan = project(archives)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_archives_are_derived_from_narrow_rows(archives):
    """No record passes through JSON, and what a projection leaves unread is not made."""
    plan = archives.selectExpr("metadata.archive_id", "size(experiments) AS n")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "relation_id" not in plan



def test_settled_tables_are_not_broadcast(spark):
    """A settled table is small on disk however many rows it unfolds to, so its size says nothing of them."""
    left = settled(spark.range(1000).selectExpr("id", "id % 7 AS k"))
    right = settled(spark.range(1000).selectExpr("id", "repeat('x', 50) AS v")).filter("v <> ''").select("id")
    plan = left.join(right, "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
