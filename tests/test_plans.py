"""Every registered query runs on the smallest scale, and plans stay free of cross joins."""

import pytest

from pagelode.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
# Joins with a one-row aggregate show as nested loops by design.
ONE_ROW = {"g04_merge_seeds", "g06_promote_navigations", "e14_font_families", "q06_artifact_summary", "v17_verdict", "v19_fixture_routes", "k06_typography_report"}


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(NAMES)


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("st", "s02", "s09", "g02", "g03", "k03", "k04"))])
def test_plan_has_no_cross_join(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    if name not in ONE_ROW:
        assert "Join Inner\n" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    from pagelode.sources import adapters as A
    plan = A.table(spark, SF, "events").filter("event_type = 'view'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
