"""E01 as a bucketed table."""

import pytest

from pagelode.operators import dom
from pagelode.plans import registry

SF = "/root/testdata/sf0.001"
ONCE = ["e03_dominant_groups", "e04_listing_rows", "e05_main_content", "e16_surfaces", "e21_controls", "e21_option_labels", "e22_selectors",
        "e22_containers", "e23_item_growth", "x04_tree_scores", "x05_tree_surplus", "x06_tree_gate", "f04_component_pages"]


@pytest.mark.parametrize("name", ONCE)
def test_no_page_walk_is_left_in_the_plan(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_windows_within_pages_need_no_exchange(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from pagelode.sources import adapters as A
    stored = dom.stored_nodes(A.all_pages(spark, SF), with_text=False)
    ranked = stored.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "parent_pos", "tag").orderBy("pos")))
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in stored.groupBy("page_id", "tag").count()._jdf.queryExecution().executedPlan().toString()
    plain = dom.dom_nodes(A.all_pages(spark, SF), with_text=False)
    assert sorted((r.page_id, r.pos, r.tag) for r in stored.collect()) == sorted((r.page_id, r.pos, r.tag) for r in plain.collect())
    assert dom.stored_nodes(A.all_pages(spark, SF).filter("page_id < 0")).count() == 0
