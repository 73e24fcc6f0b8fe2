"""The pool's ends are aggregated before any exchange, not gathered by space."""

from marquee import registry


def test_rescale_deals_no_item_by_space(spark):
    plan = registry.queries()["vec_pool_rescale"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan
