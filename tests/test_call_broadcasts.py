"""The calls of requests are broadcast to the views, whatever their sizes."""

import pytest

from marquee.plans import requests as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joins_by_hint(spark):
    """No table is broadcast for being small, as on large inputs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_meet_the_views_without_a_shuffle_of_these(spark, joins_by_hint):
    calls, _, _ = Q.spec_tables(spark, Q.REQUESTS)
    views = Q.views_of(spark, SF)
    for made in (Q.entity_calls(calls, views["credits"]), Q.keyword_calls(calls, views["traits"]), Q.award_calls(calls, views["awards"]), Q.franchise_calls(calls, views["entries"]), Q.media_calls(calls, views["cards"]), Q.window_calls(calls, views["cards"])):
        assert "SortMergeJoin" not in plan(made) and "BroadcastHashJoin" in plan(made)
