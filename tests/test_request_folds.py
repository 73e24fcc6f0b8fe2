"""Scores of requests are dealt by item once, whatever the number of folds."""

import re

import pytest

from marquee.operators import traits as R
from marquee.plans import requests as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joins_by_hint(spark):
    """No table is broadcast for being small, as on large inputs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_folds_do_not_deal_the_scores_again(spark, joins_by_hint):
    calls, traits, requests = Q.spec_tables(spark, Q.REQUESTS)
    ranked = Q.run_requests(calls, traits, requests, R.category_rows(spark), Q.views_of(spark, SF))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    dealt = [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE", plan)]
    # The counts of matches stay: a trait and an item are their keys.
    again = [keys for keys in dealt if "movie_id" in keys and len(keys) > 1 and keys != ["request", "trait", "movie_id"]]
    assert not again, again
    # Nor are parts put together until one task holds the tables of all folds of many items.
    assert "REPARTITION_BY_NUM" in plan


def test_hits_say_whether_they_are_shorts(spark):
    """So that shorts leave without a further join of the hits."""
    cards = spark.createDataFrame([(1, 1.0, 9, 3, [1]), (2, 1.0, 9, 1, [1]), (3, 1.0, 9, None, [1]), (4, None, 9, 1, [1])], "movie_id long, released double, runtime int, release_format int, genre_ids array<int>")
    _, _, requests = Q.spec_tables(spark, [Q.request([], released=(0.0, 2.0), genres=[1])])
    hits = spark.createDataFrame([(0, m) for m in (1, 2, 3, 4)], "request int, movie_id long")
    assert sorted(map(tuple, Q.passing(hits, requests, cards).collect())) == [(0, 1, True), (0, 2, False), (0, 3, False)]
