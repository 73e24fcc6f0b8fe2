"""The counts of trait_categories hold every item that a call finds, however many there are."""

from pyspark.sql import functions as F

from marquee.operators import endpoints as E
from marquee.plans import requests as Q


def test_calls_that_score_every_item_lose_none(spark):
    n = E.UNBOUNDED_LIMIT + Q.VECTOR_LIMIT
    cards = spark.range(n).select(F.col("id").alias("movie_id"), (F.col("id") / n).alias("popularity"), (F.col("id") % 101).cast("double").alias("reception"))
    vectors = cards.select("movie_id", F.lit(1).alias("space"), F.array(F.lit(1.0), F.col("popularity")).alias("vector"), F.sqrt(1 + F.col("popularity") ** 2).alias("norm"))
    calls, _, _ = Q.spec_tables(spark, [Q.request([("SOLO", "neutral", True, [("CULTURAL_STATUS", [Q.prior("acclaimed"), Q.prior("niche")]), ("PLOT_EVENTS", [Q.near(1, 5)])])])])
    found = lambda *parts: {r["call_id"]: r["n"] for r in parts[0].unionByName(parts[1]).groupBy("call_id").agg(F.countDistinct("movie_id").alias("n")).collect()}
    assert found(Q.prior_calls(calls, cards, None, bounded=False), Q.vector_calls(calls, vectors, cards, None)) == {0: n, 1: n, 2: n}
    assert found(Q.prior_calls(calls, cards, None), Q.vector_calls(calls, vectors, cards)) == {0: E.UNBOUNDED_LIMIT, 1: E.UNBOUNDED_LIMIT, 2: Q.VECTOR_LIMIT}


def test_the_query_asks_for_all(spark, monkeypatch):
    monkeypatch.setattr(Q, "VECTOR_LIMIT", 3)
    monkeypatch.setattr(E, "UNBOUNDED_LIMIT", 3)
    items = {r["items"] for r in Q.trait_categories(spark, "/root/testdata/sf0.001").where("route = 'metadata' AND tier = 7").collect()}
    assert min(items) > 3
