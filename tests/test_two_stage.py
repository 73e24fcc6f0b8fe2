"""Two-stage retrieval against the exact query."""

import math
import random

import pytest

from marquee.operators import twostage as V
from marquee.operators.vector import similarities, top_per_space
from marquee.sources import catalogue as C

SF = "/root/testdata/sf0.1"
ANCHORS = [0, 1, 17, 99, 333]


@pytest.mark.parametrize("k,oversample", [(10, 1), (50, 1), (50, 3)])
def test_recall(spark, k, oversample):
    vectors = C.vectors(spark, SF)
    exact = top_per_space(similarities(vectors, ANCHORS), k)
    share = V.recall(V.top_two_stage(V.vector_codes(spark, SF), vectors, ANCHORS, k, oversample), exact)
    print(k, oversample, share)
    assert share >= (0.9 if oversample == 1 else 0.999)


def test_scores_are_exact_and_pools_hold(spark):
    vectors, codes = C.vectors(spark, "/root/testdata/sf0.01"), V.vector_codes(spark, "/root/testdata/sf0.01")
    pool = spark.createDataFrame([(i,) for i in range(3, 200, 2)], "movie_id long")
    got = V.top_two_stage(codes, vectors, [0, 5], 500, formats=[1, 2], restrict=pool).collect()
    want = similarities(vectors, [0, 5]).where("format IN (1, 2)").join(pool, "movie_id").collect()
    key = lambda r: (r["anchor"], r["space"], r["movie_id"], round(r["score"], 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_empty_and_zero_vectors(spark):
    schema = "movie_id long, space int, vector array<double>, format int, norm double"
    none = spark.createDataFrame([], schema)
    assert V.top_two_stage(V.encoded(none), none, [1], 5).count() == 0
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], 1, 1.0), (2, 0, [0.0, 0.0], 1, 0.0), (3, 0, [0.6, 0.8], 1, 1.0)], schema)
    assert [r["scale"] for r in V.encoded(rows).orderBy("movie_id").collect()][1] == 0.0
    found = {r["movie_id"] for r in V.candidates(V.encoded(rows), V._heads(rows, [1, 2]), 5, [1, 2]).collect()}
    assert found == {3}
    with pytest.raises(ValueError):
        V._heads(rows, list(range(100)))


def test_copies_and_near_ties_are_those_of_the_exact_query(spark):
    """Groups of equal vectors, ranked by id among themselves, and vectors that equal codes cannot tell apart."""
    rng = random.Random(5)
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(30)]
    close = [[x + rng.uniform(-1e-4, 1e-4) for x in base[3]] for _ in range(200)]
    made = [v for v in base for _ in range(40)] + close
    order = list(range(len(made)))
    rng.shuffle(order)
    rows = [(i, 0, made[j], 1, math.sqrt(sum(x * x for x in made[j]))) for i, j in enumerate(order)]
    vectors = spark.createDataFrame(rows, "movie_id long, space int, vector array<double>, format int, norm double").repartition(5)
    key = lambda r: (r["anchor"], r["space"], r["movie_id"], r["rank"])
    got = V.top_two_stage(V.encoded(vectors), vectors, [order.index(3 * 40), 7], 25, 1).collect()
    want = top_per_space(similarities(vectors, [order.index(3 * 40), 7]), 25).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 50
