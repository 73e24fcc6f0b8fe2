"""Award searches: the fast path finds what counting rows finds; tags roll up; ceremonies, names and years as stated."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import awards as A
from marquee.sources import catalogue as C

SF = "/root/testdata/sf0.01"


def test_both_paths_agree(spark):
    one = spark.createDataFrame([(0, [], [], [], "won", None, None, False, 1)], A.SEARCH)
    assert [r[0] for r in one.select(A.is_fast()).collect()] == [True]
    rows, cards = A.award_rows(spark, SF), C.cards(spark, SF)
    known = cards.select("movie_id")
    fast = {tuple(r) for r in A.fast_scores(one, cards).collect()}
    counted = {tuple(r) for r in A.counted_scores(one, rows.join(known, "movie_id", "left_semi"), A.award_entries(spark, SF)).collect()}
    assert fast == counted and len(fast) > 50


@pytest.mark.parametrize("changed", [{"ceremonies": [1]}, {"names": ["x"]}, {"tags": [1]}, {"outcome": "any"}, {"outcome": "nominated"}, {"year_from": 1990}, {"year_to": 1990}, {"threshold": True}, {"mark": 2}])
def test_any_filter_counts_rows(spark, changed):
    row = dict(zip([c.split()[0] for c in A.SEARCH.split(", ")], (0, [], [], [], "won", None, None, False, 1), strict=True)) | changed
    assert not spark.createDataFrame([tuple(row.values())], A.SEARCH).select(A.is_fast()).first()[0]


def test_searches_equal_brute_force(spark):
    rows = [(i % 9, (i * 7) % 12 + 1, i % 5, (i % 12) + 1, i % 3 == 0, 1990 + i % 7) for i in range(160)] + [(3, 10, 2, 61, True, 1994), (4, 10, 2, 60, False, 1996)]
    d = spark.createDataFrame(rows, "movie_id long, ceremony int, entry_id long, leaf int, won boolean, year int").distinct().withColumn("tags", A.tags_of(F.col("leaf")))
    held = [r.asDict() for r in d.collect()]
    names = {0: "Golden Bear", 1: "Silver Bear", 2: "Bear of the 2nd Day", 3: "Palm", 4: "Best Film Palm"}
    entries = spark.createDataFrame(list(names.items()), "entry_id long, name string").withColumn("tokens", A.T.name_tokens(A.T.number_words(A.T.normalize(F.col("name")))))
    searches = [
        (0, [], [], [], "any", None, None, False, 2),
        (1, [1, 8, 10], [], [], "won", None, None, True, 3),
        (2, [], [], [100, 10_002], "any", 1991, 1994, False, 1),
        (3, [], ["bear 2nd", "PALM"], [], "nominated", None, None, True, 2),
        (4, [], ["unknown"], [], "any", None, None, False, 1),
        (5, [], [], [A.RAZZIE_GROUP, 3], "any", None, None, True, 1),
        (6, [], ["best film of the"], [], "any", None, None, False, 1),
    ]
    of = {3: {2, 3, 4}, 4: set(), 6: set()}
    want = set()
    for s, ceremonies, asked, tags, outcome, low, high, threshold, mark in searches:
        opened = any(t in (60, 61, 62, 150, 10_005) for t in tags)
        n = {}
        for r in held:
            if (r["ceremony"] not in ceremonies) if ceremonies else (r["ceremony"] == 10 and not opened):
                continue
            if asked and r["entry_id"] not in of[s] or tags and not set(tags) & set(r["tags"]) or outcome != "any" and r["won"] != (outcome == "won"):
                continue
            if (low and r["year"] < low) or (high and r["year"] > high):
                continue
            n[r["movie_id"]] = n.get(r["movie_id"], 0) + 1
        for movie, k in n.items():
            score = min(k, mark) / mark if threshold else float(k >= mark)
            if score:
                want.add((s, movie, round(score, 9)))
    got = A.counted_scores(spark.createDataFrame(searches, A.SEARCH), d, entries)
    assert {(r.search, r.movie_id, round(r.score, 9)) for r in got.collect()} == want and {w[0] for w in want} == {0, 1, 2, 3, 5}


def test_tags_of_a_leaf_and_cohesion_by_level(spark):
    leaves = spark.createDataFrame([(1,), (4,), (12,), (61,)], "leaf int").select(A.tags_of(F.col("leaf"))).collect()
    assert [r[0] for r in leaves] == [[1, 100, 10_000], [4, 101, 10_000], [12, 105, 10_002], [61, 150, 10_005]]
    tags = spark.createDataFrame([(1, 5), (1, 102), (2, 6), (2, 102), (3, 7), (3, 103), (1, 10_001), (2, 10_001), (3, 10_001)], "movie_id long, tag int")
    anchors = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "request int, movie_id long")
    repeated = A.repeated_tags(anchors, tags)
    assert {(r.tag, r.m) for r in repeated.collect()} == {(102, 2), (10_001, 3)}
    import math

    got = A.award_cohesion(repeated, spark.createDataFrame([(0, 3)], "request int, n long")).first().cohesion
    assert got == pytest.approx(0.6 * 2 * math.log1p(9 * 2 / 3) / math.log(10))
    lane = A.award_lane(spark.createDataFrame([(0, 7), (0, 8)], "request int, movie_id long"), repeated, spark.createDataFrame([(7, 10_001), (8, 102), (8, 10_001)], "movie_id long, tag int"))
    assert {r.movie_id: round(r.specific_award, 9) for r in lane.collect()} == {7: round(0.2 / 0.7, 9), 8: 1.0}
