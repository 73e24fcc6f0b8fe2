"""Functions of the catalogue engine against examples, definitions and brute force."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.operators import funnel, ingest, preferences, semantic, similar, traits
from marquee.plans import search
from marquee.streaming import trending

NORMAL = [
    ("Spider-Man", "spider-man"),
    ("Ocean's Eleven", "oceans eleven"),
    ("Amélie", "amelie"),
    ("Amélie", "amelie"),
    ("L.A. Confidential", "la confidential"),
    ("Straße", "strasse"),
    ("  A: B/C!  ", "a b c"),
    ("Ёлки", "елки"),
    ("İstanbul", "istanbul"),
    ("...", ""),
    ("", ""),
]


@pytest.mark.parametrize(("raw", "want"), NORMAL)
def test_normal_form(raw, want):
    assert T.fold_text(raw) == want


def test_normal_form_in_spark(spark):
    d = spark.createDataFrame([*NORMAL, (None, None)], "raw string, want string")
    got = d.select(T.normalize(F.col("raw")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    ascii_rows = [r for r in NORMAL if r[0].isascii()]
    got = spark.createDataFrame(ascii_rows, "raw string, want string").select(T.normalize_ascii(F.col("raw")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_number_words_and_tokens(spark):
    one = lambda text, column: spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]
    assert one("20th century fox 2000 and 8 and 01 of 21 99th", T.number_words) == "twentieth century fox 2000 and eight and one of twenty-one 99th"
    assert one("spider-man", T.hyphen_variants) == ["spider-man", "spider man", "spiderman"] and one("tom hanks", T.hyphen_variants) == ["tom hanks"] and one("", T.hyphen_variants) == []
    assert one("the spider-man the x - y", T.tokens) == ["the", "spider-man", "spider", "man", "x", "-", "y"]
    assert one("the lord of the rings - x", lambda c: T.name_tokens(c, T.FRANCHISE_STOPLIST)) == ["lord", "rings", "x"]
    assert one("50%_a\\b", T.escape_like) == "50\\%\\_a\\\\b"
    assert T.ordinal_word(21) == "twenty-first" and T.ordinal_word(30) == "thirtieth" and T.ordinal_word(31) is None and T.cardinal_word(100) is None and T.cardinal_word(40) == "forty"


def test_windows_of_preferences():
    low, high, grace = preferences.date_window("between", "2000-01-01", "1999-01-01")
    assert low < high and grace == preferences.LEAST_DATE_GRACE
    assert preferences.date_window("between", "1960-01-01", "2000-01-01")[2] == preferences.MOST_DATE_GRACE
    assert preferences.date_window("after", "2000-01-01")[1:] == (float("inf"), 1095.0) and preferences.date_window("exact", "2000-01-01")[2] == 730.0
    assert preferences.number_window("between", 9, 3) == (3, 9) and preferences.number_window("<", 5) == (-float("inf"), 5)
    assert preferences.rank_window("<", 1) == (1, 0) and preferences.rank_window(">=", 4) == (4, 5)
    assert preferences.offer_keys([2], [1, 3]) == [33, 35]


def test_odd_preferences(spark):
    rows = [(None, None, None, None), ([], [], 999, 50.0), ([1, 7], [33], 5, 95.0)]
    d = spark.createDataFrame(rows, "g array<int>, k array<int>, rank int, r double")
    got = d.select(
        preferences.genres_score(F.col("g"), [1, 2], [7]), preferences.genres_score(F.col("g"), [], [9]), preferences.providers_score(F.col("k"), [33], [33, 34], [33], None), preferences.maturity_score(F.col("rank"), 1, 4), preferences.maturity_score(F.col("rank"), 1, 4, unrated=True), preferences.reception_ramp(F.col("r"))
    ).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0, 1.0, 0.0), (-2.0, 1.0, 0.0, 0.5, 0.0, 1.0)]


def test_space_weights_and_channels():
    plan = semantic.space_weights({1: "large", 2: "none", 3: "none"}, {2})
    assert plan[2][1:] == (False, True) and plan[3][0] == 0 and abs(sum(w for w, *_ in plan.values()) - 1) < 1e-12
    assert abs(plan[0][0] / plan[1][0] - 0.8 * 2 / 3) < 1e-12
    assert semantic.space_weights({1: "none"}, set())[0][0] == 1.0
    w = semantic.channel_weights("large", "none", "medium", True, False)
    assert w == {"vector": 0.75, "lexical": 0.25, "metadata": 0.0}


def test_calibration():
    assert semantic.calibrate(np.array([]))[2] and semantic.calibrate(np.array([-0.1]))[2]
    assert np.allclose(semantic.calibrate(np.linspace(0.8, 0.79, 50))[:2], (0.68, 0.612))
    curve = np.concatenate([np.linspace(0.9, 0.5, 60), np.linspace(0.499, 0.45, 600)])
    elbow, floor, raw = semantic.calibrate(curve)
    assert not raw and 0.45 < elbow < 0.62 and floor == 0.9 * elbow
    assert np.allclose(semantic.ewma(np.array([1.0, 0.0]), 3), [1.0, 0.5])


def test_lane_weights():
    w = similar.lane_weights(["cult"], "cult")
    assert abs(sum(w.values()) - 1) < 1e-12 and w["quality"] / w["shape"] == pytest.approx(0.32 / 0.50)
    assert similar.quality_bucket(45.0, 0.89) == "cult" and similar.quality_bucket(None, 1.0) == "middle" and similar.quality_bucket(85.0, 0.75) == "prestige"


def test_categories_are_whole():
    assert len(traits.CATEGORIES) == 43 and traits.promotion_tier("CENTRAL_TOPIC", "semantic") == 1 and traits.promotion_tier("RUNTIME", "metadata") == traits.NEVER
    assert traits.generates("GENRE", "keyword") and not traits.generates("GENRE", "semantic") and not traits.generates("GENERAL_APPEAL", "metadata")


def test_folds(spark):
    calls = spark.createDataFrame([("A", k, 1, float(s)) for k, s in ((0, 0.5), (1, 0.25))] + [("A", 0, 2, 0.5)], "category string, call int, movie_id int, score double")
    for fold, want in {"SINGLE": (0.5, 0.5), "ADDITIVE": (0.125, 0.0), "ALTERNATIVES": (0.5, 0.5), "CONSENSUS": ((0.5 * 0.25) ** 0.5, (0.5 * 0.1) ** 0.5), "NO_OP": (None, None)}.items():
        got = {r.movie_id: r.score for r in calls.groupBy("movie_id").agg(traits.fold_calls(F.lit(fold), F.lit(2)).alias("score")).collect()}
        assert all((got[i + 1] is None and w is None) or got[i + 1] == pytest.approx(w) for i, w in enumerate(want))


def test_pool_promotes_tiers_until_it_is_large_enough(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "movie_id long")
    pool, promoted = traits.pool_of([ids(1, 2, 3)], ids(3), [(2, ids(4, 5)), (1, ids(6)), (5, ids(7))], least=4)
    assert promoted == [1, 2] and {r.movie_id for r in pool.collect()} == {1, 2, 4, 5, 6}
    pool, promoted = traits.pool_of([], ids(9), [], seed=ids(8, 9))
    assert promoted == [] and {r.movie_id for r in pool.collect()} == {8}


def test_votes_by_age(spark):
    today = datetime.date(2024, 1, 1)
    rows = [(100, d) for d in ("2023-10-01", "2022-07-01", "2010-01-01", "1984-01-01", "1900-01-01", None)]
    got = spark.createDataFrame(rows, "v long, d string").select(funnel.vote_score(F.col("v"), F.to_date("d"), F.lit(today), "detail")).collect()
    base = np.log10(101) / np.log10(2001)
    for (x,), (_, d) in zip(got, rows, strict=True):
        years = (today - datetime.date.fromisoformat(d)).days / 365 if d else None
        boost = 1 if years is None else max(1, min(2, 2 / max(years, 0.5)), min(1.5, 1 + max(0, years - 20) / 30))
        assert x == pytest.approx(min(1, base * boost))


def test_packed_keys(spark):
    rows = [([],), ([1, 16, 4294967295],), (None,)]
    d = spark.createDataFrame(rows, "k array<long>")
    got = d.select(funnel.unpack_keys(funnel.pack_keys(F.col("k")))).collect()
    assert [r[0] for r in got] == [[], [1, 16, 4294967295], []]
    assert spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00\xff"),)], "b binary").select(funnel.unpack_keys(F.col("b"))).first()[0] == [1]
    with pytest.raises(ValueError, match="add up"):
        funnel.checked_weights({"a": 0.5})


def test_modal_votes_and_majority(spark):
    from marquee.operators import derived

    for votes in itertools.product("ab", repeat=3):
        got = derived.majority(spark.createDataFrame([(1, i, t) for i, t in enumerate(votes)], "movie_id int, run int, tag string"), 3).collect() if votes in {("a", "a", "b"), ("b", "b", "b")} else None
        assert got is None or [r.tag for r in got] == [max("ab", key=votes.count)]
    tied = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (2, 0, "x"), (2, 1, "y"), (2, 2, "y")], "movie_id int, run int, tag string")
    assert {r.movie_id: r.tag for r in derived.modal_vote(tied).collect()} == {1: "x", 2: "y"}


def test_exact_title_keeps_the_best_source(spark):
    cards = spark.createDataFrame(
        [(1, "Star Song", 0, [1], [9]), (2, "Star Song", 400_000_000, [], []), (3, "Star Song: Anniversary", 0, [], []), (4, "Other", 0, [1], []), (5, "Third", 0, [], [1]), (6, "Fourth", 0, [9], []), (7, "Fifth", 0, [], [9]), (8, "None", 0, [], [])],
        "movie_id long, title string, released long, lineage_ids array<int>, universe_ids array<int>",
    ).withColumn("normal", T.normalize(F.col("title")))
    got = {r.movie_id: round(r.score, 4) for r in search.exact_title(cards, "star song", 1970).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.9, 4: 0.75, 5: 0.625, 6: 0.125, 7: 0.25}
    assert search.exact_title(cards, "no such", None).count() == 0


def test_fingerprint_ignores_order(spark):
    one = lambda f: spark.range(1).select(search.filters_fingerprint(f)).first()[0]
    assert one({"genres": [2, 1], "keywords": [3]}) == one({"keywords": [3], "genres": [1, 2], "offers": []}) and one({"genres": []}) is None and one({"keywords": [4], "genres": [1, 2]}) != one({"keywords": [3], "genres": [1, 2]})


def test_windowed_counts_as_a_stream(spark, tmp_path):
    """A real streaming run over files: the same counts as the batch plan for windows behind the watermark."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i, part in enumerate(events.orderBy("ts").randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"day{i}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = trending.windowed_counts(stream, late="400 days").writeStream.format("memory").queryName("trend").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = spark.table("trend").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = trending.windowed_counts(events)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def keywords_by_hand(edges):
    """The rule of filtered_keywords in plain Python."""
    scored = [(n.strip(), (i or 0) - 0.75 * ((v or 0) - (i or 0))) for n, i, v in edges or [] if n and n.strip()]
    if not scored:
        return []
    best = max(s for _, s in scored)
    if best <= 0:
        return [n for n, _ in scored[:10]]
    top = {}
    for n, s in scored:
        top[n] = max(s, top.get(n, s))
    passing = list(dict.fromkeys(n for n, s in scored if s >= min(0.75 * best, best - 2)))
    if len(passing) < 10:
        for n in sorted((n for n in dict.fromkeys(n for n, _ in scored) if n not in passing), key=lambda n: -top[n]):
            if len(passing) < 10:
                passing.append(n)
    return sorted(passing, key=lambda n: -top[n])[:15] if len(passing) > 15 else passing


def test_keywords_by_votes(spark):
    rng = np.random.default_rng(8)
    rows = [[(f"k{j}", int(rng.integers(0, 30)), int(rng.integers(0, 40))) for j in range(n)] for n in (0, 1, 5, 9, 10, 14, 22, 40)]
    rows += [[(f"k{j}", 0, 3) for j in range(12)], [("same", 20, 20), ("same", 2, 2), (" ", 9, 9), (None, 9, 9), ("x", None, None)], [(f"k{j}", 20, 20) for j in range(30)], None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, k array<struct<name:string,interested:int,voted:int>>")
    got = {r.i: r.x for r in d.select("i", ingest.filtered_keywords(F.col("k")).alias("x")).collect()}
    assert got == {i: keywords_by_hand(r) for i, r in enumerate(rows)}


def test_money_and_eras(spark):
    rows = [(None, 5.0), (1900, 50_000.0), (1985, 7_000_000.0), (1985, 6_999_999.0), (2050, 185_000_001.0)]
    got = spark.createDataFrame(rows, "y int, b double").select(ingest.budget_bucket(F.col("y"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, "small", None, "small", "large"]
    got = spark.createDataFrame([(8.0, 90), (None, 90), (8.0, 0), (None, None)], "r double, c int").select(ingest.reception_score(F.col("r"), F.col("c"))).collect()
    assert [r[0] for r in got] == [86.0, 90.0, 80.0, None]
