"""A trait request is scored in one pass over one row an item."""

import pytest

from marquee.operators import traits as R
from marquee.sources import store

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


def test_negative_trait_makes_no_view_but_the_cards(spark, tmp_path):
    folder = str(tmp_path / "tables")
    (tmp_path / "tables").symlink_to(SF)
    R.trait_negative(spark, folder)
    assert set(store.published(spark, folder)) == {"item_lines", "cards"}


def test_flow_is_one_pass_over_one_row_an_item(spark, joins_by_hint):
    assert "hashpartitioning" not in plan(R.flow_trait_search(spark, SF))
    items = R.scored_items(spark, SF)
    assert items.count() == items.select("movie_id").distinct().count()


def test_columns_fold_as_rows_do(spark):
    """Every combination of missing and present scores of two calls, by each fold and mode, against the operators on long tables."""
    some = [None, 0.0, 0.05, 0.4, 1.0]
    wide = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in some for y in some)]
    items = spark.createDataFrame(wide, "movie_id int, a double, b double")
    a, b = items["a"], items["b"]
    long = spark.createDataFrame([(0, "C", k, i, s) for i, *both in wide for k, s in enumerate(both) if s is not None], "trait int, category string, call int, movie_id int, score double")
    for fold in ("SINGLE", "ADDITIVE", "ALTERNATIVES", "CONSENSUS"):
        specs = spark.createDataFrame([(0, "C", 0, fold, 2)], "trait int, category string, place int, fold string, asked int")
        want = {r["movie_id"]: r["score"] for r in R.category_scores(long, specs).collect()}
        got = {r["movie_id"]: r["s"] for r in items.select("movie_id", R.fold_scores(fold, [a, b]).alias("s")).collect()}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    for mode in ("SOLO", "FRAMINGS", "FACETS"):
        modes = spark.createDataFrame([(0, mode, 2)], "trait int, mode string, surviving int")
        want = {r["movie_id"]: r["score"] for r in R.trait_scores(long.withColumnRenamed("call", "place"), modes).collect()}
        got = {r["movie_id"]: r["s"] for r in items.select("movie_id", R.mode_scores(mode, [a, b]).alias("s")).collect()}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    for gates, fuzzies in (([a], [b]), ([a, b], []), ([], [a, b])):
        specs = spark.createDataFrame([(0, len(gates), len(fuzzies))], "trait int, gates int, fuzzies int")
        want = {r["movie_id"]: r["score"] for r in R.negative_scores(long.withColumn("gate", long["call"] < len(gates)), specs).collect()}
        got = {r["movie_id"]: r["s"] for r in items.select("movie_id", R.negative_score(gates, fuzzies).alias("s")).collect()}
        assert {k: v for k, v in got.items() if k in want} == pytest.approx(want) and not any(v for k, v in got.items() if k not in want)
