"""Views of items come from one dealing of the lines: no further shuffle, and the rows that the tables' own definition gives."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import awards as A
from marquee.sources import catalogue as C

FROM = "/root/testdata/sf0.001"
ODD = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, day string"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """The small tables with lines that repeat or lack values."""
    folder = str(tmp_path_factory.mktemp("lines"))
    for name in ("part", "supplier"):
        spark.read.parquet(f"{FROM}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    odd = [(1, 5, 3, 2, 50.0, 0.1, "A", "1995-01-01"), (1, 5, 3, 1, 50.0, None, "A", "1995-01-01"), (1, 5, None, 1, 9.0, 0.0, None, "1994-05-05"), (1, 5, 3, 2, 50.0, 0.1, "A", "1995-01-01"), (2, 999_999, 2, 1, 1.0, 0.0, "N", "1993-01-01"), (2, 6, 77_777, None, 1.0, None, "R", None)]
    lines = spark.read.parquet(f"{FROM}/lineitem.parquet")
    made = spark.createDataFrame(odd, ODD).withColumn("l_shipdate", F.to_timestamp("day").cast(lines.schema["l_shipdate"].dataType)).drop("day")
    lines.unionByName(made, allowMissingColumns=True).repartition(6).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def same(got, want):
    key = lambda d: sorted(map(str, d.select(*want.columns).collect()))
    assert key(got) == key(want) and want.count()


def test_views_are_the_distinct_rows_of_the_lines(spark, base):
    lines = C.table(spark, base, "lineitem")
    won = F.col("l_returnflag") == "A"
    item, ceremony, year = F.col("l_partkey").alias("movie_id"), (F.col("l_suppkey") % 12 + 1).alias("ceremony"), F.year("l_shipdate").alias("year")
    same(C.awards(spark, base), lines.select(item, ceremony, won.alias("won"), year).distinct())
    place = lines.groupBy(F.col("l_suppkey").alias("term"), item).agg(F.min("l_linenumber").alias("position"))
    same(C.person_postings(spark, base), place.join(lines.groupBy(item).agg(F.max("l_linenumber").alias("cast_size")), "movie_id").select("term", "movie_id", "position", "cast_size"))
    others = lines.where("l_linenumber BETWEEN 1 AND 4").select(F.element_at(F.array(*map(F.lit, C.ROLES[1:])), F.col("l_linenumber")).alias("role"), F.col("l_suppkey").alias("term"), item).distinct()
    same(C.credits(spark, base).where("role <> 'actor'"), others)
    rows = lines.select(item, F.col("l_suppkey").alias("entry_id"), (won & (F.col("l_quantity") > 45)).alias("won"), year, "l_linenumber").distinct()
    assert A.award_rows(spark, base).select("movie_id", "entry_id", "won", "year").distinct().count() == rows.drop("l_linenumber").distinct().count()
    same(A.award_tags(spark, base), A.award_rows(spark, base).select("movie_id", F.explode("tags").alias("tag")).distinct())
    facts = lines.groupBy(item).agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_set("l_suppkey")).alias("keyword_ids"), F.sort_array(F.collect_set("l_linenumber")).alias("genre_ids"), F.round(100 - 10 * F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1)), 4).alias("reception"))
    known = C.table(spark, base, "part").select(F.col("p_partkey").alias("movie_id"))
    same(C.cards(spark, base), facts.join(known, "movie_id"))


def test_no_view_shuffles_the_lines_again(spark, base):
    C.item_lines(spark, base)
    for view in (C.awards, C.person_postings, C.credits, A.award_rows, A.award_tags):
        view(spark, base)
        plan = view.build(spark, base)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "lineitem" not in plan, plan
    # Lines cross the network as rows, not as arrays collected by task.
    plan = C.item_lines.build(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(movie_id") == 1 and "REPARTITION_BY_COL" in plan


def test_parts_meet_the_lines_where_these_are_dealt(spark, base):
    """The cards hold no table of all parts in a task: what is broadcast to them is one row a number of votes."""
    C.cards(spark, base)
    plan = C.cards.build(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and plan.count("HashedRelationBroadcastMode") <= 1, plan
    assert "ShuffledHashJoin" in C.item_lines.build(spark, base)._jdf.queryExecution().executedPlan().toString()


def test_repeated_parts_give_a_card_each(spark, base, tmp_path):
    for name in ("supplier", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{base}/{name}.parquet")
    part = spark.read.parquet(f"{FROM}/part.parquet")
    part.unionByName(part.where("p_partkey = 5").withColumn("p_name", F.lit("again"))).write.parquet(f"{tmp_path}/part.parquet")
    titles = C.cards(spark, str(tmp_path)).where("movie_id = 5").select("title").collect()
    assert len(titles) == 2 and ("again",) in titles
    assert C.item_lines(spark, str(tmp_path)).where("movie_id = 5").count() == 1
    same(C.awards(spark, str(tmp_path)), C.awards(spark, base))


def test_many_lines_of_one_item(spark, tmp_path):
    """Distinct rows are found by sorting an item's lines: comparing each with each would be a thousand million comparisons here."""
    n = 40_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("movie_id"), F.struct(F.col("id").alias("term"), (F.col("id") % 4 + 1).cast("int").alias("line")).alias("x"))
    items = lines.groupBy("movie_id").agg(F.collect_list("x").alias("lines"))
    made = C.rows_of_lines(items, F.transform("lines", lambda x: F.struct((x["term"] % (n // 2)).alias("term"), x["line"].alias("line"))))
    assert made.count() == n // 2 == made.distinct().count()
