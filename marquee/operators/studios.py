"""Studios with the years in which their name means something: a registry, joined by company and interval with releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from ..sources.store import stored
from . import endpoints as E

# Worth of a label's strength, and how a gap of years between two items of an era-bound label lowers it.
STRENGTHS = {"high": 1.0, "moderate": 0.65}
ERA_FLOOR, ERA_RANGE, ERA_YEARS = 0.60, 0.40, 18.0


@stored("studio_registry", "part")
def studio_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, company, strength, from_year, to_year, era_bound): what a company stands for, and when; either year may be open.

    A company may have several labels whose years overlap. Labels come from the digits of the test catalogue's brands.
    """
    d = C.table(spark, sf_dir, "part").select(F.col("p_brand").alias("company")).distinct().withColumn("_n", F.regexp_extract("company", "([0-9]+)", 1).cast("int")).where("_n IS NOT NULL")
    n, none = F.col("_n"), F.lit(None).cast("int")
    strength = F.when(n % 3 == 0, "high").otherwise("moderate")
    own = d.where(n % 6 != 5).select(
        F.concat(F.lit("studio "), F.substring(n.cast("string"), 1, 1)).alias("label"), "company", strength.alias("strength"),
        F.when(n % 4 == 1, 1994).when(n % 4 == 3, 1993).otherwise(none).alias("from_year"), F.when(n % 4 == 2, 1995).when(n % 4 == 3, 1996).otherwise(none).alias("to_year"), (n % 2 == 1).alias("era_bound"),
    )
    classics = d.where(n % 5 == 0).select(F.lit("classics").alias("label"), "company", F.lit("high").alias("strength"), F.lit(1992).alias("from_year"), F.lit(1994).alias("to_year"), F.lit(True).alias("era_bound"))
    return own.unionByName(classics)


def within(year: Column, low: Column, high: Column) -> Column:
    """Whether a year lies in [low, high], either of which may be open; an unknown year lies only in what is open at both ends."""
    inside = (low.isNull() | (year >= low)) & (high.isNull() | (year <= high))
    return (low.isNull() & high.isNull()) | F.coalesce(year.isNotNull() & inside, F.lit(False))


def active_entries(items: DataFrame, registry: DataFrame) -> DataFrame:
    """(movie_id, company, year, label, worth, era_bound) of the labels that hold for an item's company in its year. items: (movie_id, company, year)."""
    met = items.select("movie_id", "company", "year").join(registry, "company").where(within(F.col("year"), F.col("from_year"), F.col("to_year")))
    worth = F.when(F.col("strength") == "high", STRENGTHS["high"]).otherwise(STRENGTHS["moderate"])
    return met.select("movie_id", "company", "year", "label", worth.alias("worth"), "era_bound")


@stored("studio_entries", "part", "lineitem", "supplier")
def studio_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.cards(spark, sf_dir).select("movie_id", "company", F.year(F.timestamp_seconds("released")).alias("year"))
    return active_entries(d, studio_registry(spark, sf_dir))


def best_labels(entries: DataFrame) -> DataFrame:
    """(movie_id, label, worth): the worthiest label of each item, of equal ones the first by name."""
    best = F.min_by(F.struct("label", "worth"), F.struct(-F.col("worth"), F.col("label"))).alias("x")
    return entries.groupBy("movie_id").agg(best).select("movie_id", "x.label", "x.worth")


def label_scores(entries: DataFrame, labels: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """1 for items under one of the labels asked for. labels: (label)."""
    found = entries.join(F.broadcast(labels.select("label").distinct()), "label").select("movie_id", F.lit(1.0).alias("score")).distinct()
    return E.restricted(found, restrict)


def studio_lane(anchors: DataFrame, entries: DataFrame) -> DataFrame:
    """(request, movie_id, studio): likeness of an item's studio to an anchor's. anchors: (request, movie_id), one of each request.

    Labels of the same company meet; the lesser worth counts, lowered by the gap of years if either label is era-bound and both years are known.
    """
    own = anchors.join(entries, "movie_id").select("request", "company", F.col("year").alias("_year"), F.col("worth").alias("_worth"), F.col("era_bound").alias("_bound"))
    met = entries.join(own, "company")
    gap = F.abs(F.col("year") - F.col("_year"))
    aged = (F.col("era_bound") | F.col("_bound")) & gap.isNotNull()
    score = F.least("worth", "_worth") * F.when(aged, ERA_FLOOR + ERA_RANGE * F.exp(-gap / ERA_YEARS)).otherwise(1.0)
    return met.groupBy("request", "movie_id").agg(S.clamp(F.max(score)).alias("studio"))


def studio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's active labels with the best one."""
    entries = studio_entries(spark, sf_dir)
    best = best_labels(entries).withColumnRenamed("label", "best").drop("worth")
    return entries.join(best, "movie_id").select("movie_id", "label", "worth", "era_bound", "best")


def studio_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of brands over a pool."""
    labels = spark.createDataFrame([("studio 2",), ("classics",), ("unknown",)], "label string")
    return label_scores(studio_entries(spark, sf_dir), labels, E._pool(spark, sf_dir))


STUDIO_ANCHORS = [(0, 3), (1, 8), (2, 12), (3, 20), (4, 33)]


def sim_studio_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The studio lane of five anchors at once."""
    anchors = spark.createDataFrame(STUDIO_ANCHORS, "request int, movie_id long")
    return studio_lane(anchors, studio_entries(spark, sf_dir)).select("request", "movie_id", C.r6(F.col("studio")).alias("studio"))


ENTRIES = """
registry AS (
  SELECT 'studio ' || (n::VARCHAR)[1] AS label, company, CASE WHEN n % 3 = 0 THEN 1.0::DOUBLE ELSE 0.65 END AS worth,
    CASE n % 4 WHEN 1 THEN 1994 WHEN 3 THEN 1993 END AS low, CASE n % 4 WHEN 2 THEN 1995 WHEN 3 THEN 1996 END AS high, n % 2 = 1 AS era_bound
  FROM (SELECT DISTINCT p_brand AS company, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part) WHERE n % 6 <> 5
  UNION ALL SELECT 'classics', company, 1.0, 1992, 1994, true FROM (SELECT DISTINCT p_brand AS company, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part) WHERE n % 5 = 0),
entries AS (
  SELECT movie_id, company, y AS year, label, worth, era_bound FROM (SELECT *, year(make_timestamp(released * 1000000)) AS y FROM cards) JOIN registry USING (company)
  WHERE (low IS NULL OR y >= low) AND (high IS NULL OR y <= high))"""
QUERIES = {
    "studio_labels": (studio_labels, f"WITH{C.CARDS},{ENTRIES} SELECT movie_id, label, worth, era_bound, first_value(label) OVER (PARTITION BY movie_id ORDER BY worth DESC, label) AS best FROM entries"),
    "studio_brands": (studio_brands, f"WITH{C.CARDS},{ENTRIES}, {E._POOL} SELECT movie_id, CASE WHEN movie_id IN (SELECT movie_id FROM entries WHERE label IN ('studio 2', 'classics')) THEN 1::DOUBLE ELSE 0 END AS score FROM pool"),
    "sim_studio_lane": (
        sim_studio_lane,
        f"""WITH{C.CARDS},{ENTRIES}, anchors(request, movie_id) AS (VALUES {", ".join(map(str, STUDIO_ANCHORS))}),
        own AS (SELECT request, company, year, worth, era_bound FROM anchors JOIN entries USING (movie_id))
        SELECT request, e.movie_id, round(max(least(e.worth, o.worth) * CASE WHEN e.era_bound OR o.era_bound THEN 0.6::DOUBLE + 0.4::DOUBLE * exp(-abs(e.year - o.year) / 18::DOUBLE) ELSE 1 END), 6) AS studio
        FROM entries e JOIN own o USING (company) GROUP BY 1, 2""",
    ),
}
