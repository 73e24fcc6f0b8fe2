"""Metadata scorers, billing zones, folds, trait weights, ordinal and funnel scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from .retrieval import RELEASED

GRACE = S.date_grace(*RELEASED)


def meta_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release, runtime, maturity, popularity and reception scores of every card."""
    d = C.cards(spark, sf_dir)
    p, r = F.col("popularity"), F.col("reception")
    return d.select(
        "movie_id",
        C.r6(S.linear_grace(F.col("released"), *RELEASED, GRACE)).alias("release"),
        C.r6(S.linear_grace(F.col("runtime"), 10, 20, 30)).alias("runtime_score"),
        S.maturity(F.col("maturity_rank"), 2, 3).alias("maturity"),
        C.r6(S.popularity_mode(p)).alias("popular"),
        C.r6(S.popularity_mode(p, niche=True)).alias("niche"),
        C.r6(S.reception_mode(r)).alias("well"),
        C.r6(S.reception_mode(r, poor=True)).alias("poorly"),
    )


def meta_country_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference decay and gate by the place of the first wanted id in an ordered list."""
    ids = F.col("country_ids")
    return C.cards(spark, sf_dir).select("movie_id", C.r6(S.position_preference(ids, [1, 2, 3])).alias("preference"), S.position_gate(ids, [1, 2, 3]).alias("gate"))


def actor_zone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing zone, place within it and the character curves of every posting."""
    d = C.person_postings(spark, sf_dir)
    lead, support = S.zone_cutoffs(F.col("cast_size"))
    d = d.withColumn("lead", lead).withColumn("support", support)
    p = F.col("position")
    zone = F.when(p <= F.col("lead"), "lead").when(p <= F.col("support"), "supporting").otherwise("minor")
    start = F.when(p <= F.col("lead"), 1).when(p <= F.col("support"), F.col("lead") + 1).otherwise(F.col("support") + 1)
    end = F.when(p <= F.col("lead"), F.col("lead")).when(p <= F.col("support"), F.col("support")).otherwise(F.col("cast_size"))
    place = F.when(end - start <= 0, 0.0).otherwise((p - start) / (end - start))
    return d.select("term", "movie_id", "position", "cast_size", zone.alias("zone"), C.r6(place).alias("place"), C.r6(S.character_default(p, F.col("cast_size"))).alias("character"), C.r6(S.character_central(p)).alias("central"))


def fuse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive (product), alternatives (max), consensus and facets (geometric means with floor 0.1) of three call scores."""
    m = meta_scores(spark, sf_dir)
    calls = F.array("release", "well", "popular")
    return m.select("movie_id", C.r6(S.product(calls)).alias("additive"), F.array_max(calls).alias("alternatives"), C.r6(S.geometric(calls)).alias("consensus"))


def neg_gate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion strength: product of authoritative gates times the noisy-or of fuzzy scores."""
    m = meta_scores(spark, sf_dir)
    gate = F.when(F.col("maturity") > 0, 1.0).otherwise(0.0)
    return m.select("movie_id", C.r6(gate * (1 - (1 - F.col("niche")) * (1 - F.col("poorly")))).alias("negative"))


def trait_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitment (3.0 required) times rarity of each keyword trait."""
    cards = C.cards(spark, sf_dir)
    total = cards.agg(F.count(F.lit(1)).alias("total"))
    counted = cards.select(F.explode("keyword_ids").alias("trait_id")).groupBy("trait_id").agg(F.count(F.lit(1)).alias("matches"))
    return counted.crossJoin(F.broadcast(total)).select("trait_id", "matches", (3.0 * S.rarity(F.col("matches") / F.col("total"))).alias("weight"))


def implicit_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score raised by 0.12 times the popularity signal."""
    m = meta_scores(spark, sf_dir)
    return m.select("movie_id", C.r6(F.col("release") + F.when(F.col("release") > 0, F.col("release")).otherwise(1.0) * 0.12 * F.col("popular")).alias("score"))


def win_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rank of release over distinct dates, scaled to 0..1; distinct dates are ranked, not rows."""
    cards = C.cards(spark, sf_dir)
    dates = cards.select("released").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("released")))
    last = dates.agg(F.max("rank").alias("last"))
    ranked = cards.join(dates, "released").crossJoin(F.broadcast(last))
    return ranked.select("movie_id", C.r6(F.when(F.col("last") == 1, 1.0).otherwise((F.col("rank") - 1) / (F.col("last") - 1))).alias("score"))


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trend(spark, sf_dir).withColumn("score", C.r6(F.col("score")))


def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cult (reception <= 45, high percentile), prestige (>= 85, .75), else middle; and the reception tier label."""
    d = C.cards(spark, sf_dir)
    r = F.col("reception")
    bucket = F.when((r <= 45) & (F.col("pct") >= 0.89), "cult").when((r >= 85) & (F.col("pct") >= 0.75), "prestige").otherwise("middle")
    tier = F.when(r >= 81, 5).when(r >= 61, 4).when(r >= 41, 3).when(r >= 21, 2).otherwise(1)
    return d.select("movie_id", bucket.alias("bucket"), tier.alias("tier"), C.r6(F.col("pct")).alias("pct"))


_ = "WITH" + C.CARDS + "," + C.POPULAR
_G = f"coalesce(greatest(1 - greatest({RELEASED[0]} - released, released - {RELEASED[1]}, 0)::DOUBLE / {GRACE}, 0), 0)"
_M = f""", m AS (SELECT movie_id, round({_G}, 6) AS release,
  round(greatest(1 - greatest(10 - runtime, runtime - 20, 0)::DOUBLE / 30, 0), 6) AS runtime_score,
  CASE WHEN maturity_rank BETWEEN 2 AND 3 THEN 1.0::DOUBLE WHEN least(abs(maturity_rank - 2), abs(maturity_rank - 3)) = 1 THEN 0.5 ELSE 0 END AS maturity,
  round(1 / (1 + exp(-12 * (popularity - 0.70))), 6) AS popular, round(1 / (1 + exp(12 * (popularity - 0.40))), 6) AS niche,
  round(1 / (1 + exp(-0.22 * (reception - 70))), 6) AS well, round(1 / (1 + exp(0.22 * (reception - 50))), 6) AS poorly FROM popular)"""
_Z = (
    "WITH"
    + C.POSTINGS
    + """, z AS (SELECT *, least(cast_size, greatest(2, CAST(round_even(0.6::DOUBLE * sqrt(cast_size), 0) AS INT))) AS lead FROM postings),
y AS (SELECT *, least(cast_size, greatest(lead + 1, CAST(round_even(sqrt(cast_size), 0) AS INT))) AS support FROM z),
x AS (SELECT *, CASE WHEN position <= lead THEN 'lead' WHEN position <= support THEN 'supporting' ELSE 'minor' END AS zone,
  CASE WHEN position <= lead THEN 1 WHEN position <= support THEN lead + 1 ELSE support + 1 END AS s,
  CASE WHEN position <= lead THEN lead WHEN position <= support THEN support ELSE cast_size END AS e FROM y)
SELECT term, movie_id, position, cast_size, zone, round(CASE WHEN e - s <= 0 THEN 0.0::DOUBLE ELSE (position - s)::DOUBLE / (e - s) END, 6) AS place,
  round(1 - (position - 1)::DOUBLE / greatest(1, cast_size - 1), 6) AS character, round(greatest(0, 1 - 0.15::DOUBLE * greatest(0, position - 2)), 6) AS central FROM x"""
)
_P = "list_min(list_filter([CASE WHEN x IN (1, 2, 3) THEN list_position(country_ids, x) END FOR x IN country_ids], lambda p: p IS NOT NULL))"
QUERIES = {
    "meta_scores": (meta_scores, _ + _M + " SELECT * FROM m"),
    "meta_country_position": (meta_country_position, _ + f", p AS (SELECT movie_id, {_P} AS place FROM cards) SELECT movie_id, round(coalesce(exp((1 - place) / 1.3::DOUBLE), 0), 6) AS preference, CASE WHEN place = 1 THEN 1.0::DOUBLE WHEN place = 2 THEN 0.33 ELSE 0 END AS gate FROM p"),
    "actor_zone_scores": (actor_zone_scores, _Z),
    "fuse_calls": (fuse_calls, _ + _M + " SELECT movie_id, round(release * well * popular, 6) AS additive, greatest(release, well, popular) AS alternatives, round(exp((ln(greatest(release, 0.1)) + ln(greatest(well, 0.1)) + ln(greatest(popular, 0.1))) / 3), 6) AS consensus FROM m"),
    "neg_gate_fuzzy": (neg_gate_fuzzy, _ + _M + " SELECT movie_id, round(CASE WHEN maturity > 0 THEN 1 - (1 - niche) * (1 - poorly) ELSE 0 END, 6) AS negative FROM m"),
    "trait_weights": (trait_weights, _ + ", t AS (SELECT unnest(keyword_ids) AS trait_id, count(*) AS matches FROM cards GROUP BY 1), f AS (SELECT *, matches::DOUBLE / (SELECT count(*) FROM cards) AS x FROM t) SELECT trait_id, matches, 3.0::DOUBLE * CASE WHEN x < 0.001 THEN 1.5 WHEN x < 0.01 THEN 1.2 WHEN x < 0.1 THEN 1.0 WHEN x < 0.3 THEN 0.75 ELSE 0.5 END AS weight FROM f"),
    "implicit_prior": (implicit_prior, _ + _M + " SELECT movie_id, round(release + CASE WHEN release > 0 THEN release ELSE 1 END * 0.12::DOUBLE * popular, 6) AS score FROM m"),
    "win_chronological": (win_chronological, _ + ", d AS (SELECT movie_id, dense_rank() OVER (ORDER BY released) AS r FROM cards) SELECT movie_id, round(CASE WHEN (SELECT max(r) FROM d) = 1 THEN 1.0::DOUBLE ELSE (r - 1)::DOUBLE / ((SELECT max(r) FROM d) - 1) END, 6) AS score FROM d"),
    "trending": (trending, "WITH c AS (SELECT user_id AS movie_id, count(*) AS events FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY events DESC, movie_id) - 1 AS rank, count(*) OVER () AS n FROM c) SELECT movie_id, events, rank, round(1 - sqrt(rank::DOUBLE / n), 6) AS score FROM r"),
    "quality_buckets": (quality_buckets, _ + ", p AS (SELECT *, percent_rank() OVER (ORDER BY votes) AS pct FROM cards) SELECT movie_id, CASE WHEN reception <= 45 AND pct >= 0.89 THEN 'cult' WHEN reception >= 85 AND pct >= 0.75 THEN 'prestige' ELSE 'middle' END AS bucket, CASE WHEN reception >= 81 THEN 5 WHEN reception >= 61 THEN 4 WHEN reception >= 41 THEN 3 WHEN reception >= 21 THEN 2 ELSE 1 END AS tier, round(pct, 6) AS pct FROM p"),
}
