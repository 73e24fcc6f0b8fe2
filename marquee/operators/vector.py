"""Exact multi-space vector retrieval and its score algebra. Anchors are a stated, bounded set that is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C

#: Most anchors one query may name; their vectors are broadcast.
MAX_ANCHORS = 64


def similarities(vectors: DataFrame, anchors: list[int]) -> DataFrame:
    """(anchor, space, movie_id, score): cosine of every item with each anchor, space by space."""
    if len(anchors) > MAX_ANCHORS:
        raise ValueError(f"at most {MAX_ANCHORS} anchors")
    v = vectors
    heads = v.where(F.col("movie_id").isin(anchors)).select(F.col("movie_id").alias("anchor"), "space", F.col("vector").alias("head"), F.col("norm").alias("head_norm"))
    pairs = v.where(~F.col("movie_id").isin(anchors)).join(F.broadcast(heads), "space")
    return pairs.select("anchor", "space", "movie_id", "format", (S.dot(F.col("vector"), F.col("head")) / (F.col("norm") * F.col("head_norm"))).alias("score"))


def top_per_space(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "space").orderBy(F.desc("score"), "movie_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def decayed(top: DataFrame) -> DataFrame:
    """exp(-3 (max - s) / (max - min)) within each anchor and space; a flat space scores 1."""
    w = Window.partitionBy("anchor", "space")
    high, low = F.max("score").over(w), F.min("score").over(w)
    return top.withColumn("decayed", F.when(high == low, 1.0).otherwise(F.exp(-3 * (high - F.col("score")) / (high - low))))


def vec_top_per_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_space(similarities(C.vectors(spark, sf_dir), [0, 1]), 20).select("anchor", "space", "movie_id", C.r6(F.col("score")).alias("score"))


def vec_blend_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: mean decayed score over all anchors and spaces (missing spaces count 0)."""
    rows = decayed(top_per_space(similarities(C.vectors(spark, sf_dir), [0, 1]), 50))
    return rows.groupBy("movie_id").agg(C.r6(F.sum("decayed") / (2 * C.SPACES)).alias("score"), F.count(F.lit(1)).alias("hits"))


def vec_pool_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max within each space; from .85 up 1, a spread under .01 gives all 1."""
    rows = similarities(C.vectors(spark, sf_dir), [3])
    ends = rows.groupBy("space").agg(F.min("score").alias("low"), (F.max("score") - F.min("score")).alias("spread"))
    spread = F.col("spread")
    scaled = (F.col("score") - F.col("low")) / spread
    return rows.join(F.broadcast(ends), "space").select("space", "movie_id", C.r6(F.when(spread < 0.01, 1.0).when(scaled >= 0.85, 1.0).otherwise(scaled)).alias("score"))


def vec_shape_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per space: mean pairwise cosine of three anchors and its weight clamp((c - .55) / .30, .10, 1)."""
    v = C.vectors(spark, sf_dir).where(F.col("movie_id").isin(0, 1, 2))
    a, b = v.select(F.col("movie_id").alias("a"), "space", F.col("vector").alias("va"), F.col("norm").alias("na")), v.select(F.col("movie_id").alias("b"), "space", F.col("vector").alias("vb"), F.col("norm").alias("nb"))
    c = a.join(b, "space").where("a < b").groupBy("space").agg(F.avg(S.dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))).alias("cohesion"))
    return c.select("space", C.r6(F.col("cohesion")).alias("cohesion"), C.r6(S.clamp((F.col("cohesion") - 0.55) / 0.30, 0.10, 1.0)).alias("weight"))


_N = "list_cosine_similarity(v.vector, h.vector)"


def _scored(anchors: str) -> str:
    return "WITH" + C.VECTORS + f", scored AS (SELECT h.movie_id AS anchor, v.space, v.movie_id, v.format, {_N} AS score FROM vectors v JOIN vectors h ON v.space = h.space WHERE h.movie_id IN ({anchors}) AND v.movie_id NOT IN ({anchors}))"


def _decayed(k: int) -> str:
    return f""", top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY anchor, space ORDER BY score DESC, movie_id) <= {k}),
b AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM top WINDOW w AS (PARTITION BY anchor, space)),
dec AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE exp(-3 * (hi - score) / (hi - lo)) END AS decayed FROM b)"""


QUERIES = {
    "vec_top_per_space": (vec_top_per_space, _scored("0, 1") + " SELECT anchor, space, movie_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY anchor, space ORDER BY score DESC, movie_id) <= 20"),
    "vec_blend_decay": (vec_blend_decay, _scored("0, 1") + _decayed(50) + " SELECT movie_id, round(sum(decayed) / 16, 6) AS score, count(*) AS hits FROM dec GROUP BY 1"),
    "vec_pool_rescale": (vec_pool_rescale, _scored("3") + ", s AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w - min(score) OVER w AS spread FROM scored WINDOW w AS (PARTITION BY space)) SELECT space, movie_id, round(CASE WHEN spread < 0.01 OR (score - lo) / spread >= 0.85 THEN 1.0 ELSE (score - lo) / spread END, 6) AS score FROM s"),
    "vec_shape_cohesion": (vec_shape_cohesion, "WITH" + C.VECTORS + ", c AS (SELECT v.space, avg(list_cosine_similarity(v.vector, h.vector)) AS c FROM vectors v JOIN vectors h ON v.space = h.space AND v.movie_id < h.movie_id WHERE v.movie_id IN (0, 1, 2) AND h.movie_id IN (0, 1, 2) GROUP BY 1) SELECT space, round(c, 6) AS cohesion, round(least(greatest((c - 0.55) / 0.30, 0.10), 1), 6) AS weight FROM c"),
}
