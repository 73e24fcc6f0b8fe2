"""End-to-end flows: browse and attribute search, title search, neutral seeds, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.retrieval import RELEASED, hard_filter
from ..sources import catalogue as C


def neutral_prior(d: DataFrame) -> DataFrame:
    return d.withColumn("prior", C.r6(0.8 * S.clamp(F.col("popularity")) + 0.2 * S.clamp(F.col("reception") / 100)))


def topk_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.cards(spark, sf_dir).select("movie_id", C.r6(F.col("popularity")).alias("popularity"))
    return d.orderBy(F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(100)


def topk_quality_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.cards(spark, sf_dir).select("movie_id", C.r6(F.coalesce("popularity", F.lit(0.0)) * F.coalesce("reception", F.lit(0.0))).alias("product"))
    return d.orderBy(F.desc("product"), F.desc("movie_id")).limit(100)


def topk_neutral_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = neutral_prior(C.cards(spark, sf_dir)).select("movie_id", "prior")
    return d.orderBy(F.desc("prior"), F.desc("movie_id")).limit(2000)


def topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance rounded to two places, then the quality prior, then the id."""
    d = C.cards(spark, sf_dir).select("movie_id", F.bround("popularity", 2).alias("bucket"), C.r6(S.clamp((F.coalesce("reception", F.lit(60.0)) - 30) / 60)).alias("quality"))
    return d.orderBy(F.desc("bucket"), F.desc("quality"), "movie_id").limit(200)


def flow_attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral browse under hard filters."""
    d = hard_filter(C.cards(spark, sf_dir), RELEASED, maturity=(1, 4))
    return neutral_prior(d).select("movie_id", "title", "prior").orderBy(F.desc("prior"), F.desc("movie_id")).limit(100)


def flow_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a query: tier 1 as a prefix of the title or of a word, tier 2 elsewhere; then length, prior, id."""
    q = "re"
    title = F.lower("title")
    tier = F.when(title.startswith(q) | title.contains(" " + q), 1).otherwise(2)
    d = neutral_prior(C.cards(spark, sf_dir).where(title.contains(q)))
    return d.select("movie_id", "title", tier.alias("tier"), "prior").orderBy("tier", F.char_length("title"), F.desc("prior"), F.desc("movie_id")).limit(25)


_ = "WITH" + C.CARDS + "," + C.POPULAR + ", n AS (SELECT *, round(0.8::DOUBLE * popularity + 0.2::DOUBLE * least(greatest(reception / 100, 0), 1), 6) AS prior FROM popular)"
QUERIES = {
    "topk_browse": (topk_browse, _ + " SELECT movie_id, round(popularity, 6) AS popularity FROM n ORDER BY 2 DESC, 1 DESC LIMIT 100"),
    "topk_quality_popularity": (topk_quality_popularity, _ + " SELECT movie_id, round(popularity * coalesce(reception, 0), 6) AS product FROM n ORDER BY 2 DESC, 1 DESC LIMIT 100"),
    "topk_neutral_seed": (topk_neutral_seed, _ + " SELECT movie_id, prior FROM n ORDER BY 2 DESC, 1 DESC LIMIT 2000"),
    "topk_rerank": (topk_rerank, _ + " SELECT movie_id, round_even(popularity, 2) AS bucket, round(least(greatest((coalesce(reception, 60) - 30) / 60, 0), 1), 6) AS quality FROM n ORDER BY 2 DESC, 3 DESC, 1 LIMIT 200"),
    "flow_attribute_search": (flow_attribute_search, _ + f" SELECT movie_id, title, prior FROM n WHERE released BETWEEN {RELEASED[0]} AND {RELEASED[1]} AND maturity_rank BETWEEN 1 AND 4 ORDER BY prior DESC, movie_id DESC LIMIT 100"),
    "flow_title_search": (flow_title_search, _ + " SELECT movie_id, title, CASE WHEN starts_with(lower(title), 're') OR contains(lower(title), ' re') THEN 1 ELSE 2 END AS tier, prior FROM n WHERE contains(lower(title), 're') ORDER BY tier, length(title), prior DESC, movie_id DESC LIMIT 25"),
}
