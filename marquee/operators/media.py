"""How alike two production media are: live action, animation, and its techniques."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogue as C

#: Keywords of the media in the test catalogue.
LIVE, ANIMATION, COMPUTER, HAND_DRAWN, STOP_MOTION, ANIME = MEDIA = (1, 2, 3, 4, 5, 6)
# Likeness of two media (equal ones 1, others 0), and the factors of a score by it.
ALIKE = {
    (ANIMATION, COMPUTER): 0.90,
    (ANIMATION, HAND_DRAWN): 0.90,
    (ANIMATION, STOP_MOTION): 0.90,
    (ANIMATION, ANIME): 0.90,
    (COMPUTER, HAND_DRAWN): 0.60,
    (COMPUTER, STOP_MOTION): 0.50,
    (COMPUTER, ANIME): 0.55,
    (HAND_DRAWN, STOP_MOTION): 0.65,
    (HAND_DRAWN, ANIME): 0.85,
    (STOP_MOTION, ANIME): 0.55,
}
CROSS, FLOOR, RANGE = 0.65, 0.85, 0.15


def pairs() -> dict[tuple[int, int], float]:
    return {(m, m): 1.0 for m in MEDIA} | ALIKE


def media_of(keywords: Column) -> Column:
    return F.array_intersect(keywords.cast("array<long>"), F.array(*[F.lit(m).cast("long") for m in MEDIA]))


def likeness(a: Column, b: Column) -> Column:
    """The best likeness of a medium of one with a medium of the other; 0 if either has none."""
    has = lambda c, m: F.array_contains(c, F.lit(m).cast("long"))
    return reduce(F.greatest, [F.when((has(a, x) & has(b, y)) | (has(a, y) & has(b, x)), s).otherwise(0.0) for (x, y), s in pairs().items()])


def factor(a: Column, b: Column) -> Column:
    """1 if either medium is unknown, CROSS if they have nothing in common, else FLOOR and a part of RANGE."""
    alike = likeness(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).when(alike == 0, CROSS).otherwise(FLOOR + RANGE * alike)


def sql_likeness(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN list_contains({a}, {x}) AND list_contains({b}, {y}) OR list_contains({a}, {y}) AND list_contains({b}, {x}) THEN {s}::DOUBLE ELSE 0 END" for (x, y), s in pairs().items()) + ")"


def sql_factor(a: str, b: str) -> str:
    none = " OR ".join(f"NOT list_has_any({c}, {list(MEDIA)})" for c in (a, b))
    return f"CASE WHEN {none} THEN 1 WHEN {sql_likeness(a, b)} = 0 THEN {CROSS}::DOUBLE ELSE {FLOOR}::DOUBLE + {RANGE}::DOUBLE * {sql_likeness(a, b)} END"


def medium_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card's likeness and factor to three anchors, joined by a key that all share: as many rows a card as anchors."""
    cards = C.cards(spark, sf_dir).select("movie_id", media_of(F.col("keyword_ids")).alias("media"), F.lit(True).alias("_all"))
    anchors = cards.where(F.col("movie_id").isin(3, 12, 41)).select(F.col("movie_id").alias("anchor"), F.col("media").alias("own"), "_all")
    d = cards.join(F.broadcast(anchors), "_all")
    return d.select("anchor", "movie_id", likeness(F.col("own"), F.col("media")).alias("likeness"), C.r6(factor(F.col("own"), F.col("media"))).alias("factor"))


QUERIES = {
    "medium_factors": (
        medium_factors,
        f"WITH{C.CARDS} SELECT a.movie_id AS anchor, c.movie_id, {sql_likeness('a.keyword_ids', 'c.keyword_ids')} AS likeness, round({sql_factor('a.keyword_ids', 'c.keyword_ids')}, 6) AS factor FROM cards a, cards c WHERE a.movie_id IN (3, 12, 41)",
    )
}
