"""Weighted metadata preferences: ten optional preferences, each a Column score, and their weighted mean.

A missing value scores 0 and never drops an active preference. An excluded genre or language scores -2, so that it outweighs all
that the other preferences can give.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from .scoring import trending

# The weights of the preferences, the date graces in days and the runtime grace in minutes.
WEIGHTS = {"genres": 5, "release_date": 4, "watch_providers": 4, "audio_language": 3, "maturity": 3, "reception": 3, "duration": 2, "trending": 2, "popular": 2, "budget_size": 3}
LEAST_DATE_GRACE, MOST_DATE_GRACE, OPEN_DATE_GRACE, EXACT_DATE_GRACE = 365.0, 1825.0, 1095.0, 730.0
RUNTIME_GRACE = 30.0
EXCLUDED = -2.0
UNRATED = 999
MOST_RANK = 5
ACCESS_BITS = 4
INFINITE = float("inf")


def epoch(day: str) -> float:
    return datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()


def date_window(operation: str, first: str, second: str | None = None) -> tuple[float, float, float]:
    """(low, high, grace in days) of a date preference; operations: between, after, before, exact."""
    at = epoch(first)
    if operation == "between" and second is not None:
        low, high = sorted((at, epoch(second)))
        return low, high, max(LEAST_DATE_GRACE, min(0.5 * (high - low) / S.DAY, MOST_DATE_GRACE))
    if operation == "after":
        return at, INFINITE, OPEN_DATE_GRACE
    if operation == "before":
        return -INFINITE, at, OPEN_DATE_GRACE
    return at, at, EXACT_DATE_GRACE


def number_window(operation: str, first: float, second: float | None = None) -> tuple[float, float]:
    """(low, high) of a number preference; operations: between, >, >=, <, <=, exact. Strict bounds count as loose ones."""
    if operation == "between" and second is not None:
        return min(first, second), max(first, second)
    if operation in (">", ">="):
        return first, INFINITE
    if operation in ("<", "<="):
        return -INFINITE, first
    return first, first


def rank_window(operation: str, rank: int) -> tuple[int, int]:
    """(low, high) ranks of a maturity preference on the scale 1 to 5; it may be empty."""
    windows = {">": (rank + 1, MOST_RANK), "<": (1, rank - 1), ">=": (rank, MOST_RANK), "<=": (1, rank)}
    return windows.get(operation, (rank, rank))


def offer_keys(providers: list[int], methods: list[int]) -> list[int]:
    """Keys of provider and access method: the method in the low four bits."""
    return [provider << ACCESS_BITS | method for provider in providers for method in methods]


def _any_of(ids: Column, wanted: list[int]) -> Column:
    """Whether an array column holds one of the wanted ids; false for none wanted."""
    return F.exists(ids, lambda x: x.isin(wanted)) if wanted else F.lit(False)


def _hits(ids: Column, wanted: list[int]) -> Column:
    return F.size(F.array_distinct(F.filter(ids, lambda x: x.isin(wanted))))


def window_score(value: Column, low: float, high: float, grace: float) -> Column:
    """1 inside [low, high], falling to 0 over grace outside; null 0. Either bound may be infinite."""
    below = F.lit(low) - value if low != -INFINITE else F.lit(0.0)
    above = value - F.lit(high) if high != INFINITE else F.lit(0.0)
    gap = F.greatest(below, above, F.lit(0.0))
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / grace))


def genres_score(ids: Column, include: list[int], exclude: list[int]) -> Column:
    """-2 with an excluded genre, else the share of the included ones that match, 1 if none is included."""
    match = _hits(ids, include) / float(len(include)) if include else F.lit(1.0)
    return F.when(ids.isNull(), 0.0).when(_any_of(ids, exclude), EXCLUDED).otherwise(match)


def language_score(ids: Column, include: list[int], exclude: list[int]) -> Column:
    match = F.when(_any_of(ids, include), 1.0).otherwise(0.0) if include else F.lit(1.0)
    return F.when(ids.isNull(), 0.0).when(_any_of(ids, exclude), EXCLUDED).otherwise(match)


def providers_score(keys: Column, exclude: list[int], any_key: list[int], desired: list[int], access: int | None) -> Column:
    """1 for a desired offer, .5 for another offer of a wanted service; access alone compares the low four bits."""
    left = F.filter(keys, lambda x: ~x.isin(exclude)) if exclude else keys
    if any_key and desired:
        score = F.when(_any_of(left, desired), 1.0).when(_any_of(left, any_key), 0.5).otherwise(0.0)
    elif any_key:
        score = F.when(_any_of(left, any_key), 1.0).otherwise(0.0)
    elif access is not None:
        score = F.when(F.exists(left, lambda x: x.bitwiseAND(15) == access), 1.0).otherwise(0.0)
    else:
        score = F.when(F.size(left) > 0, 1.0).otherwise(0.0)
    return F.when(keys.isNull(), 0.0).otherwise(score)


def maturity_score(rank: Column, low: int, high: int, unrated: bool = False) -> Column:
    """1 inside [low, high], .5 one rank off; unrated titles match only a preference for unrated."""
    rated = F.lit(0.0) if unrated else F.when(rank.between(low, high), 1.0).when(F.least(F.abs(rank - low), F.abs(rank - high)) <= 1, 0.5).otherwise(0.0)
    return F.when(rank.isNull(), 0.0).when(rank == UNRATED, float(unrated)).otherwise(rated)


def reception_ramp(reception: Column, poor: bool = False) -> Column:
    return F.coalesce(S.clamp((50 - reception) / 40 if poor else (reception - 55) / 40), F.lit(0.0))


def budget_score(bucket: Column, wanted: str) -> Column:
    return F.when(bucket == wanted, 1.0).otherwise(0.0)


def weighted_mean(scores: dict[str, Column]) -> Column:
    """Mean of the active preferences by their fixed weights."""
    total = sum(WEIGHTS[name] for name in scores)
    return sum((WEIGHTS[name] * score for name, score in scores.items()), F.lit(0.0)) / float(total)


# The preferences of the registered query.
_DATES = date_window("between", "1993-01-01", "1995-01-01")
_RUNTIME = number_window("between", 10, 20)
_RANKS = rank_window("<=", 3)
_EXCLUDE, _ANY, _DESIRED = offer_keys([3], [1, 2, 3]), offer_keys([1, 2], [1, 2, 3]), offer_keys([1, 2], [2])


def scored_preferences(cards: DataFrame) -> dict[str, Column]:
    return {
        "genres": genres_score(F.col("genre_ids"), [1, 2, 5], [7]),
        "release_date": window_score(F.col("released").cast("double"), _DATES[0], _DATES[1], _DATES[2] * S.DAY),
        "watch_providers": providers_score(F.col("offer_keys"), _EXCLUDE, _ANY, _DESIRED, None),
        "audio_language": language_score(F.col("language_ids"), [0, 1], [5]),
        "maturity": maturity_score(F.col("maturity_rank"), *_RANKS),
        "reception": reception_ramp(F.col("reception")),
        "duration": window_score(F.col("runtime").cast("double"), *_RUNTIME, RUNTIME_GRACE),
        "trending": F.coalesce(F.col("trend"), F.lit(0.0)),
        "popular": F.coalesce(F.col("popularity"), F.lit(0.0)),
        "budget_size": budget_score(F.col("budget_bucket"), "small"),
    }


def meta_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten preferences of every card and their weighted mean."""
    cards = C.cards(spark, sf_dir).join(trending(spark, sf_dir).select("movie_id", F.col("score").alias("trend")), "movie_id", "left")
    scores = scored_preferences(cards)
    return cards.select("movie_id", *[C.r6(score).alias(name) for name, score in scores.items()], C.r6(weighted_mean(scores)).alias("score"))


def meta_access_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other branches of the provider and maturity scores: exclusion alone, access alone, unrated."""
    keys, rank = F.col("offer_keys"), F.coalesce("maturity_rank", F.lit(UNRATED))
    return C.cards(spark, sf_dir).select(
        "movie_id",
        providers_score(keys, _EXCLUDE, [], [], None).alias("not_excluded"),
        providers_score(keys, [], [], [], 2).alias("access"),
        providers_score(keys, [], _ANY, [], None).alias("service"),
        maturity_score(rank, 2, 3, unrated=True).alias("unrated"),
        maturity_score(rank, 2, 3).alias("rated"),
        C.r6(reception_ramp(F.col("reception"), poor=True)).alias("poorly"),
        language_score(F.col("language_ids"), [], [2]).alias("language_excluded"),
    )


def _window_sql(value: str, low: float, high: float, grace: float) -> str:
    return f"CASE WHEN {value} IS NULL THEN 0 ELSE greatest(0, 1 - greatest({low}::DOUBLE - {value}, {value} - {high}::DOUBLE, 0) / {grace}::DOUBLE) END"


_LEFT = f"list_filter(offer_keys, lambda k: k NOT IN {tuple(_EXCLUDE)})"
_SQL = f"""WITH {C.CARDS.strip()},{C.POPULAR},
t AS (SELECT user_id AS movie_id, count(*) AS events FROM events GROUP BY 1),
u AS (SELECT movie_id, round(1 - sqrt((row_number() OVER (ORDER BY events DESC, movie_id) - 1)::DOUBLE / count(*) OVER ()), 6) AS trend FROM t),
s AS (SELECT movie_id,
  CASE WHEN list_contains(genre_ids, 7) THEN -2::DOUBLE ELSE len(list_intersect(genre_ids, [1, 2, 5])) / 3::DOUBLE END AS genres,
  {_window_sql("released", _DATES[0], _DATES[1], _DATES[2] * S.DAY)} AS release_date,
  CASE WHEN list_has_any({_LEFT}, {_DESIRED}) THEN 1::DOUBLE WHEN list_has_any({_LEFT}, {_ANY}) THEN 0.5 ELSE 0 END AS watch_providers,
  CASE WHEN list_contains(language_ids, 5) THEN -2::DOUBLE WHEN list_has_any(language_ids, [0, 1]) THEN 1 ELSE 0 END AS audio_language,
  CASE WHEN maturity_rank IS NULL THEN 0::DOUBLE WHEN maturity_rank <= 3 THEN 1 WHEN maturity_rank = 4 THEN 0.5 ELSE 0 END AS maturity,
  least(greatest((reception - 55) / 40, 0), 1) AS reception,
  {_window_sql("runtime", 10, 20, 30)} AS duration, coalesce(trend, 0)::DOUBLE AS trending, popularity AS popular,
  CASE WHEN budget_bucket = 'small' THEN 1::DOUBLE ELSE 0 END AS budget_size
  FROM popular LEFT JOIN u USING (movie_id))
SELECT movie_id, {", ".join(f"round({name}, 6) AS {name}" for name in WEIGHTS)},
  round(({" + ".join(f"{w} * {name}" for name, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}::DOUBLE, 6) AS score FROM s"""
_OTHER = f"""WITH {C.CARDS.strip()}
SELECT movie_id, CASE WHEN len({_LEFT}) > 0 THEN 1::DOUBLE ELSE 0 END AS not_excluded,
  CASE WHEN len(list_filter(offer_keys, lambda k: k & 15 = 2)) > 0 THEN 1::DOUBLE ELSE 0 END AS access,
  CASE WHEN list_has_any(offer_keys, {_ANY}) THEN 1::DOUBLE ELSE 0 END AS service,
  CASE WHEN maturity_rank IS NULL THEN 1::DOUBLE ELSE 0 END AS unrated,
  CASE WHEN maturity_rank IS NULL THEN 0::DOUBLE WHEN maturity_rank IN (2, 3) THEN 1 WHEN maturity_rank IN (1, 4) THEN 0.5 ELSE 0 END AS rated,
  round(least(greatest((50 - reception) / 40, 0), 1), 6) AS poorly,
  CASE WHEN list_contains(language_ids, 2) THEN -2::DOUBLE ELSE 1 END AS language_excluded FROM cards"""
QUERIES = {"meta_preferences": (meta_preferences, _SQL), "meta_access_only": (meta_access_only, _OTHER)}
