"""Ingestion funnel: two quality scores with their gates and thresholds, and the column statistics that thresholds are read from.

The reference day is a parameter, so scores do not depend on when they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C

# Fixed values of both scores.
VOTE_CAPS = {"detail": 2001, "scraped": 12001, "no_provider": 101}
POPULARITY_CAP, LATE_POPULARITY_CAP, PLOT_CAP = 11, 4, 5001
RECENCY_MOST, CLASSIC_FROM, CLASSIC_RAMP, CLASSIC_CAP, LEAST_AGE = 2.0, 20, 30, 1.5, 0.5
FIRST_WEIGHTS = {"votes": 0.50, "popularity": 0.20, "overview": 0.15, "complete": 0.15}
FIRST_THRESHOLD = 0.2344
PRIOR_VOTES, PRIOR_RATING = 500, 6.0
BLENDS = ((100, 0.95), (1000, 0.70), (None, 0.85))
SECOND_WEIGHTS = {"notability": 0.31, "critics": 0.08, "community": 0.08, "popularity": 0.08, "reviews": 0.15, "plot": 0.12, "lexical": 0.10, "complete": 0.08}
TITLE_TYPES = ("movie", "tvMovie", "short", "video")
THEATER_DAYS = 75
GROUP_THRESHOLDS = {"has_providers": 0.486, "no_providers_new": 0.55, "no_providers_old": 0.654}


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, which must add up to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights add up to {sum(weights.values())}")
    return weights


def log_share(x: Column, cap: float) -> Column:
    return F.least(F.log10(F.greatest(x, F.lit(0.0)) + 1) / F.log10(F.lit(float(cap))), F.lit(1.0))


def age_boost(released: Column, today: Column, recent: bool = True) -> Column:
    """Up to 2 for items of a year or less, 1 from two to twenty years, then rising to 1.5 over thirty years; null date 1."""
    years = F.datediff(today, released) / 365.0
    classic = F.least(F.lit(CLASSIC_CAP), 1 + F.greatest(F.lit(0.0), years - CLASSIC_FROM) / CLASSIC_RAMP)
    boost = F.greatest(F.lit(1.0), F.least(F.lit(RECENCY_MOST), RECENCY_MOST / F.greatest(years, F.lit(LEAST_AGE))), classic) if recent else classic
    return F.when(released.isNull(), 1.0).otherwise(boost)


def vote_score(votes: Column, released: Column, today: Column, source: str) -> Column:
    return F.least(log_share(votes, VOTE_CAPS[source]) * age_boost(released, today), F.lit(1.0))


def overview_score(length: Column) -> Column:
    return F.when(length == 0, 0.0).when(length <= 50, 0.2).when(length <= 100, 0.5).when(length <= 200, 0.8).otherwise(1.0)


def share_of(flags: list[Column]) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0)) / float(len(flags))


def capped(count: Column, cap: int) -> Column:
    return F.least(F.coalesce(count, F.lit(0)) / float(cap), F.lit(1.0))


def first_score(d: DataFrame, today: Column) -> Column:
    """0 for unreleased items, 1 for those with a provider, else the weighted votes, popularity, overview and completeness."""
    parts = {
        "votes": vote_score(F.col("votes"), F.col("release_date"), today, "no_provider"),
        "popularity": log_share(F.col("buzz"), POPULARITY_CAP),
        "overview": overview_score(F.col("overview_length")),
        "complete": share_of([F.col("genres") > 0, F.col("poster").isNotNull(), *[F.col(c) for c in FLAGS]]),
    }
    blend = sum((w * parts[name] for name, w in checked_weights(FIRST_WEIGHTS).items()), F.lit(0.0))
    return F.when(F.coalesce(F.col("release_date") > today, F.lit(False)), 0.0).when(F.size("provider_keys") > 0, 1.0).otherwise(blend)


def notability(votes: Column, rating: Column, released: Column, today: Column) -> Column:
    """Log votes blended with the rating shrunk towards the mean, by how far the number of votes supports the rating; then the age boost."""
    base = log_share(votes, VOTE_CAPS["scraped"])
    shrunk = (votes * rating + PRIOR_VOTES * PRIOR_RATING) / (votes + PRIOR_VOTES) / 10
    mix = lambda w: w * base + (1 - w) * shrunk
    blended = F.when(votes < BLENDS[0][0], mix(BLENDS[0][1])).when(votes < BLENDS[1][0], mix(BLENDS[1][1])).otherwise(mix(BLENDS[2][1]))
    return F.least(F.when(rating.isNotNull() & (votes > 0), blended).otherwise(base) * age_boost(released, today), F.lit(1.0))


def second_parts(d: DataFrame, today: Column) -> dict[str, Column]:
    """The eight signals of the second score."""
    c = F.col
    reviews = F.when(c("reviews") > 0, c("reviews")).otherwise(c("detail_reviews"))
    review_chars = F.when(c("reviews") > 0, c("review_chars")).otherwise(c("detail_review_chars"))
    plot = c("plot_chars") + F.when(c("scraped_overview") > 0, c("scraped_overview")).otherwise(c("overview_length"))
    lexical = (capped(c("actors"), 10) + capped(c("characters"), 10) + (c("writers") > 0).cast("int") + (c("producers") > 0).cast("int") + c("has_companies").cast("int")) / 5
    return {
        "notability": notability(c("votes"), c("rating"), c("release_date"), today),
        "critics": (c("critic_rating").isNotNull().cast("int") + c("has_reception").cast("int")) / 2,
        "community": (capped(c("plot_keywords"), 5) + 2 * capped(reviews, 5) + 3 * (c("summaries") > 0).cast("int") + 4 * (c("synopses") > 0).cast("int")) / 10,
        "popularity": log_share(c("buzz"), LATE_POPULARITY_CAP),
        "reviews": (capped(review_chars, 5000) + capped(reviews, 5)) / 2,
        "plot": log_share(plot, PLOT_CAP),
        "lexical": F.least(lexical * age_boost(c("release_date"), today, recent=False), F.lit(1.0)),
        "complete": (capped(c("plot_keywords"), 5) + capped(c("keywords"), 6) + capped(c("guide_items"), 3) + c("rated").cast("int") + c("has_budget").cast("int")) / 5,
    }


def second_score(parts: dict[str, Column]) -> Column:
    """0 for other title types and for items without any text, else the weighted signals."""
    blend = sum((w * parts[name] for name, w in checked_weights(SECOND_WEIGHTS).items()), F.lit(0.0))
    textless = (F.col("summaries") == 0) & (F.col("synopses") == 0) & (F.col("reviews") == 0)
    return F.when(~F.coalesce(F.col("title_type").isin(*TITLE_TYPES), F.lit(False)) | textless, 0.0).otherwise(blend)


def provider_group(keys: Column, released: Column, today: Column) -> Column:
    new = F.coalesce(F.datediff(today, released) <= THEATER_DAYS, F.lit(False))
    return F.when(F.size(keys) > 0, "has_providers").when(new, "no_providers_new").otherwise("no_providers_old")


def unpack_keys(packed: Column) -> Column:
    """Little-endian 32-bit numbers of a binary column as an array; null and empty give none, a rest of fewer than four bytes is left out."""
    groups = F.regexp_extract_all(F.coalesce(F.hex(packed), F.lit("")), F.lit("(.{8})"), F.lit(1))
    return F.transform(groups, lambda h: F.conv(F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("long"))


def pack_keys(keys: Column) -> Column:
    """An array of numbers as little-endian 32-bit binary."""
    flipped = lambda h: F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)])
    return F.unhex(F.array_join(F.transform(keys, lambda k: flipped(F.lpad(F.hex(k), 8, "0"))), ""))


TODAY = "1998-10-15"
FLAGS = ("has_people", "has_countries", "has_companies", "has_keywords", "has_budget", "has_revenue")


def funnel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail and scraped columns of every card: counts and flags from the card's own columns."""
    m, v = F.col("movie_id"), F.col("votes")
    return C.cards(spark, sf_dir).select(
        "movie_id",
        "votes",
        F.when(m % 29 != 0, F.to_date(F.timestamp_seconds("released"))).alias("release_date"),
        F.when(m % 4 == 0, F.col("offer_keys")).otherwise(F.array().cast("array<long>")).alias("provider_keys"),
        (F.col("runtime") / 4.0).alias("buzz"),
        (F.char_length("title") * (m % 9)).alias("overview_length"),
        F.size("genre_ids").alias("genres"),
        F.when(m % 3 != 0, F.col("title")).alias("poster"),
        (m % 2 == 0).alias("has_people"),
        (m % 5 != 0).alias("has_countries"),
        (m % 6 != 0).alias("has_companies"),
        (m % 7 < 4).alias("has_keywords"),
        (m % 8 < 5).alias("has_budget"),
        (m % 9 < 3).alias("has_revenue"),
        F.when(m % 13 != 0, F.col("reception") / 10).alias("rating"),
        F.when(m % 11 < 3, F.col("reception")).alias("critic_rating"),
        (m % 10 == 0).alias("has_reception"),
        (v % 8).alias("plot_keywords"),
        (v % 9).alias("keywords"),
        (m % 5).alias("guide_items"),
        (m % 6).alias("reviews"),
        (m % 6 * 700).alias("review_chars"),
        (m % 3).alias("detail_reviews"),
        (m % 3 * 400).alias("detail_review_chars"),
        (m % 4).alias("summaries"),
        F.when(m % 5 == 1, 1).otherwise(0).alias("synopses"),
        (m % 4 * 350 + m % 5 * 800).alias("plot_chars"),
        (m % 2 * 180).alias("scraped_overview"),
        F.size("keyword_ids").alias("actors"),
        (F.size("keyword_ids") / 2).alias("characters"),
        (m % 3).alias("writers"),
        (m % 4).alias("producers"),
        F.col("maturity_rank").isNotNull().alias("rated"),
        F.element_at(F.array(*map(F.lit, ("movie", "tvMovie", "short", "video", "tvSeries"))), (F.col("release_format") + 1).cast("int")).alias("title_type"),
    )


def _today() -> Column:
    return F.to_date(F.lit(TODAY))


def funnel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = funnel_rows(spark, sf_dir)
    scored = d.select("movie_id", first_score(d, _today()).alias("score"))
    return scored.select("movie_id", C.r6(F.col("score")).alias("score"), F.when(F.col("score") < FIRST_THRESHOLD, "below_threshold").alias("filtered"))


def funnel_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = funnel_rows(spark, sf_dir)
    parts = second_parts(d, _today())
    group = provider_group(F.col("provider_keys"), F.col("release_date"), _today())
    least = F.create_map(*[F.lit(x) for pair in GROUP_THRESHOLDS.items() for x in pair])
    scored = d.select("movie_id", group.alias("group"), *[C.r6(c).alias(name) for name, c in parts.items()], second_score(parts).alias("score"))
    return scored.withColumn("passes", F.col("score") >= least[F.col("group")]).withColumn("score", C.r6(F.col("score")))


def funnel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider keys packed to binary and unpacked again."""
    d = funnel_rows(spark, sf_dir).withColumn("packed", pack_keys(F.col("provider_keys")))
    back = unpack_keys(F.col("packed"))
    return d.select("movie_id", F.lower(F.hex("packed")).alias("packed"), F.size(back).alias("n"), F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# Statistics: name, and the upper ends of the buckets with their labels.
VOTE_BUCKETS = ((0, "0"), (10, "1_10"), (50, "11_50"), (100, "51_100"), (500, "101_500"), (1000, "501_1000"), (5000, "1001_5000"), (10000, "5001_10000"), (None, "10001_plus"))
BUZZ_BUCKETS = ((0, "0.0"), (1, "0.01_1.0"), (5, "1.01_5.0"), (10, "5.01_10.0"), (50, "10.01_50.0"), (100, "50.01_100.0"), (None, "100.01_plus"))
RATING_BUCKETS = ((0, "0.0"), (3, "0.1_3.0"), (5, "3.1_5.0"), (6.5, "5.1_6.5"), (7.5, "6.6_7.5"), (8.5, "7.6_8.5"), (None, "8.6_10.0"))
OVERVIEW_BUCKETS = ((0, "0"), (20, "1_20"), (50, "21_50"), (100, "51_100"), (200, "101_200"), (500, "201_500"), (None, "501_plus"))
PROVIDER_BUCKETS = ((0, "0"), (2, "1_2"), (5, "3_5"), (10, "6_10"), (None, "11_plus"))
RUNTIME_BUCKETS = ((0, "null_or_0"), (39, "1_39"), (60, "40_60"), (90, "61_90"), (120, "91_120"), (180, "121_180"), (None, "181_plus"))
YEAR_BUCKETS = ((1929, "pre_1930"), (1949, "1930_1949"), (1969, "1950_1969"), (1999, "1970_1999"), (2009, "2000_2009"), (2019, "2010_2019"), (2024, "2020_2024"), (None, "2025_present"))
PERCENTS = (25, 50, 75, 90, 95, 99)


def bucket(value: Column, ends: tuple) -> Column:
    out = None
    for end, label in ends[:-1]:
        out = F.when(value <= end, label) if out is None else out.when(value <= end, label)
    return out.otherwise(ends[-1][1])


def percentiles(d: DataFrame, value: str) -> DataFrame:
    """One row of exact interpolated percentiles, from the histogram of values so that no group holds all rows."""
    histogram = d.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return histogram.agg(*[F.percentile("_v", F.lit(p / 100), F.col("_n")).alias(f"p{p}") for p in PERCENTS])


def profile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attribute, bucket, n) of eight attributes in one pass."""
    d = funnel_rows(spark, sf_dir).join(C.cards(spark, sf_dir).select("movie_id", "runtime"), "movie_id")
    pairs = {
        "votes": bucket(F.col("votes"), VOTE_BUCKETS),
        "buzz": bucket(F.col("buzz"), BUZZ_BUCKETS),
        "rating": bucket(F.coalesce("rating", F.lit(0.0)), RATING_BUCKETS),
        "overview": bucket(F.col("overview_length"), OVERVIEW_BUCKETS),
        "providers": bucket(F.size("provider_keys"), PROVIDER_BUCKETS),
        "runtime": bucket(F.coalesce("runtime", F.lit(0)), RUNTIME_BUCKETS),
        "year": F.when(F.col("release_date").isNull(), "null").otherwise(bucket(F.year("release_date"), YEAR_BUCKETS)),
        "poster": F.when(F.col("poster").isNull(), "null").otherwise("present"),
    }
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("bucket")) for k, v in pairs.items()])).alias("x")).select("x.*")
    return rows.groupBy("attribute", "bucket").agg(F.count(F.lit(1)).alias("n"))


def profile_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, mean and number of zeros of votes, buzz and rating."""
    d = funnel_rows(spark, sf_dir).select(F.col("votes").cast("double").alias("votes"), "buzz", "rating")
    out = None
    for name in d.columns:
        own = percentiles(d, name).crossJoin(d.agg(F.avg(name).alias("mean"), F.count(F.when(F.col(name) == 0, 1)).alias("zeros")))
        own = own.select(F.lit(name).alias("attribute"), *[C.r6(F.col(f"p{p}")).alias(f"p{p}") for p in PERCENTS], C.r6(F.col("mean")).alias("mean"), "zeros")
        out = own if out is None else out.unionByName(own)
    return out


def vote_band(votes: Column) -> Column:
    """Band between the percentiles p25, p50, p75 and p90, which must be columns."""
    return F.when(votes < F.col("p25"), "below_p25").when(votes < F.col("p50"), "p25_to_p50").when(votes < F.col("p75"), "p50_to_p75").when(votes < F.col("p90"), "p75_to_p90").otherwise("above_p90")


def profile_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vote band: items, provider coverage, mean completeness, missing posters, coverage of each flag."""
    d = funnel_rows(spark, sf_dir)
    d = d.crossJoin(F.broadcast(percentiles(d, "votes"))).withColumn("band", vote_band(F.col("votes")))
    flags = [F.col(f).cast("int") for f in FLAGS]
    return d.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.size("provider_keys") > 0).cast("int")), 4).alias("coverage"),
        F.round(F.avg(sum(flags[1:], flags[0])), 4).alias("completeness"),
        F.round(F.avg(F.col("poster").isNull().cast("int")), 4).alias("no_poster"),
        *[F.round(F.avg(F.col(f).cast("int")), 4).alias(f) for f in FLAGS],
    )


def profile_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two table of items about the medians of votes and buzz."""
    d = funnel_rows(spark, sf_dir)
    middle = percentiles(d, "votes").select(F.col("p50").alias("votes_50")).crossJoin(percentiles(d, "buzz").select(F.col("p50").alias("buzz_50")))
    d = d.crossJoin(F.broadcast(middle))
    return d.groupBy((F.col("votes") >= F.col("votes_50")).alias("high_votes"), (F.col("buzz") >= F.col("buzz_50")).alias("high_buzz")).agg(F.count(F.lit(1)).alias("n"))


def profile_rating_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and mean rating at or above each vote percentile: one pass, a row being counted under each floor that it reaches."""
    d = funnel_rows(spark, sf_dir).select("votes", F.coalesce("rating", F.lit(0.0)).alias("rating"))
    floors = percentiles(d, "votes").select(F.explode(F.array(*[F.struct(F.lit(f"p{p}").alias("floor"), F.col(f"p{p}").alias("mark")) for p in PERCENTS[1:]])).alias("x")).select("x.*")
    met = d.join(F.broadcast(floors), F.col("votes") >= F.col("mark"))
    return met.groupBy("floor", "mark").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("rating")).alias("mean_rating"))


def _bucket_sql(value: str, ends: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {end} THEN '{label}'" for end, label in ends[:-1]) + f" ELSE '{ends[-1][1]}' END"


_ROWS = f"""WITH{C.CARDS}, d AS (SELECT movie_id, votes, runtime, title, CASE WHEN movie_id % 29 <> 0 THEN CAST(make_timestamp(released * 1000000) AS DATE) END AS release_date,
  CASE WHEN movie_id % 4 = 0 THEN offer_keys ELSE [] END AS provider_keys, runtime / 4.0::DOUBLE AS buzz, length(title) * (movie_id % 9) AS overview_length, len(genre_ids) AS genres,
  CASE WHEN movie_id % 3 <> 0 THEN title END AS poster, movie_id % 2 = 0 AS has_people, movie_id % 5 <> 0 AS has_countries, movie_id % 6 <> 0 AS has_companies, movie_id % 7 < 4 AS has_keywords,
  movie_id % 8 < 5 AS has_budget, movie_id % 9 < 3 AS has_revenue, CASE WHEN movie_id % 13 <> 0 THEN reception / 10 END AS rating, CASE WHEN movie_id % 11 < 3 THEN reception END AS critic_rating,
  movie_id % 10 = 0 AS has_reception, votes % 8 AS plot_keywords, votes % 9 AS keywords, movie_id % 5 AS guide_items, movie_id % 6 AS reviews, movie_id % 6 * 700 AS review_chars,
  movie_id % 3 AS detail_reviews, movie_id % 3 * 400 AS detail_review_chars, movie_id % 4 AS summaries, CASE WHEN movie_id % 5 = 1 THEN 1 ELSE 0 END AS synopses,
  movie_id % 4 * 350 + movie_id % 5 * 800 AS plot_chars, movie_id % 2 * 180 AS scraped_overview, len(keyword_ids) AS actors, len(keyword_ids) / 2 AS characters, movie_id % 3 AS writers,
  movie_id % 4 AS producers, maturity_rank IS NOT NULL AS rated, ['movie', 'tvMovie', 'short', 'video', 'tvSeries'][release_format + 1] AS title_type FROM cards),
e AS (SELECT *, datediff('day', release_date, DATE '{TODAY}') / 365.0::DOUBLE AS years FROM d),
f AS (SELECT *, CASE WHEN years IS NULL THEN 1 ELSE least(1.5, 1 + greatest(0, years - 20) / 30) END AS classic,
  CASE WHEN years IS NULL THEN 1 ELSE greatest(1, least(2.0, 2.0 / greatest(years, 0.5)), least(1.5, 1 + greatest(0, years - 20) / 30)) END AS boost FROM e)"""
_LOG = "least(log10({} + 1.0::DOUBLE) / log10({}), 1)"
_COMPLETE = "((genres > 0)::INT + (poster IS NOT NULL)::INT + " + " + ".join(f"{c}::INT" for c in FLAGS) + ") / 8::DOUBLE"
_FIRST = f"""{_ROWS}, s AS (SELECT movie_id, CASE WHEN release_date > DATE '{TODAY}' THEN 0::DOUBLE WHEN len(provider_keys) > 0 THEN 1
  ELSE 0.5::DOUBLE * least({_LOG.format("votes", 101)} * boost, 1) + 0.2::DOUBLE * {_LOG.format("buzz", 11)}
  + 0.15::DOUBLE * {_bucket_sql("overview_length", ((0, 0.0), (50, 0.2), (100, 0.5), (200, 0.8), (None, 1.0))).replace("'", "")} + 0.15::DOUBLE * {_COMPLETE} END AS score FROM f)
SELECT movie_id, round(score, 6) AS score, CASE WHEN score < 0.2344 THEN 'below_threshold' END AS filtered FROM s"""
_CAP = lambda c, n: f"least({c} / {n}::DOUBLE, 1)"
_MIX = lambda w: f"{w}::DOUBLE * vb + (1 - {w}::DOUBLE) * sh"
_SECOND = f"""{_ROWS}, g AS (SELECT *, {_LOG.format("votes", 12001)} AS vb, (votes * rating + 3000) / (votes + 500) / 10 AS sh,
  CASE WHEN reviews > 0 THEN reviews ELSE detail_reviews END AS rv, CASE WHEN reviews > 0 THEN review_chars ELSE detail_review_chars END AS rc FROM f),
h AS (SELECT movie_id, summaries, synopses, reviews AS own_reviews, title_type,
  CASE WHEN len(provider_keys) > 0 THEN 'has_providers' WHEN datediff('day', release_date, DATE '{TODAY}') <= 75 THEN 'no_providers_new' ELSE 'no_providers_old' END AS "group",
  least(CASE WHEN rating IS NOT NULL AND votes > 0 THEN CASE WHEN votes < 100 THEN {_MIX(0.95)} WHEN votes < 1000 THEN {_MIX(0.70)} ELSE {_MIX(0.85)} END ELSE vb END * boost, 1) AS notability,
  ((critic_rating IS NOT NULL)::INT + has_reception::INT) / 2::DOUBLE AS critics,
  ({_CAP("plot_keywords", 5)} + 2 * {_CAP("rv", 5)} + 3 * (summaries > 0)::INT + 4 * (synopses > 0)::INT) / 10 AS community,
  {_LOG.format("buzz", 4)} AS popularity, ({_CAP("rc", 5000)} + {_CAP("rv", 5)}) / 2 AS reviews,
  {_LOG.format("(plot_chars + CASE WHEN scraped_overview > 0 THEN scraped_overview ELSE overview_length END)", 5001)} AS plot,
  least(({_CAP("actors", 10)} + {_CAP("characters", 10)} + (writers > 0)::INT + (producers > 0)::INT + has_companies::INT) / 5 * classic, 1) AS lexical,
  ({_CAP("plot_keywords", 5)} + {_CAP("keywords", 6)} + {_CAP("guide_items", 3)} + rated::INT + has_budget::INT) / 5 AS complete FROM g),
i AS (SELECT *, CASE WHEN title_type NOT IN {TITLE_TYPES} OR (summaries = 0 AND synopses = 0 AND own_reviews = 0) THEN 0::DOUBLE ELSE {" + ".join(f"{w}::DOUBLE * {n}" for n, w in SECOND_WEIGHTS.items())} END AS score FROM h)
SELECT movie_id, "group", {", ".join(f"round({n}, 6) AS {n}" for n in SECOND_WEIGHTS)}, round(score, 6) AS score,
  score >= CASE "group" WHEN 'has_providers' THEN 0.486 WHEN 'no_providers_new' THEN 0.55 ELSE 0.654 END AS passes FROM i"""
_BYTE = lambda k: f"lpad(lower(hex((k >> {8 * k}) & 255)), 2, '0')"
_KEYS = f"""{_ROWS} SELECT movie_id, coalesce(array_to_string([{" || ".join(_BYTE(k) for k in range(4))} FOR k IN provider_keys], ''), '') AS packed,
  len(provider_keys) AS n, CAST(coalesce(list_sum(provider_keys), 0) AS BIGINT) AS total FROM d"""
_PAIRS = {
    "votes": _bucket_sql("votes", VOTE_BUCKETS),
    "buzz": _bucket_sql("buzz", BUZZ_BUCKETS),
    "rating": _bucket_sql("coalesce(rating, 0)", RATING_BUCKETS),
    "overview": _bucket_sql("overview_length", OVERVIEW_BUCKETS),
    "providers": _bucket_sql("len(provider_keys)", PROVIDER_BUCKETS),
    "runtime": _bucket_sql("coalesce(runtime, 0)", RUNTIME_BUCKETS),
    "year": f"CASE WHEN release_date IS NULL THEN 'null' ELSE {_bucket_sql('year(release_date)', YEAR_BUCKETS)} END",
    "poster": "CASE WHEN poster IS NULL THEN 'null' ELSE 'present' END",
}
_BUCKETS = _ROWS + " " + " UNION ALL ".join(f"SELECT '{k}' AS attribute, {v} AS bucket, count(*) AS n FROM d GROUP BY 2" for k, v in _PAIRS.items())
_QUANTILES = lambda c: ", ".join(f"round(quantile_cont({c}::DOUBLE, {p / 100}), 6) AS p{p}" for p in PERCENTS)
_PERCENTILES = _ROWS + " " + " UNION ALL ".join(f"SELECT '{c}' AS attribute, {_QUANTILES(c)}, round(avg({c}), 6) AS mean, count(*) FILTER (WHERE {c} = 0) AS zeros FROM d" for c in ("votes", "buzz", "rating"))
_Q = "(SELECT " + ", ".join(f"quantile_cont(votes::DOUBLE, {p / 100}) AS p{p}" for p in PERCENTS) + " FROM d)"
_CROSS = f"""{_ROWS}, b AS (SELECT d.*, CASE WHEN votes < p25 THEN 'below_p25' WHEN votes < p50 THEN 'p25_to_p50' WHEN votes < p75 THEN 'p50_to_p75' WHEN votes < p90 THEN 'p75_to_p90' ELSE 'above_p90' END AS band FROM d, {_Q} q)
SELECT band, count(*) AS n, round(avg((len(provider_keys) > 0)::INT), 4) AS coverage, round(avg({" + ".join(f"{c}::INT" for c in FLAGS)}), 4) AS completeness,
  round(avg((poster IS NULL)::INT), 4) AS no_poster, {", ".join(f"round(avg({c}::INT), 4) AS {c}" for c in FLAGS)} FROM b GROUP BY 1"""
_MEDIANS = f"{_ROWS} SELECT votes >= (SELECT quantile_cont(votes::DOUBLE, 0.5) FROM d) AS high_votes, buzz >= (SELECT quantile_cont(buzz, 0.5) FROM d) AS high_buzz, count(*) AS n FROM d GROUP BY 1, 2"
_FLOORS = f"{_ROWS}, q AS {_Q}, fl AS (" + " UNION ALL ".join(f"SELECT 'p{p}' AS floor, p{p} AS mark FROM q" for p in PERCENTS[1:]) + ") SELECT floor, mark, count(*) AS n, round(avg(coalesce(rating, 0)), 6) AS mean_rating FROM d JOIN fl ON votes >= mark GROUP BY 1, 2"
QUERIES = {
    "funnel_first": (funnel_first, _FIRST),
    "funnel_second": (funnel_second, _SECOND),
    "funnel_keys": (funnel_keys, _KEYS),
    "profile_buckets": (profile_buckets, _BUCKETS),
    "profile_percentiles": (profile_percentiles, _PERCENTILES),
    "profile_cross": (profile_cross, _CROSS),
    "profile_medians": (profile_medians, _MEDIANS),
    "profile_rating_floors": (profile_rating_floors, _FLOORS),
}
