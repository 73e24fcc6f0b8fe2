"""Ingestion transforms: JSON details, resolved money and ratings, keywords by votes, merges of two sources, awards, brands, texts for embedding.

The registered queries build their raw records from the tables' own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import catalogue as C

# Access methods by category; keyword counts; money ratios; era thresholds (small below, large above); rating names.
ACCESS = {"flatrate": 1, "buy": 2, "rent": 3}
LEAST_KEYWORDS, MOST_KEYWORDS, DISLIKE = 10, 15, 0.75
HIT_RATIO, FLOP_RATIO, HIT_BUDGET, BOX_OFFICE_FROM = 3.0, 1.0, 1_000_000, 1980
ERAS = {
    1920: (100_000, 1_000_000),
    1930: (150_000, 2_000_000),
    1940: (250_000, 3_000_000),
    1950: (750_000, 12_000_000),
    1960: (1_000_000, 20_000_000),
    1970: (2_000_000, 25_000_000),
    1980: (5_000_000, 45_000_000),
    1990: (9_000_000, 80_000_000),
    2000: (12_000_000, 110_000_000),
    2010: (15_000_000, 150_000_000),
    2020: (18_000_000, 185_000_000),
}
RATINGS = {"G": "General Audiences", "PG": "Parental Guidance Suggested", "PG-13": "Parents Strongly Cautioned", "R": "Restricted", "NC-17": "Adults Only"}
UNRATED_RANK = 999
DETAILS = "results struct<US struct<flatrate array<struct<provider_id int>>, buy array<struct<provider_id int>>, rent array<struct<provider_id int>>>>"


def provider_keys(details: Column) -> Column:
    """Sorted distinct keys (provider << 4 | method) of the US offers in a JSON document; none for null, other regions and broken JSON."""
    us = F.from_json(details, DETAILS)["results"]["US"]
    none = F.array().cast("array<int>")
    keys = [_keys_of(us[category], method) for category, method in ACCESS.items()]
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(k, none) for k in keys])))


def _keys_of(offers: Column, method: int) -> Column:
    return F.transform(offers, lambda p: F.shiftleft(p["provider_id"], 4).bitwiseOR(F.lit(method)))


def first_positive(*values: Column) -> Column:
    """The first value over 0."""
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def reception_score(rating: Column, critics: Column) -> Column:
    """40 % of the rating scaled to 100 and 60 % of the critics' score, or the one there is; 0 counts as none."""
    r, c = F.when(rating != 0, rating), F.when(critics != 0, critics)
    return F.coalesce(0.4 * 10 * r + 0.6 * c, 10 * r, c.cast("double"))


def box_office(year: Column, budget: Column, gross: Column) -> Column:
    """hit or flop from 1980 on, where both sums are known; null for what lies between."""
    ratio = gross / budget
    verdict = F.when((ratio >= HIT_RATIO) & (budget >= HIT_BUDGET), "hit").when(ratio <= FLOP_RATIO, "flop")
    return F.when((year >= BOX_OFFICE_FROM) & (budget > 0) & (gross > 0), verdict)


def era_thresholds(year: Column) -> tuple[Column, Column]:
    """Small and large thresholds of a year, linear between decades, constant beyond the first and the last."""
    decades = sorted(ERAS)
    at = F.greatest(F.lit(decades[0]), F.least(year, F.lit(decades[-1])))

    def line(side: int) -> Column:
        out = F.lit(float(ERAS[decades[-1]][side]))
        for low in reversed(decades[:-1]):
            here, step = ERAS[low][side], (ERAS[low + 10][side] - ERAS[low][side]) / 10
            out = F.when(at < low + 10, here + step * (at - low)).otherwise(out)
        return out

    return line(0), line(1)


def budget_bucket(year: Column, budget: Column) -> Column:
    small, large = era_thresholds(year)
    return F.when(year.isNotNull(), F.when(budget < small, "small").when(budget > large, "large"))


def decade_label(year: Column) -> Column:
    decade = (F.floor(year / 10) * 10).cast("string")
    era = F.when(year < 1930, "silent era & early cinema").when(year < 1950, "golden age of hollywood").otherwise(F.concat(F.substring(decade, -2, 2), F.lit("s")))
    return F.when(year.isNull(), "").otherwise(F.concat(F.lit("Release date: "), decade, F.lit("s, "), era))


def rating_rank(rating: Column) -> Column:
    """Ordinal rank of a rating, 999 for none and unknown ones."""
    out = F.lit(UNRATED_RANK)
    for i, name in enumerate(RATINGS, 1):
        out = F.when(F.upper(rating) == name, i).otherwise(out)
    return out


def maturity_summary(rating: Column, reasons: Column, guide: Column) -> Column:
    """The reasons, else "rating — severity category, ...", else the rating's definition, else null. guide: array of (severity, category)."""
    detail = F.array_join(F.transform(guide, lambda g: F.concat_ws(" ", g["severity"], g["category"])), ", ")
    defined = F.lit(None).cast("string")
    for name, words in RATINGS.items():
        defined = F.when(rating == name, f"{name} — {words}").otherwise(defined)
    with_rating = F.when(F.coalesce(rating, F.lit("")) != "", F.concat(rating, F.lit(" — "), detail)).otherwise(detail)
    return F.when(F.size(F.coalesce(reasons, F.array())) > 0, F.array_join(reasons, ", ")).when(F.size(guide) > 0, with_rating).otherwise(defined)


def filtered_keywords(keywords: Column) -> Column:
    """Keywords by their votes, an array of (name, interested, voted): those near the best score, at least 10 and at most 15, distinct.

    Score: interested less .75 of the rest; without a positive score the first ten. Those that pass keep their order unless they are too many.
    """
    clean = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<struct<name:string,interested:int,voted:int>>")), _voted), lambda k: F.coalesce(k["name"], F.lit("")) != "")
    best = F.array_max(F.transform(clean, lambda k: k["score"]))
    bar = F.least(0.75 * best, best - 2)
    names = lambda a: F.array_distinct(F.transform(a, lambda k: k["name"]))
    by_score = lambda a: F.transform(F.array_sort(F.transform(a, lambda k, i: F.struct((-k["score"]).alias("s"), i.alias("i"), k["name"].alias("name")))), lambda k: k["name"])
    passing = names(F.filter(clean, lambda k: k["score"] >= bar))
    ranked = F.array_distinct(by_score(clean))
    padded = F.concat(passing, F.slice(F.array_except(ranked, passing), 1, F.greatest(F.lit(0), LEAST_KEYWORDS - F.size(passing))))
    capped = F.slice(F.filter(ranked, lambda n: F.array_contains(passing, n)), 1, MOST_KEYWORDS)
    chosen = F.when(F.size(passing) > MOST_KEYWORDS, capped).when(F.size(passing) < LEAST_KEYWORDS, padded).otherwise(passing)
    return F.when(F.size(clean) == 0, F.array().cast("array<string>")).when(best <= 0, F.slice(F.transform(clean, lambda k: k["name"]), 1, LEAST_KEYWORDS)).otherwise(chosen)


def _voted(k: Column) -> Column:
    interested, voted = F.coalesce(k["interested"], F.lit(0)), F.coalesce(k["voted"], F.lit(0))
    return F.struct(F.trim(k["name"]).alias("name"), (interested - DISLIKE * (voted - interested)).alias("score"))


def export_reason(adult: Column, video: Column, popularity: Column) -> Column:
    """The first reason to leave an exported entry out, null to keep it."""
    return F.when(F.coalesce(adult, F.lit(False)), "adult").when(F.coalesce(video, F.lit(False)), "video").when(F.coalesce(popularity, F.lit(0.0)) <= 0, "zero_popularity")


def merged_sources(details: DataFrame, scraped: DataFrame) -> DataFrame:
    """Full outer merge of both sources by movie_id with where each row comes from. Columns of the two but movie_id must differ."""
    d = details.withColumn("_d", F.lit(True)).join(scraped.withColumn("_s", F.lit(True)), "movie_id", "full_outer")
    return d.withColumn("origin", F.when(F.col("_d") & F.col("_s"), "both").when(F.col("_d"), "detail").otherwise("scraped")).drop("_d", "_s")


def deduplicated_awards(awards: DataFrame) -> DataFrame:
    """One row of each (movie_id, ceremony, year): the win if there is one."""
    return awards.groupBy("movie_id", "ceremony", "year").agg(F.bool_or("won").alias("won"))


def brands_of(companies: DataFrame, windows: DataFrame) -> DataFrame:
    """(movie_id, brand, first_index, n): brands whose window of years holds the release; an unknown year meets unbounded windows only.

    companies: (movie_id, year, position, company); windows: (company, brand, first, last), a small registry; null bounds are open.
    """
    met = companies.join(F.broadcast(windows), "company")
    inside = (F.col("first").isNull() | (F.col("year") >= F.col("first"))) & (F.col("last").isNull() | (F.col("year") <= F.col("last")))
    return met.where(F.coalesce(inside, F.lit(False))).groupBy("movie_id", "brand").agg(F.min("position").alias("first_index"), F.count(F.lit(1)).alias("n"))


def positioned_variants(names: DataFrame) -> DataFrame:
    """(movie_id, position, variant): normal forms of an ordered list of names, with their hyphen variants under one position."""
    clean = F.array_distinct(F.transform("names", T.normalize_ascii))
    placed = names.select("movie_id", F.posexplode(F.filter(clean, lambda n: n != "")).alias("position", "name"))
    return placed.select("movie_id", (F.col("position") + 1).alias("position"), F.explode(T.hyphen_variants(F.col("name"))).alias("variant"))


def nearest_scores(scored: DataFrame, threshold: float, n: int) -> DataFrame:
    """The n items at or below a threshold that are nearest to it, and the n above; two bounded top-n reads."""
    below = scored.where(F.col("score") <= threshold).orderBy(F.desc("score"), F.desc("movie_id")).limit(n)
    above = scored.where(F.col("score") > threshold).orderBy("score", "movie_id").limit(n)
    return below.unionByName(above)


def zero_crossings(curve: DataFrame) -> DataFrame:
    """(x): where y changes sign between neighbouring points, by linear interpolation. curve: (x, y), a histogram-sized table."""
    order = Window.orderBy("x")
    d = curve.withColumn("nx", F.lead("x").over(order)).withColumn("ny", F.lead("y").over(order)).where(F.col("ny").isNotNull() & (F.signum("y") != F.signum("ny")))
    return d.select((F.col("x") - F.col("y") * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))).alias("x"))


def embedding_texts(d: DataFrame) -> DataFrame:
    """Texts for the anchor, plot and production spaces. Columns: movie_id, title, original_title, overview, genres, themes, rating, synopsis, summaries, locations, techniques."""
    c = F.col
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    listed = lambda column: F.array_join(F.transform(column, T.normalize_ascii), ", ")
    other = F.when(c("original_title") != c("title"), F.lower("original_title"))
    anchor = F.concat_ws("\n", line("title", F.lower("title")), line("original_title", other), line("identity_overview", F.lower("overview")), line("genre_signatures", listed("genres")), line("themes", listed("themes")), line("maturity_summary", F.lower("rating")))
    longest = F.array_max(F.transform("summaries", lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s"))))["s"]
    plot = F.lower(F.coalesce(F.when(c("synopsis") != "", c("synopsis")), longest, c("overview")))
    animated = F.exists("genres", lambda g: F.lower(g) == "animation")
    places = F.when(~animated & (F.size("locations") > 0), F.concat(F.lit("filming_locations: "), F.lower(F.array_join(F.slice("locations", 1, 3), ", "))))
    production = F.concat_ws("\n", places, line("production_techniques", c("techniques")))
    return d.select("movie_id", anchor.alias("anchor"), plot.alias("plot"), F.when(production != "", production).alias("production"))


# Registered queries.


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def ingest_provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys read from JSON documents; every seventh has no US region, every eleventh is broken."""
    m, s = F.col("movie_id"), F.col("size")
    offer = lambda a: F.array(F.struct((s % a).cast("int").alias("provider_id")), F.struct((m % 3).cast("int").alias("provider_id")))
    region = F.struct(offer(4).alias("flatrate"), offer(5).alias("rent"))
    body = F.when(m % 11 == 0, F.lit("{broken")).when(m % 7 == 0, F.to_json(F.struct(F.struct(region.alias("GB")).alias("results")))).otherwise(F.to_json(F.struct(F.struct(region.alias("US")).alias("results"))))
    return _raw(spark, sf_dir).select("movie_id", F.array_join(provider_keys(body), ",").alias("keys"))


def ingest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("movie_id"), F.col("size")
    d = _raw(spark, sf_dir).select(
        "movie_id",
        F.when(m % 17 != 0, 1915 + m % 115).alias("year"),
        first_positive(F.when(m % 3 != 0, m * 40_000 - 1_000_000), s * 500_000).alias("budget"),
        first_positive(m * 90_000 - 9_000_000, F.when(m % 5 != 0, s * 1_000_000)).alias("gross"),
        F.when(m % 4 != 0, s / 5.0).alias("rating"),
        F.when(m % 6 != 0, m % 101).alias("critics"),
        F.element_at(F.array(*map(F.lit, [*RATINGS, "TV-14"])), (m % 6 + 1).cast("int")).alias("certificate"),
        F.when(m % 8 == 0, F.array(F.lit("Rated for tests"), F.lit("and more"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(m % 5 == 0, F.array(F.struct(F.lit("mild").alias("severity"), F.lit("noise").alias("category")))).otherwise(F.array().cast("array<struct<severity:string,category:string>>")).alias("guide"),
    )
    c = F.col
    return d.select(
        "movie_id",
        "budget",
        "gross",
        F.round(reception_score(c("rating"), c("critics")), 6).alias("reception"),
        box_office(c("year"), c("budget"), c("gross")).alias("box_office"),
        budget_bucket(c("year"), c("budget")).alias("budget_bucket"),
        decade_label(c("year")).alias("decade"),
        rating_rank(c("certificate")).alias("rank"),
        maturity_summary(c("certificate"), c("reasons"), c("guide")).alias("maturity"),
    )


def ingest_export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("movie_id")
    reason = export_reason(m % 9 == 0, F.when(m % 5 != 1, m % 4 == 0), F.when(m % 7 != 0, (F.col("size") - 10).cast("double")))
    return _raw(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources merged, each lacking some items; per origin: items, text characters and attributes present."""
    raw = _raw(spark, sf_dir)
    m = F.col("movie_id")
    details = raw.where(m % 4 != 0).select("movie_id", F.char_length("title").alias("overview_length"), F.when(m % 3 == 0, m).alias("detail_budget"))
    scraped = raw.where(m % 5 != 0).select("movie_id", F.when(m % 2 == 0, F.char_length("type")).otherwise(0).alias("overview"), F.when(m % 7 == 0, m).alias("scraped_budget"))
    d = merged_sources(details, scraped)
    chars = F.when(F.col("overview") > 0, F.col("overview")).otherwise(F.coalesce("overview_length", F.lit(0)))
    present = F.coalesce("scraped_budget", "detail_budget").isNotNull().cast("int") + (chars > 0).cast("int")
    return d.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(chars > 0, chars)).alias("characters"), F.sum(present).alias("present"))


def ingest_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_awards(C.awards(spark, sf_dir)).groupBy("ceremony", "won").agg(F.count(F.lit(1)).alias("n"))


WINDOWS = [("Brand#11", "one", None, None), ("Brand#12", "one", 1993, 1995), ("Brand#12", "two", 1994, None), ("Brand#13", "two", None, 1993)]


def ingest_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = C.cards(spark, sf_dir).select("movie_id", F.when(F.col("movie_id") % 10 != 0, F.year(F.timestamp_seconds("released"))).alias("year"), (F.col("movie_id") % 3).alias("position"), "company")
    return brands_of(cards, spark.createDataFrame(WINDOWS, "company string, brand string, first int, last int"))


def ingest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of two names an item: its title with a hyphen, and its brand."""
    d = _raw(spark, sf_dir).select("movie_id", F.array(F.regexp_replace("title", "^(\\S+) ", "$1-"), F.col("brand"), F.lit("..."), F.col("brand")).alias("names"))
    return positioned_variants(d)


def ingest_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.cards(spark, sf_dir).select("movie_id", F.col("reception").alias("score"))
    return nearest_scores(scored, 50.0, 20)


def ingest_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the number of items per vote count crosses its mean."""
    histogram = C.cards(spark, sf_dir).groupBy(F.col("votes").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    mean = histogram.agg((F.sum("n") / F.count(F.lit(1))).alias("mean"))
    return zero_crossings(histogram.crossJoin(F.broadcast(mean)).select("x", (F.col("n") - F.col("mean")).alias("y"))).select(C.r6(F.col("x")).alias("x"))


def ingest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("movie_id")
    words = F.split("title", " ")
    d = _raw(spark, sf_dir).select(
        "movie_id",
        "title",
        F.when(m % 3 == 0, F.concat("title", F.lit(" X"))).otherwise(F.col("title")).alias("original_title"),
        F.when(m % 4 != 0, F.col("type")).alias("overview"),
        F.when(m % 5 == 0, F.array(F.lit("Animation"), F.lit("Sci-Fi"))).otherwise(F.array(F.lit("Drama"))).alias("genres"),
        F.slice(words, 1, 2).alias("themes"),
        F.when(m % 2 == 0, F.lit("Restricted")).alias("rating"),
        F.when(m % 6 == 0, F.concat(F.lit("Long "), "title")).otherwise("").alias("synopsis"),
        F.when(m % 7 != 0, F.array(F.col("brand"), F.concat("brand", F.lit(" and more")))).otherwise(F.array().cast("array<string>")).alias("summaries"),
        F.array(F.lit("Paris"), F.col("brand"), F.lit("Rome"), F.lit("Oslo")).alias("locations"),
        F.when(m % 9 == 0, F.lit("cgi")).alias("techniques"),
    )
    return embedding_texts(d)


def _era_sql(side: int) -> str:
    decades = sorted(ERAS)
    at = f"greatest({decades[0]}, least(year, {decades[-1]}))"
    cases = " ".join(f"WHEN {at} < {low + 10} THEN {ERAS[low][side]} + {(ERAS[low + 10][side] - ERAS[low][side]) / 10}::DOUBLE * ({at} - {low})" for low in decades[:-1])
    return f"CASE {cases} ELSE {ERAS[decades[-1]][side]} END"


_K = lambda p, method: f"({p}) * 16 + {method}"
_DETAILS = f"""WITH d AS (SELECT p_partkey AS m, p_size AS s, CASE WHEN p_partkey % 17 <> 0 THEN 1915 + p_partkey % 115 END AS year,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey * 40000 - 1000000 > 0 THEN p_partkey * 40000 - 1000000 ELSE p_size * 500000 END AS budget,
  CASE WHEN p_partkey * 90000 - 9000000 > 0 THEN p_partkey * 90000 - 9000000 WHEN p_partkey % 5 <> 0 THEN p_size * 1000000 END AS gross,
  CASE WHEN p_partkey % 4 <> 0 THEN p_size / 5.0::DOUBLE END AS rating, CASE WHEN p_partkey % 6 <> 0 THEN nullif(p_partkey % 101, 0) END AS critics,
  {[*RATINGS, "TV-14"]}[p_partkey % 6 + 1] AS cert FROM part)
SELECT m AS movie_id, budget, gross, round(coalesce(4 * rating + 0.6::DOUBLE * critics, 10 * rating, critics), 6) AS reception,
  CASE WHEN year >= 1980 AND gross > 0 THEN CASE WHEN gross / budget::DOUBLE >= 3 AND budget >= 1000000 THEN 'hit' WHEN gross / budget::DOUBLE <= 1 THEN 'flop' END END AS box_office,
  CASE WHEN year IS NULL THEN NULL WHEN budget < {_era_sql(0)} THEN 'small' WHEN budget > {_era_sql(1)} THEN 'large' END AS budget_bucket,
  CASE WHEN year IS NULL THEN '' ELSE 'Release date: ' || (year // 10 * 10) || 's, ' || CASE WHEN year < 1930 THEN 'silent era & early cinema' WHEN year < 1950 THEN 'golden age of hollywood' ELSE right(CAST(year // 10 * 10 AS VARCHAR), 2) || 's' END END AS decade,
  coalesce(list_position({list(RATINGS)}, cert), 999) AS rank,
  CASE WHEN m % 8 = 0 THEN 'Rated for tests, and more' WHEN m % 5 = 0 THEN cert || ' — mild noise' ELSE CASE cert {" ".join(f"WHEN '{k}' THEN '{k} — {v}'" for k, v in RATINGS.items())} END END AS maturity FROM d"""
_MERGE = """WITH a AS (SELECT p_partkey AS m, length(p_name) AS ol, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS db FROM part WHERE p_partkey % 4 <> 0),
b AS (SELECT p_partkey AS m, CASE WHEN p_partkey % 2 = 0 THEN length(p_type) ELSE 0 END AS o, CASE WHEN p_partkey % 7 = 0 THEN p_partkey END AS sb, 1 AS f FROM part WHERE p_partkey % 5 <> 0),
d AS (SELECT CASE WHEN ol IS NOT NULL AND f IS NOT NULL THEN 'both' WHEN ol IS NOT NULL THEN 'detail' ELSE 'scraped' END AS origin, CASE WHEN o > 0 THEN o ELSE coalesce(ol, 0) END AS c, coalesce(sb, db) AS b FROM a FULL JOIN b USING (m))
SELECT origin, count(*) AS n, CAST(sum(CASE WHEN c > 0 THEN c END) AS BIGINT) AS characters, CAST(sum((b IS NOT NULL)::INT + (c > 0)::INT) AS BIGINT) AS present FROM d GROUP BY 1"""
_BRANDS = f"""WITH{C.CARDS}, c AS (SELECT movie_id, CASE WHEN movie_id % 10 <> 0 THEN year(make_timestamp(released * 1000000)) END AS year, movie_id % 3 AS position, company FROM cards),
w AS (SELECT * FROM (VALUES ('Brand#11', 'one', NULL, NULL), ('Brand#12', 'one', 1993, 1995), ('Brand#12', 'two', 1994, NULL), ('Brand#13', 'two', NULL, 1993)) v(company, brand, f, l))
SELECT movie_id, brand, min(position) AS first_index, count(*) AS n FROM c JOIN w USING (company) WHERE (f IS NULL OR year >= f) AND (l IS NULL OR year <= l) GROUP BY 1, 2"""
_POSITIONS = """WITH n AS (SELECT p_partkey AS movie_id, regexp_replace(lower(p_name), '^(\\S+) ', '\\1-') AS a, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9_ -]', ' ', 'g'), ' +', ' ', 'g')) AS b FROM part),
v AS (SELECT movie_id, 1 AS position, unnest([a, replace(a, '-', ' '), replace(a, '-', '')]) AS variant FROM n UNION ALL SELECT movie_id, 2, b FROM n) SELECT DISTINCT * FROM v"""
_TEXTS = """WITH d AS (SELECT p_partkey AS m, lower(p_name) AS t, lower(p_type) AS o, p_brand AS b, string_split(lower(p_name), ' ')[1:2] AS th FROM part)
SELECT m AS movie_id, 'title: ' || t || CASE WHEN m % 3 = 0 THEN chr(10) || 'original_title: ' || t || ' x' ELSE '' END || CASE WHEN m % 4 <> 0 THEN chr(10) || 'identity_overview: ' || o ELSE '' END
  || chr(10) || 'genre_signatures: ' || CASE WHEN m % 5 = 0 THEN 'animation, sci-fi' ELSE 'drama' END || chr(10) || 'themes: ' || array_to_string(th, ', ') || CASE WHEN m % 2 = 0 THEN chr(10) || 'maturity_summary: restricted' ELSE '' END AS anchor,
  CASE WHEN m % 6 = 0 THEN 'long ' || t WHEN m % 7 <> 0 THEN lower(b) || ' and more' WHEN m % 4 <> 0 THEN o END AS plot,
  nullif(concat_ws(chr(10), CASE WHEN m % 5 <> 0 THEN 'filming_locations: paris, ' || lower(b) || ', rome' END, CASE WHEN m % 9 = 0 THEN 'production_techniques: cgi' END), '') AS production FROM d"""
QUERIES = {
    "ingest_provider_keys": (ingest_provider_keys, f"SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([{_K('p_size % 4', 1)}, {_K('p_partkey % 3', 1)}, {_K('p_size % 5', 3)}, {_K('p_partkey % 3', 3)}])), ',') END AS keys FROM part"),
    "ingest_details": (ingest_details, _DETAILS),
    "ingest_export_filter": (ingest_export_filter, "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'adult' WHEN p_partkey % 5 <> 1 AND p_partkey % 4 = 0 THEN 'video' WHEN p_partkey % 7 = 0 OR p_size <= 10 THEN 'zero_popularity' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1"),
    "ingest_merge": (ingest_merge, _MERGE),
    "ingest_awards": (ingest_awards, f"WITH{C.AWARDS}, d AS (SELECT movie_id, ceremony, year, bool_or(won) AS won FROM awards GROUP BY 1, 2, 3) SELECT ceremony, won, count(*) AS n FROM d GROUP BY 1, 2"),
    "ingest_brands": (ingest_brands, _BRANDS),
    "ingest_positions": (ingest_positions, _POSITIONS),
    "ingest_nearest": (ingest_nearest, f"WITH{C.CARDS}, b AS (SELECT movie_id, reception AS score FROM cards WHERE reception <= 50 ORDER BY 2 DESC, 1 DESC LIMIT 20), a AS (SELECT movie_id, reception AS score FROM cards WHERE reception > 50 ORDER BY 2, 1 LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b"),
    "ingest_crossings": (ingest_crossings, f"WITH{C.CARDS}, h AS (SELECT votes::DOUBLE AS x, count(*) AS n FROM cards GROUP BY 1), c AS (SELECT x, n - (SELECT sum(n) / count(*) FROM h) AS y FROM h), l AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM c) SELECT round(x - y * (nx - x) / (ny - y), 6) AS x FROM l WHERE ny IS NOT NULL AND sign(y) <> sign(ny)"),
    "ingest_texts": (ingest_texts, _TEXTS),
}
