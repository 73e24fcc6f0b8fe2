"""Entity flows: people, exact and fuzzy titles, franchises with characters, studios, attributes with people, references to items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import endpoints as E
from ..operators import names as N
from ..operators import preferences as P
from ..operators.retrieval import eligible, hard_filter
from ..sources import catalogue as C
from .flows import neutral_prior

# Buckets of credits, scores of the exact-title flow, bounds of the fuzzy title search and of the character tiers.
MINOR_SPLIT = 0.5
SEED, LINEAGE_LINEAGE, LINEAGE_UNIVERSE, TITLE_ONLY, UNIVERSE_UNIVERSE, UNIVERSE_LINEAGE = 1.0, 0.75, 0.625, 0.5, 0.25, 0.125
CLOSE_FLOOR, CLOSE_SLOPE, CLOSE_YEAR_MISS, CLOSE_WORDS = 0.80, 0.15, 0.50, 0.6
FUZZY_LEAST, FUZZY_FILL, FUZZY_CHARS, TITLE_LIMIT = 0.45, 3, 3, 25
TOP_BILLED, PROMINENT, RELEVANT = 3, 0.70, 0.30
MOVIE_FORMAT = 1
LIMIT = 100


def person_buckets(spark: SparkSession, sf_dir: str, people: list[int]) -> DataFrame:
    """(term, movie_id, bucket): 1 lead, 2 major, 3 relevant, 4 minor, by billing zone; other roles count as lead. The best per person and item."""
    d = E.billing(C.credits(spark, sf_dir).where(F.col("term").isin(people)))
    bucket = F.when((F.col("role") != "actor") | (F.col("zone") == "lead"), 1).when(F.col("zone") == "supporting", 2).when(F.col("place") <= MINOR_SPLIT, 3).otherwise(4)
    return d.groupBy("term", "movie_id").agg(F.min(bucket).alias("bucket"))


def people_search(spark: SparkSession, sf_dir: str, people: list[int], limit: int = LIMIT, filters: dict | None = None) -> DataFrame:
    """Items that pass the hard filters by their best bucket over the people, then by how many of them they credit, then by popularity."""
    found = person_buckets(spark, sf_dir, people).groupBy("movie_id").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("people"))
    found = eligible(found, C.cards(spark, sf_dir), filters)
    d = found.join(C.cards(spark, sf_dir).select("movie_id", C.r6(F.col("popularity")).alias("popularity")), "movie_id")
    return d.orderBy("bucket", F.desc("people"), F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(limit)


def attribute_search(spark: SparkSession, sf_dir: str, people: list[int], limit: int = LIMIT) -> DataFrame:
    """Items by the sum of 5 - bucket over the people asked for, then popularity."""
    found = person_buckets(spark, sf_dir, people).groupBy("movie_id").agg(F.sum(5 - F.col("bucket")).alias("weight"))
    d = found.join(C.cards(spark, sf_dir).select("movie_id", C.r6(F.col("popularity")).alias("popularity")), "movie_id")
    return d.orderBy(F.desc("weight"), F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(limit)


def best_score(parts: list[DataFrame]) -> DataFrame:
    """(movie_id, score, source): the best score of each item with its source; of equal scores the earlier part's."""
    tagged = [p.select("movie_id", "score", "source", F.lit(-i).alias("at")) for i, p in enumerate(parts)]
    best = F.max_by(F.struct("score", "source"), F.struct("score", "at"))
    return reduce(DataFrame.unionByName, tagged).groupBy("movie_id").agg(best.alias("x")).select("movie_id", "x.score", "x.source")


def exact_title(cards: DataFrame, title: str, year: int | None = None) -> DataFrame:
    """Items of exactly this title (and year), close titles that hold all its words, and the franchises of the seeds.

    Seeds keep 1 whatever else they match; franchise hits of the seeds' lineage go before those of their universe.
    """
    wanted = T.fold_text(title)
    words = list(dict.fromkeys(wanted.split()))
    d = cards.withColumn("year", F.year(F.timestamp_seconds("released")))
    right_year = F.lit(True) if year is None else F.coalesce(F.col("year") == year, F.lit(False))
    same = d.where(F.col("normal") == wanted)
    seeds = same.where(right_year)
    exact = same.select("movie_id", F.when(right_year, SEED).otherwise(TITLE_ONLY).alias("score"), F.when(right_year, "seed").otherwise("title_only").alias("source"))
    held = F.array_distinct(F.split("normal", " "))
    ratio = len(words) / F.size(held)
    near = d.where((F.col("normal") != wanted) & (F.size(F.array_intersect(held, F.array(*map(F.lit, words)))) == len(words)) & (T.word_similarity(F.lit(wanted), F.col("normal")) >= CLOSE_WORDS))
    close = near.select("movie_id", ((CLOSE_FLOOR + CLOSE_SLOPE * ratio) * F.when(right_year, 1.0).otherwise(CLOSE_YEAR_MISS)).alias("score"), F.when(right_year, "close").otherwise("close_other_year").alias("source"))
    # Entries of the seeds are few: an aggregate of one row, broadcast.
    entries = seeds.agg(F.array_distinct(F.flatten(F.collect_list("lineage_ids"))).alias("seed_lineage"), F.array_distinct(F.flatten(F.collect_list("universe_ids"))).alias("seed_universe"), F.collect_set("movie_id").alias("seed_ids"))
    fan = d.crossJoin(F.broadcast(entries)).where(~F.array_contains("seed_ids", F.col("movie_id")))
    own, wide = lambda c: F.arrays_overlap("lineage_ids", c), lambda c: F.arrays_overlap("universe_ids", c)
    scored = F.greatest(
        F.when(own("seed_lineage"), LINEAGE_LINEAGE).when(wide("seed_lineage"), LINEAGE_UNIVERSE).otherwise(0.0),
        F.when(own("seed_universe"), UNIVERSE_LINEAGE).when(wide("seed_universe"), UNIVERSE_UNIVERSE).otherwise(0.0),
    )
    kin = fan.withColumn("score", scored).where("score > 0").select("movie_id", "score", F.lit("franchise").alias("source"))
    return best_score([exact, close, kin])


def title_search(cards: DataFrame, query: str, limit: int = TITLE_LIMIT, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(movie_id, tier, likeness): titles that begin a title or a word with the query, then those that hold it, then, if there are three or fewer, similar ones.

    index: the trigrams of the titles and their counts, with which only candidates are compared; without it every title is.
    """
    wanted = T.fold_text(query)
    if not wanted:
        return cards.where("false").select("movie_id", F.lit(0).alias("tier"), F.lit(0.0).alias("likeness"))
    d = neutral_prior(cards)
    tier = F.when(F.col("normal").startswith(wanted) | F.contains("normal", F.lit(" " + wanted)), 1).when(F.contains("normal", F.lit(wanted)), 2)
    exact = d.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("likeness", F.lit(1.0))
    found = exact
    if len(wanted) >= FUZZY_CHARS:
        if index is None:
            alike = d.withColumn("likeness", C.r6(T.word_similarity(F.lit(wanted), F.col("normal")))).where(F.col("likeness") >= FUZZY_LEAST)
        else:
            asked = cards.sparkSession.createDataFrame([(0, wanted)], "place int, normal string")
            near = N.similar_titles(asked, *index, FUZZY_LEAST).select("normal", C.r6(F.col("likeness")).alias("likeness"))
            alike = d.join(near, "normal")
        filled = exact.limit(FUZZY_FILL + 1).agg((F.count(F.lit(1)) > FUZZY_FILL).alias("_filled"))
        fuzzy = alike.withColumn("tier", F.when(tier.isNull(), 3)).where("tier IS NOT NULL").crossJoin(F.broadcast(filled)).where("NOT _filled")
        found = exact.unionByName(fuzzy.select(*exact.columns))
    return found.orderBy("tier", F.desc("likeness"), F.char_length("normal"), F.desc("prior"), F.desc("movie_id")).limit(limit).select("movie_id", "tier", "likeness")


def franchise_list(cards: DataFrame, entries: list[int], limit: int = LIMIT) -> DataFrame:
    """Items of a franchise without a character: lineage first, then universe, each by popularity."""
    hits = E.franchise_hits(cards, entries)
    d = hits.join(cards.select("movie_id", C.r6(F.col("popularity")).alias("popularity")), "movie_id").withColumn("bucket", F.when(F.col("lineage"), 1).otherwise(2))
    return d.orderBy("bucket", F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(limit).select("movie_id", "bucket", "popularity")


def character_tiers(cards: DataFrame, postings: DataFrame, entries: list[int], characters: list[int], limit: int = LIMIT) -> DataFrame:
    """Seven tiers: mainline of the franchise, top-billed appearances, the franchise's rest, its universe, then appearances by prominence."""
    hits = E.franchise_hits(cards, entries)
    signals = postings.where(F.col("term").isin(characters)).groupBy("movie_id").agg(F.min("position").alias("best"), F.max(1 - (F.col("position") - 1) / F.greatest(F.lit(1), F.col("cast_size") - 1)).alias("prominence"))
    d = cards.select("movie_id", "is_spinoff", "release_format", C.r6(F.col("popularity")).alias("popularity")).join(hits, "movie_id", "left").join(signals, "movie_id", "left")
    mainline = ~F.coalesce("is_spinoff", F.lit(False)) & (F.col("release_format") == MOVIE_FORMAT)
    prominence = C.r6(F.col("prominence"))
    tier = (
        F.when(F.col("lineage") & mainline, 1)
        .when(F.col("lineage"), 3)
        .when(F.col("lineage").isNotNull(), 4)
        .when(F.col("best") <= TOP_BILLED, 2)
        .when(prominence >= PROMINENT, 5)
        .when(prominence >= RELEVANT, 6)
        .when(F.col("best").isNotNull(), 7)
    )
    return d.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(limit).select("movie_id", "tier", "popularity")


def studio_list(cards: DataFrame, companies: list[str], limit: int = LIMIT) -> DataFrame:
    d = cards.where(F.col("company").isin(companies)).select("movie_id", "company", C.r6(F.col("popularity")).alias("popularity"))
    return d.orderBy(F.desc_nulls_last("popularity"), F.desc("movie_id")).limit(limit)


def resolve_references(cards: DataFrame, references: DataFrame) -> DataFrame:
    """(place, movie_id) of title references with an optional year: of equal titles the most popular, best received, newest, lowest id. Unknown ones are left out.

    references: (place, title, year), the titles in normal form; a small stated table.
    """
    d = cards.select("movie_id", "normal", "pct", "reception", F.year(F.timestamp_seconds("released")).alias("released_in"))
    met = d.join(F.broadcast(references), F.col("normal") == F.col("title")).where("year IS NULL OR year = released_in")
    best = F.max_by("movie_id", F.struct(F.coalesce("pct", F.lit(-1.0)), F.coalesce("reception", F.lit(-1.0)), F.coalesce("released_in", F.lit(-1)), -F.col("movie_id")))
    return met.groupBy("place").agg(best.alias("movie_id")).groupBy("movie_id").agg(F.min("place").alias("place"))


# Registered queries.

PEOPLE = [1, 2, 3, 4]


def flow_people_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people_search(spark, sf_dir, PEOPLE)


def join_person_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bucket of every credit of the people named and its weight, 5 - bucket."""
    return person_buckets(spark, sf_dir, PEOPLE).withColumn("weight", 5 - F.col("bucket"))


def flow_attribute_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_search(spark, sf_dir, PEOPLE)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir)


def flow_exact_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of item 12, which other items have too, in its year; ids and scores."""
    cards = C.cards(spark, sf_dir)
    head = cards.where("movie_id = 12").select("title", F.year(F.timestamp_seconds("released")).alias("y")).first()
    return exact_title(cards, head["title"], head["y"]).select("movie_id", C.r6(F.col("score")).alias("score"), "source")


def flow_title_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_search(_titled(spark, sf_dir), "Bolt")


def flow_title_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt query without an exact hit, by the trigram index."""
    return title_search(_titled(spark, sf_dir), "bollt", index=(N.title_trigrams(spark, sf_dir), N.trigram_counts(spark, sf_dir)))


FILTERS = {"released": (None, 820454400), "runtime": (4, None), "genres": [1, 2, 3], "countries": [1, 5, 9, 14, 20]}


def flow_filtered_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people flow under hard filters."""
    return people_search(spark, sf_dir, PEOPLE, filters=FILTERS)


def flow_filtered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title flow under hard filters."""
    return title_search(hard_filter(_titled(spark, sf_dir), **FILTERS), "Bolt")


def flow_franchise_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return franchise_list(_titled(spark, sf_dir), [3, 4])


def flow_character_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return character_tiers(_titled(spark, sf_dir), C.person_postings(spark, sf_dir), [3], [5, 6], 400)


def flow_studio_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studio_list(_titled(spark, sf_dir), ["Brand#11", "Brand#12", "Brand#13"])


def flow_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the titles of four items, one twice and one unknown."""
    cards = C.cards(spark, sf_dir)
    known = cards.where(F.col("movie_id").isin(3, 8, 12, 20)).select(F.col("movie_id").cast("int").alias("place"), F.col("normal").alias("title"), F.when(F.col("movie_id") == 8, F.year(F.timestamp_seconds("released"))).alias("year"))
    unknown = spark.createDataFrame([(99, "no such title", None)], "place int, title string, year int")
    return resolve_references(cards, known.unionByName(unknown))


def filters_fingerprint(filters: dict) -> Column:
    """A stable digest of active hard filters: equal for equal sets of values, whatever their order; null if none is active."""
    active = {k: sorted(v) if isinstance(v, list | tuple | set) and k != "released" else v for k, v in sorted(filters.items()) if v}
    return F.hex(F.xxhash64(F.lit(repr(active)))) if active else F.lit(None).cast("string")


_B = f"""WITH{C.CARDS},{C.POPULAR},{E._ZONES},
cred AS (SELECT term, movie_id, CASE WHEN zone = 'lead' THEN 1 WHEN zone = 'supporting' THEN 2 WHEN place <= 0.5 THEN 3 ELSE 4 END AS bucket FROM zones WHERE term IN (1, 2, 3, 4)
  UNION ALL SELECT l_suppkey, l_partkey, 1 FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4) AND l_linenumber BETWEEN 1 AND 4),
best AS (SELECT term, movie_id, min(bucket) AS bucket FROM cred GROUP BY 1, 2)"""
_N = f"WITH{C.CARDS},{C.POPULAR}, n AS (SELECT *, trim(lower(title)) AS normal, round(0.8::DOUBLE * popularity + 0.2::DOUBLE * least(greatest(reception / 100, 0), 1), 6) AS prior FROM popular)"
_GRAMS = lambda t: f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(string_split({t}, ' '), lambda x: x <> '')]))"
_LIKE = lambda q, t: f"len(list_intersect({_GRAMS(q)}, {_GRAMS(t)}))::DOUBLE / len({_GRAMS(q)})"
_HEAD = "(SELECT normal FROM y WHERE movie_id = 12)"
_EXACT = f"""WITH{C.CARDS}, y AS (SELECT *, trim(lower(title)) AS normal, year(make_timestamp(released * 1000000)) AS year FROM cards), h AS (SELECT normal AS q, year AS qy FROM y WHERE movie_id = 12),
seeds AS (SELECT y.* FROM y, h WHERE normal = q AND year = qy),
ent AS (SELECT list_distinct(flatten(list(lineage_ids))) AS sl, list_distinct(flatten(list(universe_ids))) AS su FROM seeds),
p AS (SELECT movie_id, CASE WHEN year = qy THEN 1::DOUBLE ELSE 0.5 END AS score, CASE WHEN year = qy THEN 'seed' ELSE 'title_only' END AS source, 0 AS part FROM y, h WHERE normal = q
  UNION ALL SELECT movie_id, (0.8::DOUBLE + 0.15::DOUBLE * len(list_distinct(string_split(q, ' '))) / len(list_distinct(string_split(normal, ' ')))) * CASE WHEN year = qy THEN 1 ELSE 0.5 END, CASE WHEN year = qy THEN 'close' ELSE 'close_other_year' END, -1 FROM y, h
    WHERE normal <> q AND list_has_all(string_split(normal, ' '), string_split(q, ' '))
  UNION ALL SELECT movie_id, greatest(CASE WHEN list_has_any(lineage_ids, sl) THEN 0.75 WHEN list_has_any(universe_ids, sl) THEN 0.625 ELSE 0 END, CASE WHEN list_has_any(lineage_ids, su) THEN 0.125 WHEN list_has_any(universe_ids, su) THEN 0.25 ELSE 0 END)::DOUBLE, 'franchise', -2
    FROM y, ent WHERE movie_id NOT IN (SELECT movie_id FROM seeds) AND (list_has_any(lineage_ids, sl || su) OR list_has_any(universe_ids, sl || su)))
SELECT movie_id, round(score, 6) AS score, source FROM p QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, part DESC) = 1"""
_TIERS = f"""WITH{C.CARDS},{C.POPULAR},{C.POSTINGS}, s AS (SELECT movie_id, min(position) AS best, round(max(1 - (position - 1)::DOUBLE / greatest(1, cast_size - 1)), 6) AS prom FROM postings WHERE term IN (5, 6) GROUP BY 1),
t AS (SELECT movie_id, round(popularity, 6) AS popularity, CASE WHEN list_contains(lineage_ids, 3) AND NOT coalesce(is_spinoff, false) AND release_format = 1 THEN 1 WHEN list_contains(lineage_ids, 3) THEN 3 WHEN list_contains(universe_ids, 3) THEN 4
  WHEN best <= 3 THEN 2 WHEN prom >= 0.7 THEN 5 WHEN prom >= 0.3 THEN 6 WHEN best IS NOT NULL THEN 7 END AS tier FROM popular LEFT JOIN s USING (movie_id))
SELECT movie_id, tier, popularity FROM t WHERE tier IS NOT NULL ORDER BY tier, popularity DESC, movie_id DESC LIMIT 400"""
_REFS = f"""WITH{C.CARDS}, p AS (SELECT movie_id, trim(lower(title)) AS normal, percent_rank() OVER (ORDER BY votes) AS pct, reception, year(make_timestamp(released * 1000000)) AS y FROM cards),
r AS (SELECT movie_id AS place, normal, CASE WHEN movie_id = 8 THEN y END AS year FROM p WHERE movie_id IN (3, 8, 12, 20)),
b AS (SELECT place, p.movie_id FROM p JOIN r USING (normal) WHERE year IS NULL OR year = y QUALIFY row_number() OVER (PARTITION BY place ORDER BY pct DESC, reception DESC, y DESC, p.movie_id) = 1)
SELECT movie_id, min(place) AS place FROM b GROUP BY 1"""
_FIT = "released <= 820454400 AND runtime >= 4 AND list_has_any(genre_ids, [1, 2, 3]) AND list_has_any(country_ids, [1, 5, 9, 14, 20])"
QUERIES = {
    "flow_filtered_people": (
        flow_filtered_people,
        f"""{_B}, g AS (SELECT movie_id, min(bucket) AS bucket, count(*) AS people FROM best GROUP BY 1)
        SELECT movie_id, bucket, people, round(popularity, 6) AS popularity FROM g JOIN popular USING (movie_id) WHERE {_FIT} ORDER BY bucket, people DESC, 4 DESC, movie_id DESC LIMIT 100""",
    ),
    "flow_filtered_titles": (
        flow_filtered_titles,
        f"""{_N}, t AS (SELECT *, CASE WHEN starts_with(normal, 'bolt') OR contains(normal, ' bolt') THEN 1 ELSE 2 END AS tier FROM n WHERE contains(normal, 'bolt') AND {_FIT})
        SELECT movie_id, tier, 1::DOUBLE AS likeness FROM t ORDER BY tier, length(normal), prior DESC, movie_id DESC LIMIT 25""",
    ),
    "flow_people_search": (flow_people_search, f"{_B}, g AS (SELECT movie_id, min(bucket) AS bucket, count(*) AS people FROM best GROUP BY 1) SELECT movie_id, bucket, people, round(popularity, 6) AS popularity FROM g JOIN popular USING (movie_id) ORDER BY bucket, people DESC, 4 DESC, movie_id DESC LIMIT 100"),
    "join_person_buckets": (join_person_buckets, f"{_B} SELECT term, movie_id, bucket, 5 - bucket AS weight FROM best"),
    "flow_attribute_people": (flow_attribute_people, f"{_B}, g AS (SELECT movie_id, CAST(sum(5 - bucket) AS BIGINT) AS weight FROM best GROUP BY 1) SELECT movie_id, weight, round(popularity, 6) AS popularity FROM g JOIN popular USING (movie_id) ORDER BY weight DESC, 3 DESC, movie_id DESC LIMIT 100"),
    "flow_exact_title": (flow_exact_title, _EXACT),
    "flow_title_tiers": (flow_title_tiers, f"{_N}, t AS (SELECT *, CASE WHEN starts_with(normal, 'bolt') OR contains(normal, ' bolt') THEN 1 ELSE 2 END AS tier FROM n WHERE contains(normal, 'bolt')) SELECT movie_id, tier, 1::DOUBLE AS likeness FROM t ORDER BY tier, length(normal), prior DESC, movie_id DESC LIMIT 25"),
    "flow_title_fuzzy": (flow_title_fuzzy, f"{_N}, t AS (SELECT *, round({_LIKE(chr(39) + 'bollt' + chr(39), 'normal')}, 6) AS likeness FROM n) SELECT movie_id, 3 AS tier, likeness FROM t WHERE likeness >= 0.45 ORDER BY likeness DESC, length(normal), prior DESC, movie_id DESC LIMIT 25"),
    "flow_franchise_list": (flow_franchise_list, f"WITH{C.CARDS},{C.POPULAR} SELECT movie_id, CASE WHEN list_has_any(lineage_ids, [3, 4]) THEN 1 ELSE 2 END AS bucket, round(popularity, 6) AS popularity FROM popular WHERE list_has_any(lineage_ids, [3, 4]) OR list_has_any(universe_ids, [3, 4]) ORDER BY bucket, 3 DESC, movie_id DESC LIMIT 100"),
    "flow_character_tiers": (flow_character_tiers, _TIERS),
    "flow_studio_list": (flow_studio_list, f"WITH{C.CARDS},{C.POPULAR} SELECT movie_id, company, round(popularity, 6) AS popularity FROM popular WHERE company IN ('Brand#11', 'Brand#12', 'Brand#13') ORDER BY 3 DESC, movie_id DESC LIMIT 100"),
    "flow_references": (flow_references, _REFS),
}
