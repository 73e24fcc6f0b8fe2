"""Scans, hard filters, posting joins, counts, derived tables and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from .funnel import RUNTIME_BUCKETS, bucket

#: Title phrases that join_title_phrase looks for.
PHRASES = ("large ring", "bolt hot", "blue", "ring no_such_token")
COMBINED = {"released": (None, 820454400), "runtime": (4, None), "maturity": (None, 4), "genres": [1, 2, 3], "languages": [0, 3], "offers": [17, 33, 34], "countries": [1, 5, 9, 14, 20]}
RELEASED = (694224000, 820454400)  # 1992-01-01, 1996-01-01 UTC


def _holds_any(column: str, ids: list[int]) -> Column:
    return F.exists(column, lambda x: x.isin(list(ids)))


def filter_condition(released=None, runtime=None, maturity=None, genres=None, keywords=None, languages=None, offers=None, countries=None) -> Column | None:
    """One predicate of all active filters, or None. Ranges are (low, high), either of which may be None; lists want any of their ids. A null value fails a filter on it."""
    parts = []
    for column, bounds in (("released", released), ("runtime", runtime), ("maturity_rank", maturity)):
        low, high = bounds or (None, None)
        parts += [F.col(column) >= low] if low is not None else []
        parts += [F.col(column) <= high] if high is not None else []
    for column, ids in (("genre_ids", genres), ("keyword_ids", keywords), ("language_ids", languages), ("offer_keys", offers), ("country_ids", countries)):
        parts += [_holds_any(column, ids)] if ids else []
    return reduce(lambda a, b: a & b, parts) if parts else None


def hard_filter(cards: DataFrame, released=None, runtime=None, maturity=None, **lists) -> DataFrame:
    """Rows that pass every filter of filter_condition."""
    condition = filter_condition(released, runtime, maturity, **lists)
    return cards if condition is None else cards.where(condition)


def eligible(found: DataFrame, cards: DataFrame, filters: dict | None) -> DataFrame:
    """Rows of found (movie_id, ...) whose item passes the filters; all rows if none is active."""
    condition = filter_condition(**(filters or {}))
    return found if condition is None else found.join(cards.where(condition).select("movie_id"), "movie_id", "left_semi")


def scan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir).select("movie_id", "title", "company", "format", "runtime", "maturity_rank", "votes", "reception", "released", F.size("keyword_ids").cast("long").alias("n_keywords"), F.size("genre_ids").cast("long").alias("n_genres"))


def scan_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: rows, rows with properties, users, and the sum of property k, read from the JSON by path; other values of k count as null."""
    return C.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"), F.countDistinct("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total_k"))


def filter_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_filter(C.cards(spark, sf_dir), RELEASED, (5, 40), (1, 3)).select("movie_id", "runtime", "maturity_rank", "released")


def filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges open at one end, and lists of genres, languages, offers and countries, at once."""
    return hard_filter(C.cards(spark, sf_dir), **COMBINED).select("movie_id", "released", "runtime")


def hydrate(ids: DataFrame, cards: DataFrame, columns: list[str]) -> DataFrame:
    """(place, movie_id, columns) of the ids that are known, each at its own place; a repeated id is given at each of its places. ids: (place, movie_id)."""
    return ids.select("place", "movie_id").join(cards.select("movie_id", *columns), "movie_id").select("place", "movie_id", *columns)


def _asked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in an order of their own, some twice and some unknown."""
    part = C.table(spark, sf_dir, "part").where("p_partkey % 37 = 5")
    own = part.select((100_000 - F.col("p_partkey")).cast("long").alias("place"), F.col("p_partkey").alias("movie_id"))
    return own.unionByName(own.where("movie_id % 2 = 0").select((F.col("place") + 200_000).alias("place"), "movie_id")).unionByName(own.select((F.col("place") + 400_000).alias("place"), (F.col("movie_id") + 10_000_000).alias("movie_id")))


def hydrate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of ids in the order in which they were asked for."""
    return hydrate(_asked_ids(spark, sf_dir), C.cards(spark, sf_dir), ["title", "released", "runtime", "maturity_rank"])


def hydrate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reception, votes, popularity and percentile of the same ids."""
    d = hydrate(_asked_ids(spark, sf_dir), C.cards(spark, sf_dir), ["reception", "votes", "popularity", "pct"])
    return d.select("place", "movie_id", "reception", "votes", C.r6(F.col("popularity")).alias("popularity"), C.r6(F.col("pct")).alias("pct"))


def filter_any_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_filter(C.cards(spark, sf_dir), keywords=[1, 2, 3]).select("movie_id")


def filter_all_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir).where(F.size(F.array_intersect("genre_ids", F.array(F.lit(1), F.lit(2), F.lit(3)))) == 3).select("movie_id")


def filter_restrict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards among given ids (here: items of returned lines), as a semi-join."""
    ids = C.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("movie_id"))
    return C.cards(spark, sf_dir).join(ids, "movie_id", "left_semi").select("movie_id", "votes")


def join_compound_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, item, score): the share of each query's people that an item credits; query q is the people 3q+1..3q+3."""
    terms = spark.range(5).select(F.col("id").alias("query_idx"), F.explode(F.sequence(3 * F.col("id") + 1, 3 * F.col("id") + 3)).alias("term"))
    hits = C.person_postings(spark, sf_dir).join(F.broadcast(terms), "term").groupBy("query_idx", "movie_id").agg(F.countDistinct("term").alias("n"))
    return hits.select("query_idx", "movie_id", C.r6(F.col("n") / 3.0).alias("score"))


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, token): the distinct tokens of each title."""
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("token")).where("token <> ''")


def join_title_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase, item): titles that hold all distinct tokens of a phrase (relational division over token postings), whatever their frequency."""
    phrases = spark.createDataFrame([(p, t, len(set(p.split()))) for p in PHRASES for t in set(p.split())], "phrase string, token string, wanted long")
    hits = title_tokens(spark, sf_dir).join(F.broadcast(phrases), "token").groupBy("phrase", "movie_id", "wanted").agg(F.countDistinct("token").alias("held"))
    return hits.where("held = wanted").select("phrase", "movie_id")


def join_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per title: its tokens of a document frequency up to the studio ceiling, 323, and the least frequency; phrases are met by join_title_phrase."""
    tokens = title_tokens(spark, sf_dir)
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return tokens.join(frequent.where("df <= 323"), "token").groupBy("movie_id").agg(F.count(F.lit(1)).alias("tokens"), F.min("df").alias("rarest"))


def agg_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir).select(F.explode("keyword_ids").alias("keyword_id")).groupBy("keyword_id").agg(F.count(F.lit(1)).alias("df"))


def trait_idf(cards: DataFrame) -> DataFrame:
    """(kind, trait_id, df, idf): ln(N / df) / ln(N) over keyword and genre traits, exploded in one pass."""
    of = lambda column, kind: F.transform(F.col(column).cast("array<long>"), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("trait_id")))
    traits = cards.select(F.explode(F.concat(of("keyword_ids", "keyword"), of("genre_ids", "genre"))).alias("x")).select("x.*")
    total = cards.agg(F.count(F.lit(1)).alias("total"))
    counted = traits.groupBy("kind", "trait_id").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("kind", "trait_id", "df", (F.log(F.col("total") / F.col("df")) / F.log("total")).alias("idf"))


def agg_trait_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trait_idf(C.cards(spark, sf_dir)).withColumn("idf", C.r6(F.col("idf")))


def win_popularity_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir).select("movie_id", "votes", C.r6(F.col("popularity")).alias("popularity"))


def agg_director_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead people with two items or more: mean of 0.8 popularity + 0.2 reception."""
    lead = C.person_postings(spark, sf_dir).where("position = 1")
    rows = lead.join(C.cards(spark, sf_dir), "movie_id").groupBy("term")
    return rows.agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg(0.8 * F.col("popularity") + 0.2 * S.clamp(F.col("reception") / 100))).alias("strength")).where("n >= 2")


def agg_franchise_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company: mean popularity and its consistency, 1 for a single item."""
    spread = 1 - S.clamp(2 * F.stddev_samp("popularity"))
    return C.cards(spark, sf_dir).groupBy("company").agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("popularity")).alias("confidence"), C.r6(F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(spread)).alias("consistency"))


def agg_award_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and nominations per item without ceremony 10, and the tier: 1 with 3 wins, .75 with one, else 0."""
    rows = C.awards(spark, sf_dir).where("ceremony <> 10").groupBy("movie_id").agg(F.sum(F.col("won").cast("long")).alias("wins"), F.count(F.lit(1)).alias("entries"))
    return rows.withColumn("tier", F.when(F.col("wins") >= 3, 1.0).when(F.col("wins") >= 1, 0.75).otherwise(0.0)).withColumn("score", C.r6(F.least("wins", F.lit(5)) / 5.0))


def agg_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANY = 1, ALL = hits / n over wanted keywords and genres."""
    hits = F.size(F.array_intersect("keyword_ids", F.array(*[F.lit(x).cast("long") for x in (1, 5, 9)]))) + F.size(F.array_intersect("genre_ids", F.array(F.lit(2), F.lit(4))))
    return C.cards(spark, sf_dir).withColumn("hits", hits.cast("long")).where("hits > 0").select("movie_id", "hits", C.r6(F.col("hits") / 5.0).alias("share"))


def agg_survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items at or above each distinct vote count, from the histogram."""
    histogram = C.cards(spark, sf_dir).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    return histogram.select("votes", F.sum("n").over(Window.orderBy(F.desc("votes")).rowsBetween(Window.unboundedPreceding, 0)).alias("at_least"))


def agg_runtime_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(spark, sf_dir).groupBy(bucket(F.coalesce("runtime", F.lit(0)), RUNTIME_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("runtime").alias("least"), F.max("runtime").alias("most"))


def set_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two generators minus the short items; all three read the same cards, so they are one filter over one pass."""
    generated = (F.col("votes") >= 35) | (F.col("reception") >= 52)
    return C.cards(spark, sf_dir).where(generated & ~(F.col("runtime") <= 5)).select("movie_id")


def set_missing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id")).exceptAll(C.cards(spark, sf_dir).select("movie_id"))


_ = "WITH" + C.CARDS
_PHRASES = ", ".join(f"('{p}')" for p in PHRASES)
_T = """, traits AS (SELECT 'keyword' AS kind, CAST(unnest(keyword_ids) AS BIGINT) AS trait_id FROM cards UNION ALL SELECT 'genre', CAST(unnest(genre_ids) AS BIGINT) FROM cards)"""
_ASKED = """, own AS (SELECT 100000 - p_partkey AS place, p_partkey AS movie_id FROM part WHERE p_partkey % 37 = 5),
asked AS (SELECT * FROM own UNION ALL SELECT place + 200000, movie_id FROM own WHERE movie_id % 2 = 0 UNION ALL SELECT place + 400000, movie_id + 10000000 FROM own)"""
QUERIES = {
    "scan_cards": (scan_cards, _ + " SELECT movie_id, title, company, format, runtime, maturity_rank, votes, reception, released, len(keyword_ids) AS n_keywords, len(genre_ids) AS n_genres FROM cards"),
    "scan_events_json": (scan_events_json, "SELECT event_type, count(*) AS n, count(props) AS with_props, count(DISTINCT user_id) AS users, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1"),
    "filter_hard": (filter_hard, _ + f" SELECT movie_id, runtime, maturity_rank, released FROM cards WHERE released BETWEEN {RELEASED[0]} AND {RELEASED[1]} AND runtime BETWEEN 5 AND 40 AND maturity_rank BETWEEN 1 AND 3"),
    "hydrate_cards": (hydrate_cards, _ + _ASKED + " SELECT place, movie_id, title, released, runtime, maturity_rank FROM asked JOIN cards USING (movie_id)"),
    "hydrate_signals": (hydrate_signals, _ + "," + C.POPULAR + _ASKED + ", p AS (SELECT *, percent_rank() OVER (ORDER BY votes) AS pct FROM popular) SELECT place, movie_id, reception, votes, round(popularity, 6) AS popularity, round(pct, 6) AS pct FROM asked JOIN p USING (movie_id)"),
    "filter_combined": (
        filter_combined,
        _ + """ SELECT movie_id, released, runtime FROM cards WHERE released <= 820454400 AND runtime >= 4 AND maturity_rank <= 4 AND list_has_any(genre_ids, [1, 2, 3])
          AND list_has_any(language_ids, [0, 3]) AND list_has_any(offer_keys, [17, 33, 34]) AND list_has_any(country_ids, [1, 5, 9, 14, 20])""",
    ),
    "filter_any_overlap": (filter_any_overlap, _ + " SELECT movie_id FROM cards WHERE list_has_any(keyword_ids, [1, 2, 3])"),
    "filter_all_contained": (filter_all_contained, _ + " SELECT movie_id FROM cards WHERE list_has_all(genre_ids, [1, 2, 3])"),
    "filter_restrict_ids": (filter_restrict_ids, _ + " SELECT movie_id, votes FROM cards WHERE movie_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"),
    "join_compound_lexical": (join_compound_lexical, "WITH" + C.POSTINGS + " SELECT (term - 1) // 3 AS query_idx, movie_id, round(count(DISTINCT term) / 3.0::DOUBLE, 6) AS score FROM postings WHERE term BETWEEN 1 AND 15 GROUP BY 1, 2"),
    "join_title_tokens": (join_title_tokens, "WITH t AS (SELECT DISTINCT p_partkey AS movie_id, unnest(string_split(lower(p_name), ' ')) AS token FROM part), d AS (SELECT token, count(*) AS df FROM t WHERE token <> '' GROUP BY 1) SELECT movie_id, count(*) AS tokens, min(df) AS rarest FROM t JOIN d USING (token) WHERE df <= 323 GROUP BY 1"),
    "join_title_phrase": (join_title_phrase, f"SELECT phrase, p_partkey AS movie_id FROM part, (VALUES {_PHRASES}) AS v(phrase) WHERE list_has_all(string_split(lower(p_name), ' '), string_split(phrase, ' '))"),
    "agg_doc_frequency": (agg_doc_frequency, _ + " SELECT unnest(keyword_ids) AS keyword_id, count(*) AS df FROM cards GROUP BY 1"),
    "agg_trait_idf": (agg_trait_idf, _ + _T + " SELECT kind, trait_id, count(*) AS df, round(ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)), 6) AS idf FROM traits GROUP BY 1, 2"),
    "win_popularity_percentile": (win_popularity_percentile, _ + "," + C.POPULAR + " SELECT movie_id, votes, round(popularity, 6) AS popularity FROM popular"),
    "agg_director_strength": (agg_director_strength, _ + "," + C.POPULAR + "," + C.POSTINGS + " SELECT term, count(*) AS n, round(avg(0.8::DOUBLE * popularity + 0.2::DOUBLE * least(greatest(reception / 100, 0), 1)), 6) AS strength FROM postings JOIN popular USING (movie_id) WHERE position = 1 GROUP BY 1 HAVING count(*) >= 2"),
    "agg_franchise_confidence": (agg_franchise_confidence, _ + "," + C.POPULAR + " SELECT company, count(*) AS n, round(avg(popularity), 6) AS confidence, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 - least(greatest(2 * stddev_samp(popularity), 0), 1) END, 6) AS consistency FROM popular GROUP BY 1"),
    "agg_award_counts": (agg_award_counts, "WITH" + C.AWARDS + ", c AS (SELECT movie_id, CAST(sum(won::INT) AS BIGINT) AS wins, count(*) AS entries FROM awards WHERE ceremony <> 10 GROUP BY 1) SELECT *, CASE WHEN wins >= 3 THEN 1.0::DOUBLE WHEN wins >= 1 THEN 0.75 ELSE 0 END AS tier, round(least(wins, 5) / 5.0::DOUBLE, 6) AS score FROM c"),
    "agg_keyword_hits": (agg_keyword_hits, _ + ", h AS (SELECT movie_id, len(list_intersect(keyword_ids, [1, 5, 9])) + len(list_intersect(genre_ids, [2, 4])) AS hits FROM cards) SELECT movie_id, hits, round(hits / 5.0::DOUBLE, 6) AS share FROM h WHERE hits > 0"),
    "agg_survival_curve": (agg_survival_curve, _ + " SELECT votes, CAST(sum(count(*)) OVER (ORDER BY votes DESC) AS BIGINT) AS at_least FROM cards GROUP BY votes"),
    "agg_runtime_buckets": (agg_runtime_buckets, _ + " SELECT CASE WHEN coalesce(runtime, 0) = 0 THEN 'null_or_0' WHEN runtime <= 39 THEN '1_39' WHEN runtime <= 60 THEN '40_60' WHEN runtime <= 90 THEN '61_90' WHEN runtime <= 120 THEN '91_120' WHEN runtime <= 180 THEN '121_180' ELSE '181_plus' END AS bucket, count(*) AS n, min(runtime) AS least, max(runtime) AS most FROM cards GROUP BY 1"),
    "set_pool": (set_pool, _ + " SELECT movie_id FROM cards WHERE (votes >= 35 OR reception >= 52) AND NOT runtime <= 5"),
    "set_missing_cards": (set_missing_cards, _ + " SELECT p_partkey AS movie_id FROM part EXCEPT SELECT movie_id FROM cards"),
}
