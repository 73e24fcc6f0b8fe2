"""Endpoint executors: each gives (movie_id, score) of natural matches, or one row per restricted item with 0 where it has none.

Executors are functions of DataFrames; `restrict` is a DataFrame of movie_id, filters are predicates on the cards and reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from . import preferences as P

# The roles of people, ceremony 10 (left out unless it is named), the scores of franchise hits, the score below which
# a generator's row is dropped, and the rows of a call without a bounded column.
ROLES = C.ROLES
RAZZIE = 10
UNIVERSE_ONLY = 0.75
LEAST_GENERATED = 0.01
UNBOUNDED_LIMIT = 5000
TOKEN_CEILING = 323


def restricted(scores: DataFrame, restrict: DataFrame | None) -> DataFrame:
    """Natural matches, or every restricted item with its score or 0."""
    if restrict is None:
        return scores.select("movie_id", "score")
    return restrict.select("movie_id").distinct().join(scores.select("movie_id", "score"), "movie_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def max_merge(parts: list[DataFrame]) -> DataFrame:
    """The best score of each item over score tables."""
    return reduce(DataFrame.unionByName, [p.select("movie_id", "score") for p in parts]).groupBy("movie_id").agg(F.max("score").alias("score"))


def dealbreaker_floor(raw: Column) -> Column:
    """Raises a generator's score to the upper half of 0..1."""
    return 0.5 + 0.5 * S.clamp(raw)


# People and characters.


def role_postings(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """(term, movie_id[, position, cast_size]) credits of a role; only actors have places."""
    own = C.credits(spark, sf_dir).where(F.col("role") == role)
    return own.select("term", "movie_id", "position", "cast_size") if role == "actor" else own.select("term", "movie_id")


def billing(postings: DataFrame) -> DataFrame:
    """Adds zone, place within it, and the four prominence curves of every credit."""
    lead, support = S.zone_cutoffs(F.col("cast_size"))
    d = postings.withColumn("lead_to", lead).withColumn("support_to", support)
    p = F.col("position")
    d = d.withColumn("zone", F.when(p <= F.col("lead_to"), "lead").when(p <= F.col("support_to"), "supporting").otherwise("minor"))
    start = F.when(p <= F.col("lead_to"), 1).when(p <= F.col("support_to"), F.col("lead_to") + 1).otherwise(F.col("support_to") + 1)
    end = F.when(p <= F.col("lead_to"), F.col("lead_to")).when(p <= F.col("support_to"), F.col("support_to")).otherwise(F.col("cast_size"))
    d = d.withColumn("place", F.when(end - start <= 0, 0.0).otherwise((p - start) / (end - start)))
    return d.select("*", *[curve(mode).alias(f"as_{mode}") for mode in CURVES])


# Score at the start of each zone and its change to the zone's end, by mode.
CURVES = {
    "default": {"lead": (1.0, 0.0), "supporting": (0.85, -0.15), "minor": (0.7, -0.2)},
    "lead": {"lead": (1.0, 0.0), "supporting": (0.6, -0.2), "minor": (0.4, -0.2)},
    "supporting": {"lead": (0.7, -0.1), "supporting": (1.0, 0.0), "minor": (0.6, -0.25)},
    "minor": {"lead": (0.35, -0.1), "supporting": (0.5, -0.15), "minor": (0.7, 0.3)},
}


def curve(mode: str) -> Column:
    """Prominence of a credit by its zone and its place in it."""
    start = lambda zone: CURVES[mode][zone][0] + CURVES[mode][zone][1] * F.col("place")
    return F.when(F.col("zone") == "lead", start("lead")).when(F.col("zone") == "supporting", start("supporting")).otherwise(start("minor"))


def person_scores(spark: SparkSession, sf_dir: str, terms: list[int], role: str = "unknown", mode: str = "default", restrict: DataFrame | None = None) -> DataFrame:
    """Items of the people named: actors by their prominence, other roles 1; an unknown role takes the best of all five."""
    rows = C.credits(spark, sf_dir).where(F.col("term").isin(terms))
    rows = billing(rows if role == "unknown" else rows.where(F.col("role") == role))
    score = F.when(F.col("role") == "actor", F.col(f"as_{mode}")).otherwise(1.0)
    return restricted(rows.groupBy("movie_id").agg(F.max(score).alias("score")), restrict)


def character_scores(spark: SparkSession, sf_dir: str, terms: list[int], central: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    score = S.character_central(F.col("position")) if central else S.character_default(F.col("position"), F.col("cast_size"))
    found = C.person_postings(spark, sf_dir).where(F.col("term").isin(terms)).groupBy("movie_id").agg(F.max(score).alias("score"))
    return restricted(found, restrict)


# Awards.


def award_search(awards: DataFrame, ceremonies: list[int] | None = None, won: bool | None = None, years: tuple[int, int] | None = None, mark: int = 1, floor: bool = True) -> DataFrame:
    """Items by their number of award rows: 1 from mark on, or the share of mark reached. Ceremony 10 counts only if it is named."""
    rows = awards.where(F.col("ceremony").isin(ceremonies)) if ceremonies else awards.where(F.col("ceremony") != RAZZIE)
    if won is not None:
        rows = rows.where(F.col("won") == won)
    if years is not None:
        rows = rows.where(F.col("year").between(*years))
    counted = rows.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("n") >= mark, 1.0).otherwise(0.0) if floor else F.least("n", F.lit(mark)) / float(mark)
    return counted.select("movie_id", score.alias("score")).where("score > 0")


def award_scores(searches: list[DataFrame], average: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    """Several award searches: the best score, or their mean with 0 where a search has none."""
    if not average:
        return restricted(max_merge(searches), restrict)
    total = reduce(DataFrame.unionByName, searches).groupBy("movie_id").agg((F.sum("score") / float(len(searches))).alias("score"))
    return restricted(total, restrict)


# Franchises.


def franchise_hits(cards: DataFrame, entries: list[int], subgroups: list[int] | None = None, mainline: bool = False) -> DataFrame:
    """(movie_id, lineage): items with an entry in their lineage (true), or in their universe only (false)."""
    lineage, universe = P._any_of(F.col("lineage_ids"), entries), P._any_of(F.col("universe_ids"), entries)
    rows = cards.where(lineage | universe)
    if subgroups:
        rows = rows.where(P._any_of(F.col("subgroup_ids"), subgroups))
    if mainline:
        rows = rows.where(~F.coalesce("is_spinoff", F.lit(False)))
    return rows.select("movie_id", lineage.alias("lineage"))


def franchise_scores(hits: DataFrame, prefer_lineage: bool = True, restrict: DataFrame | None = None) -> DataFrame:
    """1 for lineage hits; universe-only ones get .75 if lineage is preferred and some item has it, else 1."""
    if not prefer_lineage:
        return restricted(hits.select("movie_id", F.lit(1.0).alias("score")), restrict)
    some = hits.agg(F.coalesce(F.bool_or("lineage"), F.lit(False)).alias("some"))
    scored = hits.crossJoin(F.broadcast(some)).select("movie_id", F.when(F.col("lineage") | ~F.col("some"), 1.0).otherwise(UNIVERSE_ONLY).alias("score"))
    return restricted(scored, restrict)


# Studios.


def company_tokens(cards: DataFrame) -> DataFrame:
    """(company, token) of every company name."""
    return cards.select("company").distinct().select("company", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("company"), "[^a-z0-9]+", " "), " "))).alias("token")).where("token <> ''")


def companies_of(tokens: DataFrame, names: DataFrame, ceiling: int = TOKEN_CEILING) -> DataFrame:
    """(name, company): companies that hold all tokens of a name; a token of more than `ceiling` companies makes its name unresolvable.

    names: (name, token, wanted), wanted being the name's number of tokens.
    """
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= ceiling)
    hits = tokens.join(frequent, "token").join(F.broadcast(names), "token").groupBy("name", "wanted", "company").agg(F.countDistinct("token").alias("held"))
    return hits.where("held = wanted").select("name", "company")


def studio_scores(cards: DataFrame, named: DataFrame, refs: int, every: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    """ANY: 1 for items of a named company; ALL: the share of the names that an item's companies match."""
    matched = cards.select("movie_id", "company").join(named, "company").groupBy("movie_id").agg(F.countDistinct("name").alias("n"))
    return restricted(matched.select("movie_id", (F.col("n") / float(refs) if every else F.lit(1.0)).alias("score")), restrict)


# Keywords, media types, order of release, trends.


def keyword_scores(cards: DataFrame, keywords: list[int], sources: list[int], tags: list[int], every: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    """ANY: 1 with a hit in one of three id arrays; ALL: distinct hits over ids asked for."""
    hits = P._hits(F.col("keyword_ids"), keywords) + P._hits(F.col("source_ids"), sources) + P._hits(F.col("tag_ids"), tags)
    wanted = float(len(set(keywords)) + len(set(sources)) + len(set(tags)))
    found = cards.withColumn("n", hits).where("n > 0")
    return restricted(found.select("movie_id", (F.col("n") / wanted if every else F.lit(1.0)).alias("score")), restrict)


def media_type_scores(cards: DataFrame, formats: list[int], restrict: DataFrame | None = None) -> DataFrame:
    return restricted(cards.where(F.col("release_format").isin(formats)).select("movie_id", F.lit(1.0).alias("score")), restrict)


def chronological_scores(pool: DataFrame, newest: bool = True) -> DataFrame:
    """Dense rank of release within a pool over its number of dates less 1; one date scores 1, an unknown date 0."""
    dates = pool.where("released IS NOT NULL").select("released").distinct()
    order = F.col("released") if newest else F.desc("released")
    ranked = dates.withColumn("rank", F.dense_rank().over(Window.orderBy(order)))
    last = ranked.agg(F.max("rank").alias("last"))
    d = pool.join(ranked, "released", "left").crossJoin(F.broadcast(last))
    return d.select("movie_id", F.when(F.col("rank").isNull(), 0.0).when(F.col("last") == 1, 1.0).otherwise((F.col("rank") - 1) / (F.col("last") - 1)).alias("score"))


def trending_scores(trend: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """As a generator, positive scores in the upper half; restricted, raw scores."""
    if restrict is not None:
        return restricted(trend, restrict)
    return trend.where("score > 0").select("movie_id", dealbreaker_floor(F.col("score")).alias("score"))


# Metadata columns.


class ColumnCall:
    """A metadata column asked for: its gate, its score, and, if nothing bounds it, its sort signal."""

    def __init__(self, name: str, score: Column, gate: Column | None = None, signal: Column | None = None):
        self.name, self.score, self.gate, self.signal = name, score, gate, signal


def release_call(operation: str, first: str, second: str | None = None) -> ColumnCall:
    low, high, grace = P.date_window(operation, first, second)
    value, reach = F.col("released").cast("double"), grace * S.DAY
    return ColumnCall("released", P.window_score(value, low, high, reach), _within(value, low - reach, high + reach))


def runtime_call(operation: str, first: float, second: float | None = None) -> ColumnCall:
    low, high = P.number_window(operation, first, second)
    value = F.col("runtime").cast("double")
    return ColumnCall("runtime", P.window_score(value, low, high, P.RUNTIME_GRACE), _within(value, low - P.RUNTIME_GRACE, high + P.RUNTIME_GRACE))


def _within(value: Column, low: float, high: float) -> Column:
    gate = value.isNotNull()
    gate = gate & (value >= low) if low != -P.INFINITE else gate
    return gate & (value <= high) if high != P.INFINITE else gate


def maturity_call(operation: str, rank: int) -> ColumnCall:
    value = F.col("maturity_rank")
    if rank == P.UNRATED and operation == "exact":
        return ColumnCall("maturity", P.maturity_score(value, rank, rank, unrated=True), value == P.UNRATED)
    low, high = P.rank_window(operation, rank)
    return ColumnCall("maturity", P.maturity_score(value, low, high), value.isNotNull() & (value != P.UNRATED) & value.between(max(1, low - 1), min(P.MOST_RANK, high + 1)))


def streaming_call(providers: list[int], methods: list[int], access: int | None = None) -> ColumnCall:
    keys = F.col("offer_keys")
    any_key, desired = P.offer_keys(providers, methods), P.offer_keys(providers, [access]) if access and providers else []
    gate = P._any_of(keys, any_key) if any_key else F.exists(keys, lambda k: k.bitwiseAND(15) == access)
    return ColumnCall("streaming", P.providers_score(keys, [], any_key, desired, None if providers else access), gate)


def country_call(ids: list[int], dealbreaker: bool) -> ColumnCall:
    score = S.position_gate(F.col("country_ids"), ids) if dealbreaker else S.position_preference(F.col("country_ids"), ids)
    return ColumnCall("country", score, P._any_of(F.col("country_ids"), ids))


def language_call(ids: list[int]) -> ColumnCall:
    return ColumnCall("language", P.language_score(F.col("language_ids"), ids, []), P._any_of(F.col("language_ids"), ids))


def budget_call(bucket: str) -> ColumnCall:
    return ColumnCall("budget", P.budget_score(F.col("budget_bucket"), bucket), F.col("budget_bucket") == bucket)


def popularity_call(niche: bool = False) -> ColumnCall:
    p = F.coalesce("popularity", F.lit(0.0))
    return ColumnCall("popularity", S.popularity_mode(F.col("popularity"), niche), signal=1 - p if niche else p)


def reception_call(poor: bool = False) -> ColumnCall:
    """The score is a sigmoid, the sort signal a ramp."""
    return ColumnCall("reception", S.reception_mode(F.col("reception"), poor), signal=P.reception_ramp(F.col("reception"), poor))


def metadata_scores(cards: DataFrame, calls: list[ColumnCall], every: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    """ANY: the best column's score, ALL: their mean. A generator takes the items that pass one gate, or the best UNBOUNDED_LIMIT by their signals if no call has one."""
    score = sum((c.score for c in calls), F.lit(0.0)) / float(len(calls)) if every else F.greatest(F.lit(0.0), *[c.score for c in calls])
    if restrict is not None:
        return restricted(cards.join(restrict, "movie_id", "left_semi").select("movie_id", score.alias("score")), restrict)
    gates = [c.gate for c in calls if c.gate is not None]
    if gates:
        rows = cards.where(reduce(lambda a, b: a | b, gates))
    else:
        signals = [c.signal for c in calls]
        order = sum(signals, F.lit(0.0)) if every else F.greatest(F.lit(0.0), *signals)
        rows = cards.orderBy(F.desc(order), F.desc("movie_id")).limit(UNBOUNDED_LIMIT)
    return rows.select("movie_id", score.alias("score")).where(F.col("score") >= LEAST_GENERATED)


# Registered queries.


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").where("p_partkey % 7 = 3").select(F.col("p_partkey").alias("movie_id"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.select("movie_id", C.r6(F.col("score")).alias("score"))


def entity_actor_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three actors under each prominence mode."""
    d = billing(C.person_postings(spark, sf_dir).where(F.col("term").isin(1, 2, 3)))
    return d.groupBy("movie_id").agg(*[C.r6(F.max(f"as_{mode}")).alias(mode) for mode in CURVES])


def entity_person_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(person_scores(spark, sf_dir, [4, 5], mode="lead"))


def entity_person_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(person_scores(spark, sf_dir, [4, 5], "director", restrict=_pool(spark, sf_dir)))


def entity_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, central = character_scores(spark, sf_dir, [6, 7]), character_scores(spark, sf_dir, [6, 7], central=True, restrict=_pool(spark, sf_dir))
    return _rounded(plain).withColumn("kind", F.lit("default")).unionByName(_rounded(central).withColumn("kind", F.lit("central restricted")))


def award_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of two searches, and their mean over a pool."""
    a = C.awards(spark, sf_dir)
    searches = [award_search(a, won=True, mark=2), award_search(a, [RAZZIE, 3], years=(1993, 1996), mark=4, floor=False)]
    best, mean = award_scores(searches), award_scores(searches, average=True, restrict=_pool(spark, sf_dir))
    return _rounded(best).withColumn("kind", F.lit("any")).unionByName(_rounded(mean).withColumn("kind", F.lit("average restricted")))


def franchise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = franchise_hits(C.cards(spark, sf_dir), [3, 4], mainline=True)
    return _rounded(franchise_scores(hits)).withColumn("kind", F.lit("any")).unionByName(_rounded(franchise_scores(hits, prefer_lineage=False, restrict=_pool(spark, sf_dir))).withColumn("kind", F.lit("restricted")))


STUDIOS = ("brand 2", "brand 3", "nowhere brand")


def studio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of studios named in free text: tokens are looked up, and a name needs all of its own."""
    cards = C.cards(spark, sf_dir)
    tokens = C.table(spark, sf_dir, "part").select(F.col("p_brand").alias("company"))
    names = spark.createDataFrame([(n, t, len(set(n.split()))) for n in STUDIOS for t in sorted(set(n.split()))], "name string, token string, wanted long")
    spaced = tokens.distinct().withColumn("company_text", F.regexp_replace(F.lower("company"), "([a-z])(#|[0-9])", "$1 $2"))
    tokens = spaced.select("company", F.explode(F.array_distinct(F.split(F.regexp_replace("company_text", "[^a-z0-9]+", " "), " "))).alias("token")).where("token <> ''")
    tokens = tokens.unionByName(tokens.where("token RLIKE '^[0-9]+$'").withColumn("token", F.substring("token", 1, 1))).distinct()
    named = companies_of(tokens, names)
    any_of, every = studio_scores(cards, named, len(STUDIOS)), studio_scores(cards, named, len(STUDIOS), every=True, restrict=_pool(spark, sf_dir))
    return _rounded(any_of).withColumn("kind", F.lit("any")).unionByName(_rounded(every).withColumn("kind", F.lit("all restricted")))


def keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = C.cards(spark, sf_dir)
    any_of, every = keyword_scores(cards, [1, 5, 9], [2], [3, 9]), keyword_scores(cards, [1, 5, 9], [2], [3, 9], every=True, restrict=_pool(spark, sf_dir))
    return _rounded(any_of).withColumn("kind", F.lit("any")).unionByName(_rounded(every).withColumn("kind", F.lit("all restricted")))


def media_type_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = C.cards(spark, sf_dir)
    return _rounded(media_type_scores(cards, [2, 3])).withColumn("kind", F.lit("any")).unionByName(_rounded(media_type_scores(cards, [2, 3], _pool(spark, sf_dir))).withColumn("kind", F.lit("restricted")))


def chronological_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest and oldest first within a pool; items without a card have no date."""
    pool = _pool(spark, sf_dir).join(C.cards(spark, sf_dir).select("movie_id", "released"), "movie_id", "left")
    return _rounded(chronological_scores(pool)).withColumnRenamed("score", "newest").join(_rounded(chronological_scores(pool, newest=False)).withColumnRenamed("score", "oldest"), "movie_id")


def trending_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = C.trend(spark, sf_dir).select("movie_id", "score")
    return _rounded(trending_scores(trend)).withColumn("kind", F.lit("generator")).unionByName(_rounded(trending_scores(trend, _pool(spark, sf_dir))).withColumn("kind", F.lit("restricted")))


def metadata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bounded columns, any of which may pass, and their mean over a pool."""
    cards = C.cards(spark, sf_dir)
    calls = [release_call("after", "1997-06-01"), runtime_call("between", 44, 48), maturity_call(">=", 5), streaming_call([2], [1, 2, 3], 1), budget_call("large"), language_call([3]), country_call([1], False)]
    best, mean = metadata_scores(cards, calls[:5]), metadata_scores(cards, calls, every=True, restrict=_pool(spark, sf_dir))
    return _rounded(best).withColumn("kind", F.lit("any")).unionByName(_rounded(mean).withColumn("kind", F.lit("all restricted")))


def metadata_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity and reception bound nothing: the best UNBOUNDED_LIMIT items by their signals."""
    return _rounded(metadata_scores(C.cards(spark, sf_dir), [popularity_call(), reception_call()]))


_W = "WITH"
_POOL = "pool AS (SELECT p_partkey AS movie_id FROM part WHERE p_partkey % 7 = 3)"
_ZONES = (
    C.POSTINGS
    + """, z1 AS (SELECT *, least(cast_size, greatest(2, CAST(round_even(0.6::DOUBLE * sqrt(cast_size), 0) AS INT))) AS lt FROM postings),
z2 AS (SELECT *, least(cast_size, greatest(lt + 1, CAST(round_even(sqrt(cast_size), 0) AS INT))) AS st FROM z1),
z3 AS (SELECT *, CASE WHEN position <= lt THEN 'lead' WHEN position <= st THEN 'supporting' ELSE 'minor' END AS zone,
  CASE WHEN position <= lt THEN 1 WHEN position <= st THEN lt + 1 ELSE st + 1 END AS a, CASE WHEN position <= lt THEN lt WHEN position <= st THEN st ELSE cast_size END AS b FROM z2),
zones AS (SELECT *, CASE WHEN b - a <= 0 THEN 0::DOUBLE ELSE (position - a)::DOUBLE / (b - a) END AS place FROM z3)"""
)


def _curve_sql(mode: str) -> str:
    c = CURVES[mode]
    part = lambda zone: f"{c[zone][0]}::DOUBLE + {c[zone][1]}::DOUBLE * place"
    return f"max(CASE zone WHEN 'lead' THEN {part('lead')} WHEN 'supporting' THEN {part('supporting')} ELSE {part('minor')} END)"


def _fill(scores: str, kind: str) -> str:
    return f"SELECT movie_id, round(coalesce(score, 0), 6) AS score, '{kind}' AS kind FROM pool LEFT JOIN ({scores}) USING (movie_id)"


_AWARD = """, s1 AS (SELECT movie_id, 1::DOUBLE AS score FROM awards WHERE ceremony <> 10 AND won GROUP BY 1 HAVING count(*) >= 2),
s2 AS (SELECT movie_id, least(count(*), 4) / 4::DOUBLE AS score FROM awards WHERE ceremony IN (3, 10) AND year BETWEEN 1993 AND 1996 GROUP BY 1), both_s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)"""
_FRANCHISE = """, f AS (SELECT movie_id, list_has_any(lineage_ids, [3, 4]) AS lineage FROM cards
  WHERE (list_has_any(lineage_ids, [3, 4]) OR list_has_any(universe_ids, [3, 4])) AND NOT coalesce(is_spinoff, false))"""
_HITS = "len(list_intersect(keyword_ids, [1, 5, 9])) + len(list_intersect(source_ids, [2])) + len(list_intersect(tag_ids, [3, 9]))"
_LATE = P.epoch("1997-06-01")
_OFFERS, _OFFERS_1 = P.offer_keys([2], [1, 2, 3]), P.offer_keys([2], [1])
_COLUMNS = f""", c AS (SELECT movie_id, {P._window_sql("released", _LATE, 1e18, P.OPEN_DATE_GRACE * S.DAY)} AS c1, {P._window_sql("runtime", 44, 48, 30)} AS c2,
  CASE WHEN maturity_rank = 5 THEN 1::DOUBLE WHEN maturity_rank = 4 THEN 0.5 ELSE 0 END AS c3,
  CASE WHEN list_has_any(offer_keys, {_OFFERS_1}) THEN 1::DOUBLE WHEN list_has_any(offer_keys, {_OFFERS}) THEN 0.5 ELSE 0 END AS c4,
  CASE WHEN budget_bucket = 'large' THEN 1::DOUBLE ELSE 0 END AS c5, CASE WHEN list_contains(language_ids, 3) THEN 1::DOUBLE ELSE 0 END AS c6,
  coalesce(exp((1 - list_position(country_ids, 1)) / 1.3::DOUBLE), 0) AS c7 FROM cards)"""
# Chip brands are named Brand#NM; a studio's tokens are its word, its number and the number's first digit.
_STUDIO = """, b AS (SELECT DISTINCT p_brand AS company, regexp_extract(lower(p_brand), '([0-9]+)', 1) AS d FROM part),
named AS (SELECT 'brand ' || substr(d, 1, 1) AS name, company FROM b WHERE substr(d, 1, 1) IN ('2', '3') AND starts_with(lower(company), 'brand')
  UNION SELECT 'brand ' || d, company FROM b WHERE d IN ('2', '3')),
m AS (SELECT movie_id, count(DISTINCT name) AS n FROM cards JOIN named USING (company) GROUP BY 1)"""
QUERIES = {
    "entity_actor_modes": (entity_actor_modes, f"{_W}{_ZONES} SELECT movie_id, {', '.join(f'round({_curve_sql(m)}, 6) AS "{m}"' for m in CURVES)} FROM zones WHERE term IN (1, 2, 3) GROUP BY 1"),
    "entity_person_unknown": (entity_person_unknown, f"{_W}{_ZONES}, a AS (SELECT movie_id, {_curve_sql('lead')} AS score FROM zones WHERE term IN (4, 5) GROUP BY 1 UNION ALL SELECT DISTINCT l_partkey, 1.0::DOUBLE FROM lineitem WHERE l_suppkey IN (4, 5) AND l_linenumber BETWEEN 1 AND 4) SELECT movie_id, round(max(score), 6) AS score FROM a GROUP BY 1"),
    "entity_person_restricted": (entity_person_restricted, f"{_W} {_POOL} SELECT movie_id, CASE WHEN movie_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (4, 5) AND l_linenumber = 1) THEN 1::DOUBLE ELSE 0 END AS score FROM pool"),
    "entity_character": (entity_character, f"{_W}{C.POSTINGS}, {_POOL} SELECT movie_id, round(max(1 - (position - 1)::DOUBLE / greatest(1, cast_size - 1)), 6) AS score, 'default' AS kind FROM postings WHERE term IN (6, 7) GROUP BY 1 UNION ALL " + _fill("SELECT movie_id, max(greatest(0, 1 - 0.15::DOUBLE * greatest(0, position - 2))) AS score FROM postings WHERE term IN (6, 7) GROUP BY 1", "central restricted")),
    "award_query": (award_query, f"{_W}{C.AWARDS}, {_POOL}{_AWARD} SELECT movie_id, round(max(score), 6) AS score, 'any' AS kind FROM both_s GROUP BY 1 UNION ALL " + _fill("SELECT movie_id, sum(score) / 2 AS score FROM both_s GROUP BY 1", "average restricted")),
    "franchise_query": (franchise_query, f"{_W}{C.CARDS}, {_POOL}{_FRANCHISE} SELECT movie_id, CASE WHEN lineage OR NOT (SELECT coalesce(bool_or(lineage), false) FROM f) THEN 1::DOUBLE ELSE 0.75 END AS score, 'any' AS kind FROM f UNION ALL " + _fill("SELECT movie_id, 1::DOUBLE AS score FROM f", "restricted")),
    "studio_query": (studio_query, f"{_W}{C.CARDS}, {_POOL}{_STUDIO} SELECT movie_id, 1::DOUBLE AS score, 'any' AS kind FROM m UNION ALL " + _fill("SELECT movie_id, n / 3::DOUBLE AS score FROM m", "all restricted")),
    "keyword_query": (keyword_query, f"{_W}{C.CARDS}, {_POOL}, h AS (SELECT movie_id, {_HITS} AS n FROM cards) SELECT movie_id, 1::DOUBLE AS score, 'any' AS kind FROM h WHERE n > 0 UNION ALL " + _fill("SELECT movie_id, n / 6::DOUBLE AS score FROM h WHERE n > 0", "all restricted")),
    "media_type_query": (media_type_query, f"{_W}{C.CARDS}, {_POOL} SELECT movie_id, 1::DOUBLE AS score, 'any' AS kind FROM cards WHERE release_format IN (2, 3) UNION ALL " + _fill("SELECT movie_id, 1::DOUBLE AS score FROM cards WHERE release_format IN (2, 3)", "restricted")),
    "chronological_query": (chronological_query, f"{_W}{C.CARDS}, {_POOL}, p AS (SELECT movie_id, released FROM pool LEFT JOIN cards USING (movie_id)), d AS (SELECT released, dense_rank() OVER (ORDER BY released) AS up, dense_rank() OVER (ORDER BY released DESC) AS down FROM (SELECT DISTINCT released FROM p WHERE released IS NOT NULL)), n AS (SELECT max(up) AS last FROM d) SELECT movie_id, round(CASE WHEN up IS NULL THEN 0 WHEN last = 1 THEN 1 ELSE (up - 1)::DOUBLE / (last - 1) END, 6) AS newest, round(CASE WHEN up IS NULL THEN 0 WHEN last = 1 THEN 1 ELSE (down - 1)::DOUBLE / (last - 1) END, 6) AS oldest FROM p LEFT JOIN d USING (released), n"),
    "trending_query": (trending_query, f"{_W} {_POOL}, c AS (SELECT user_id AS movie_id, count(*) AS events FROM events GROUP BY 1), r AS (SELECT movie_id, 1 - sqrt((row_number() OVER (ORDER BY events DESC, movie_id) - 1)::DOUBLE / count(*) OVER ()) AS score FROM c) SELECT movie_id, round(0.5::DOUBLE + 0.5::DOUBLE * score, 6) AS score, 'generator' AS kind FROM r WHERE score > 0 UNION ALL " + _fill("SELECT * FROM r", "restricted")),
    "metadata_query": (metadata_query, f"{_W}{C.CARDS}, {_POOL}{_COLUMNS} SELECT movie_id, round(greatest(c1, c2, c3, c4, c5), 6) AS score, 'any' AS kind FROM c WHERE greatest(c1, c2, c3, c4, c5) >= 0.01 UNION ALL " + _fill("SELECT movie_id, (c1 + c2 + c3 + c4 + c5 + c6 + c7) / 7 AS score FROM c", "all restricted")),
    "metadata_unbounded": (metadata_unbounded, f"{_W}{C.CARDS},{C.POPULAR}, s AS (SELECT movie_id, greatest(1 / (1 + exp(-12 * (popularity - 0.70))), 1 / (1 + exp(-0.22 * (reception - 70)))) AS score FROM popular ORDER BY greatest(popularity, least(greatest((reception - 55) / 40, 0), 1)) DESC, movie_id DESC LIMIT 5000) SELECT movie_id, round(score, 6) AS score FROM s WHERE score >= 0.01"),
}
