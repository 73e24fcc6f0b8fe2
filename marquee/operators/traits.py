"""Trait scoring over a candidate pool: folds of calls and categories, negative traits, commitments, rarity and the final ranking.

Calls come as one long table (trait, category, call, movie_id, score); what a trait asks for is a small table of specs. A missing score counts as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from ..sources.store import written
from . import endpoints as E
from . import preferences as P

# Floors of both geometric means, commitments, the corpus size of rarity, the least pool, and the caps of the implicit priors.
FLOOR = 0.1
COMMITMENTS = {"required": 3.0, "elevated": 1.75, "neutral": 1.0, "supporting": 0.6, "diminished": 0.35}
CORPUS_SIZE = 150_000
CANDIDATE_FLOOR = 25
TOP_SCORE = 1 - 1e-6
QUALITY_CAPS = {"off": 0.0, "low": 0.025, "medium": 0.06, "high": 0.10}
POPULARITY_CAPS = {"off": 0.0, "low": 0.05, "medium": 0.12, "high": 0.20}
SHORT_FORMAT = 3
NEVER = 8

# The trait categories, each with its endpoint routes, the fold of its calls, its promotion tiers by route, and whether
# a negated generator call of it is a gate.
CATEGORIES = {
    "PERSON_CREDIT": (("entity",), "SINGLE", {}, True),
    "TITLE_TEXT": (("entity",), "SINGLE", {}, True),
    "NAMED_CHARACTER": (("entity",), "SINGLE", {}, True),
    "STUDIO_BRAND": (("studio",), "SINGLE", {}, True),
    "FRANCHISE_LINEAGE": (("franchise_structure",), "SINGLE", {}, True),
    "CHARACTER_FRANCHISE": (("entity", "franchise_structure"), "ALTERNATIVES", {}, True),
    "ADAPTATION_SOURCE": (("keyword",), "SINGLE", {}, True),
    "CENTRAL_TOPIC": (("keyword", "semantic"), "ADDITIVE", {"semantic": 1}, False),
    "ELEMENT_PRESENCE": (("keyword", "semantic"), "ADDITIVE", {"semantic": 2}, False),
    "CHARACTER_ARCHETYPE": (("keyword", "semantic"), "ADDITIVE", {"semantic": 3}, False),
    "AWARDS": (("awards",), "SINGLE", {}, True),
    "TRENDING": (("trending",), "SINGLE", {}, False),
    "RELEASE_DATE": (("metadata",), "SINGLE", {}, True),
    "RUNTIME": (("metadata",), "SINGLE", {}, True),
    "MATURITY_RATING": (("metadata",), "SINGLE", {}, True),
    "AUDIO_LANGUAGE": (("metadata",), "SINGLE", {}, True),
    "STREAMING": (("metadata",), "SINGLE", {}, True),
    "FINANCIAL_SCALE": (("metadata",), "SINGLE", {}, True),
    "NUMERIC_RECEPTION_SCORE": (("metadata",), "SINGLE", {}, False),
    "COUNTRY_OF_ORIGIN": (("metadata",), "SINGLE", {}, True),
    "MEDIA_TYPE": (("media_type",), "SINGLE", {}, True),
    "GENRE": (("keyword", "semantic"), "ALTERNATIVES", {"semantic": 2}, False),
    "CULTURAL_TRADITION": (("keyword", "metadata"), "ALTERNATIVES", {}, False),
    "FILMING_LOCATION": (("semantic",), "SINGLE", {"semantic": 1}, False),
    "FORMAT_VISUAL": (("keyword", "semantic"), "ALTERNATIVES", {"semantic": 2}, False),
    "NARRATIVE_DEVICES": (("keyword", "semantic"), "ADDITIVE", {"semantic": 2}, False),
    "TARGET_AUDIENCE": (("keyword", "metadata", "semantic"), "ALTERNATIVES", {"semantic": 5}, False),
    "SENSITIVE_CONTENT": (("keyword", "metadata", "semantic"), "CONSENSUS", {"semantic": 5}, False),
    "SEASONAL_HOLIDAY": (("semantic",), "SINGLE", {"semantic": 5}, False),
    "PLOT_EVENTS": (("semantic",), "SINGLE", {"semantic": 1}, False),
    "NARRATIVE_SETTING": (("semantic",), "SINGLE", {"semantic": 1}, False),
    "STORY_THEMATIC_ARCHETYPE": (("keyword", "semantic"), "ADDITIVE", {"semantic": 3}, False),
    "EMOTIONAL_EXPERIENTIAL": (("semantic",), "SINGLE", {"semantic": 6}, False),
    "VIEWING_OCCASION": (("semantic",), "SINGLE", {"semantic": 6}, False),
    "VISUAL_CRAFT_ACCLAIM": (("semantic",), "SINGLE", {"semantic": 4}, False),
    "MUSIC_SCORE_ACCLAIM": (("semantic",), "SINGLE", {"semantic": 4}, False),
    "DIALOGUE_CRAFT_ACCLAIM": (("semantic",), "SINGLE", {"semantic": 4}, False),
    "GENERAL_APPEAL": (("metadata",), "SINGLE", {"metadata": 7}, False),
    "CULTURAL_STATUS": (("semantic", "metadata"), "ADDITIVE", {"semantic": 4, "metadata": 7}, False),
    "SPECIFIC_PRAISE_CRITICISM": (("semantic",), "SINGLE", {"semantic": 4}, False),
    "BELOW_THE_LINE_CREATOR": ((), "NO_OP", {}, False),
    "NAMED_SOURCE_CREATOR": (("entity",), "SINGLE", {}, True),
    "CHRONOLOGICAL": (("chronological",), "SINGLE", {"metadata": 7}, False),
}
#: Routes whose calls rerank a pool unless they are promoted; calls of other routes generate candidates.
RERANK_ROUTES = ("semantic", "chronological")
#: Categories whose metadata calls only rerank.
RERANK_CATEGORIES = ("GENERAL_APPEAL", "CULTURAL_STATUS")


def generates(category: str, route: str) -> bool:
    """Whether a positive call of a category and route generates candidates."""
    return route not in RERANK_ROUTES and not (route == "metadata" and category in RERANK_CATEGORIES)


def promotion_tier(category: str, route: str) -> int:
    """Tier in which a reranking call may become a generator, NEVER if it may not."""
    return CATEGORIES[category][2].get("metadata" if route == "chronological" else route, NEVER)


def category_rows(spark: SparkSession) -> DataFrame:
    """One row per category and route: fold, generator or reranker, promotion tier, gate."""
    rows = [(name, route, fold, generates(name, route), promotion_tier(name, route), gate) for name, (routes, fold, _, gate) in CATEGORIES.items() for route in routes]
    return spark.createDataFrame(rows, "category string, route string, fold string, generator boolean, tier int, gate boolean")


def fold_calls(fold: Column, calls: Column) -> Column:
    """A category's score from its calls' (call, score, asked) aggregates; to be used in an aggregation.

    SINGLE takes the first call, ADDITIVE the product, ALTERNATIVES the best, CONSENSUS the geometric mean with a floor; NO_OP gives null.
    """
    s, n = F.col("score"), F.count(F.lit(1))
    product = F.when(n == calls, F.product(s)).otherwise(0.0)
    logs = F.sum(F.log(F.greatest(s, F.lit(FLOOR)))) + (calls - n) * F.log(F.lit(FLOOR))
    single = F.coalesce(F.max(F.when(F.col("call") == 0, s)), F.lit(0.0))
    return F.when(fold == "SINGLE", single).when(fold == "ADDITIVE", product).when(fold == "ALTERNATIVES", F.max(s)).when(fold == "CONSENSUS", F.exp(logs / calls))


def category_scores(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """(trait, category, place, movie_id, score): each category's fold of its calls. specs: (trait, category, place, fold, asked), asked its number of calls."""
    rows = calls.join(F.broadcast(specs), ["trait", "category"])
    return rows.groupBy("trait", "category", "place", "movie_id", "fold", "asked").agg(fold_calls(F.col("fold"), F.col("asked")).alias("score")).where("score IS NOT NULL").drop("fold", "asked")


def trait_scores(categories: DataFrame, modes: DataFrame) -> DataFrame:
    """(trait, movie_id, score): SOLO takes the first category, FRAMINGS the best, FACETS the geometric mean with a floor over all categories.

    modes: (trait, mode, surviving), surviving its number of categories that can score. Items without any score have no row; FACETS gives such items the floor.
    """
    s, n = F.col("score"), F.count(F.lit(1))
    logs = F.sum(F.log(F.greatest(s, F.lit(FLOOR)))) + (F.col("surviving") - n) * F.log(F.lit(FLOOR))
    solo = F.coalesce(F.max(F.when(F.col("place") == 0, s)), F.lit(0.0))
    fold = F.when(F.col("mode") == "SOLO", solo).when(F.col("mode") == "FRAMINGS", F.max(s)).otherwise(F.exp(logs / F.col("surviving")))
    return categories.join(F.broadcast(modes), "trait").groupBy("trait", "movie_id", "mode", "surviving").agg(fold.alias("score")).drop("mode", "surviving")


def negative_scores(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """(trait, movie_id, score): product of the gates times the noisy or of the fuzzy calls; without gates or fuzzy calls, the other alone.

    specs: (trait, gates, fuzzies), the numbers of calls of either kind; calls: (trait, movie_id, gate, score).
    """
    s = F.col("score")
    gate = F.when(F.count(F.when(F.col("gate"), 1)) == F.col("gates"), F.coalesce(F.product(F.when(F.col("gate"), s)), F.lit(1.0))).otherwise(0.0)
    fuzzy = 1 - F.coalesce(F.product(F.when(~F.col("gate"), 1 - s)), F.lit(1.0))
    both = F.when(F.col("fuzzies") == 0, gate).when(F.col("gates") == 0, fuzzy).otherwise(gate * fuzzy)
    return calls.join(F.broadcast(specs), "trait").groupBy("trait", "movie_id", "gates", "fuzzies").agg(both.alias("score")).drop("gates", "fuzzies")


def rarity_of(calls: DataFrame, corpus: int = CORPUS_SIZE) -> DataFrame:
    """(trait, matches, rarity) from the distinct items that a trait's generators found; of promoted calls only top scores count."""
    met = calls.where(~F.col("promoted") | (F.col("score") >= TOP_SCORE))
    return met.groupBy("trait").agg(F.countDistinct("movie_id").alias("matches")).withColumn("rarity", S.rarity(F.col("matches") / float(corpus)))


def final_scores(pool: DataFrame, positive: DataFrame, negative: DataFrame, weights: DataFrame) -> DataFrame:
    """(movie_id, positive, negative, score) of every pool item; weights: (trait, weight)."""
    part = lambda d, name: d.join(F.broadcast(weights), "trait").groupBy("movie_id").agg(F.sum(F.col("score") * F.col("weight")).alias(name))
    joined = pool.join(part(positive, "positive"), "movie_id", "left").join(part(negative, "negative"), "movie_id", "left")
    filled = joined.select("movie_id", F.coalesce("positive", F.lit(0.0)).alias("positive"), (0.0 - F.coalesce("negative", F.lit(0.0))).alias("negative"))
    return filled.withColumn("score", F.col("positive") + F.col("negative"))


def implicit_prior(d: DataFrame, quality: str = "off", popularity: str = "off", niche: bool = False, poor: bool = False) -> DataFrame:
    """Raises score by a share of the positive total (1 if there is none) times one prior's signal; popularity goes before quality."""
    if POPULARITY_CAPS[popularity]:
        cap, signal = POPULARITY_CAPS[popularity], S.popularity_mode(F.col("popularity"), niche)
    else:
        cap, signal = QUALITY_CAPS[quality], S.reception_mode(F.col("reception"), poor)
    return d.withColumn("score", F.col("score") + F.when(F.col("positive") > 0, F.col("positive")).otherwise(1.0) * cap * signal)


def pool_of(generators: list[DataFrame], shorts: DataFrame, reserves: list[tuple[int, DataFrame]] = (), seed: DataFrame | None = None, filtered: bool = True, least: int = CANDIDATE_FLOOR) -> tuple[DataFrame, list[int]]:
    """(pool, promoted tiers): the union of the generators without shorts. Under a hard filter, while the pool is short of `least`, the reserve
    tiers join in their order (one count a tier, of at most seven); an empty pool takes the neutral seed."""
    union = reduce(DataFrame.unionByName, [g.select("movie_id") for g in generators]).distinct() if generators else None
    promoted = []
    for tier, found in sorted(reserves, key=lambda x: x[0]):
        if union is not None and (not filtered or len(union.join(shorts, "movie_id", "left_anti").take(least)) >= least):
            break
        union = found.select("movie_id") if union is None else union.unionByName(found.select("movie_id")).distinct()
        promoted.append(tier)
    if union is None or (seed is not None and union.isEmpty()):
        union = seed.select("movie_id")
    return union.select("movie_id").distinct().join(shorts, "movie_id", "left_anti"), promoted


# Registered queries: three positive traits and a negative one over the cards.


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive calls of the registered request."""
    cards = C.cards(spark, sf_dir)
    awards = C.awards(spark, sf_dir)
    topic = E.keyword_scores(cards, [1, 5, 9], [2], [3, 9], every=True)
    near = cards.select("movie_id", S.reception_mode(F.col("reception")).alias("score"))
    made = [
        (0, "CENTRAL_TOPIC", 0, topic, False),
        (0, "CENTRAL_TOPIC", 1, near, True),
        (0, "SENSITIVE_CONTENT", 0, E.keyword_scores(cards, [2, 3], [], [1]), False),
        (0, "SENSITIVE_CONTENT", 1, E.metadata_scores(cards, [E.maturity_call(">=", 4)]), False),
        (1, "GENRE", 0, E.keyword_scores(cards, [4], [], [], every=True), False),
        (1, "AWARDS", 0, E.award_search(awards, won=True, mark=3, floor=False), False),
        (2, "PERSON_CREDIT", 0, E.person_scores(spark, sf_dir, [1, 2, 3], "actor"), False),
    ]
    return reduce(DataFrame.unionByName, [d.select(F.lit(t).alias("trait"), F.lit(c).alias("category"), F.lit(k).alias("call"), "movie_id", "score", F.lit(r).alias("reranks")) for t, c, k, d, r in made])


def _negative_calls(cards: DataFrame) -> DataFrame:
    """Negative calls of the registered request: they need the cards alone."""
    against = [(3, True, E.media_type_scores(cards, [0, 2])), (3, False, E.keyword_scores(cards, [7, 8], [], [2], every=True)), (3, False, cards.select("movie_id", S.popularity_mode(F.col("popularity"), niche=True).alias("score")))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(t).alias("trait"), F.lit(g).alias("gate"), "movie_id", "score") for t, g, d in against])


_SPECS = [(0, "CENTRAL_TOPIC", 0, "ADDITIVE", 2), (0, "SENSITIVE_CONTENT", 1, "CONSENSUS", 2), (1, "GENRE", 0, "ALTERNATIVES", 1), (1, "AWARDS", 1, "SINGLE", 1), (2, "PERSON_CREDIT", 0, "SINGLE", 1)]
_MODES = [(0, "FACETS", 2), (1, "FRAMINGS", 2), (2, "SOLO", 1)]
_COMMITTED = {0: "required", 1: "elevated", 2: "neutral", 3: "supporting"}


def trait_fold_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    specs = spark.createDataFrame(_SPECS, "trait int, category string, place int, fold string, asked int")
    return category_scores(calls, specs).select("trait", "category", "movie_id", C.r6(F.col("score")).alias("score"))


def _found(score: Column, scored: Column) -> Column:
    return F.when(scored, score)


def keyword_score(keywords: list[int], sources: list[int], tags: list[int], every: bool = False) -> Column:
    """endpoints.keyword_scores of a card as an expression, null without a hit."""
    hits = sum((P._hits(F.col(c), ids) for c, ids in (("source_ids", sources), ("tag_ids", tags))), P._hits(F.col("keyword_ids"), keywords))
    return _found(hits / float(len({*keywords}) + len({*sources}) + len({*tags})) if every else F.lit(1.0), hits > 0)


def column_score(call: E.ColumnCall) -> Column:
    """endpoints.metadata_scores of a card by one bounded column, null where it finds nothing."""
    score = F.greatest(F.lit(0.0), call.score)
    return _found(score, call.gate & (score >= E.LEAST_GENERATED))


def fold_scores(fold: str, scores: list[Column]) -> Column:
    """fold_calls over columns, the calls of one category in their order, null where a call finds nothing; null where none does."""
    n, met = len(scores), reduce(lambda a, b: a | b, [s.isNotNull() for s in scores])
    all_met = reduce(lambda a, b: a & b, [s.isNotNull() for s in scores])
    logs = sum((F.log(F.greatest(F.coalesce(s, F.lit(FLOOR)), F.lit(FLOOR))) for s in scores), F.lit(0.0))
    best = F.greatest(*scores) if n > 1 else scores[0]
    made = {"SINGLE": F.coalesce(scores[0], F.lit(0.0)), "ADDITIVE": F.when(all_met, reduce(lambda a, b: a * b, scores)).otherwise(0.0), "ALTERNATIVES": best, "CONSENSUS": F.exp(logs / n)}
    return F.when(met, made[fold])


def mode_scores(mode: str, categories: list[Column]) -> Column:
    """trait_scores over columns, the categories of one trait in their order; null where none has a score."""
    n, met = len(categories), reduce(lambda a, b: a | b, [c.isNotNull() for c in categories])
    logs = sum((F.log(F.greatest(F.coalesce(c, F.lit(FLOOR)), F.lit(FLOOR))) for c in categories), F.lit(0.0))
    best = F.greatest(*categories) if n > 1 else categories[0]
    return F.when(met, {"SOLO": F.coalesce(categories[0], F.lit(0.0)), "FRAMINGS": best, "FACETS": F.exp(logs / n)}[mode])


def negative_score(gates: list[Column], fuzzies: list[Column]) -> Column:
    """negative_scores over columns, null where a call finds nothing; 0 where none does."""
    gate = reduce(lambda a, b: a * b, [F.coalesce(g, F.lit(0.0)) for g in gates], F.lit(1.0))
    fuzzy = 1 - reduce(lambda a, b: a * b, [1 - F.coalesce(f, F.lit(0.0)) for f in fuzzies], F.lit(1.0))
    return gate if not fuzzies else fuzzy if not gates else gate * fuzzy


def _against() -> Column:
    """The negative trait of the registered request over the cards."""
    media = _found(F.lit(1.0), F.col("release_format").isin([0, 2]))
    return negative_score([media], [keyword_score([7, 8], [], [2], every=True), S.popularity_mode(F.col("popularity"), niche=True)])


def trait_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    against = _negative_calls(C.cards(spark, sf_dir))
    return negative_scores(against, spark.createDataFrame([(3, 1, 2)], "trait int, gates int, fuzzies int")).select("movie_id", C.r6(F.col("score")).alias("score"))


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an item with the score of each positive call of the registered request, null where the call does not find it, and its negative trait.

    Calls of cards are expressions over the card, so that only awards and people meet it by a join. Items without a card stay: they count for rarity. An item has one card.
    """
    made = {
        "topic": keyword_score([1, 5, 9], [2], [3, 9], every=True),
        "near": S.reception_mode(F.col("reception")),
        "content": keyword_score([2, 3], [], [1]),
        "mature": column_score(E.maturity_call(">=", 4)),
        "genre": keyword_score([4], [], [], every=True),
        "negative": _against(),
        "carded": F.coalesce(F.col("release_format") != SHORT_FORMAT, F.lit(True)),
    }
    cards = C.cards(spark, sf_dir).select("movie_id", "popularity", *[c.alias(name) for name, c in made.items()])
    awards = E.award_search(C.awards(spark, sf_dir), won=True, mark=3, floor=False).withColumnRenamed("score", "awards")
    people = E.person_scores(spark, sf_dir, [1, 2, 3], "actor").select("movie_id", F.coalesce("score", F.lit(0.0)).alias("person"))
    return cards.join(awards, "movie_id", "full").join(people, "movie_id", "full")


def flow_trait_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow: pool of the generators without shorts, folds, weights by commitment and rarity, the negative trait, a popularity prior; the best 100.

    All of it is one pass over one row an item, after one that counts what the traits' generators find.
    """
    items = written(scored_items(spark, sf_dir), "items")
    calls = {"CENTRAL_TOPIC": ["topic", "near"], "SENSITIVE_CONTENT": ["content", "mature"], "GENRE": ["genre"], "AWARDS": ["awards"], "PERSON_CREDIT": ["person"]}
    folded = {t: [fold_scores(fold, [F.col(c) for c in calls[category]]) for own, category, _, fold, _ in _SPECS if own == t] for t, _, _ in _MODES}
    traits = {t: mode_scores(mode, folded[t]) for t, mode, _ in _MODES}
    # Traits of generators only are weighted by their rarity, too; "near" reranks.
    found = {t: [c for own, category, *_ in _SPECS if own == t for c in calls[category] if c != "near"] for t in traits}
    met = lambda t: F.coalesce(*[F.col(c) for c in found[t]]).isNotNull()
    matches = items.agg(*[F.count(F.when(met(t), 1)).alias(f"matches_{t}") for t in traits if t > 0])
    rare = {t: F.when(F.col(f"matches_{t}") > 0, S.rarity(F.col(f"matches_{t}") / float(CORPUS_SIZE))).otherwise(1.0) for t in traits if t > 0}
    weight = {t: COMMITMENTS[c] * rare.get(t, F.lit(1.0)) for t, c in _COMMITTED.items()}
    pool = items.where("carded").where(reduce(lambda a, b: a | b, map(met, traits))).crossJoin(F.broadcast(matches))
    positive = sum((F.coalesce(traits[t] * weight[t], F.lit(0.0)) for t in traits), F.lit(0.0))
    d = pool.select("movie_id", "popularity", positive.alias("positive"), (0.0 - F.col("negative") * weight[3]).alias("negative"))
    d = implicit_prior(d.withColumn("score", F.col("positive") + F.col("negative")), popularity="medium")
    ranked = d.select("movie_id", C.r6(F.col("positive")).alias("positive"), C.r6(F.col("negative")).alias("negative"), C.r6(F.col("score")).alias("score"))
    return ranked.orderBy(F.desc("score"), "movie_id").limit(100)


_WELL = "1 / (1 + exp(-0.22 * (reception - 70)))"
_NICHE = "1 / (1 + exp(12 * (popularity - 0.40)))"
_CALLS = (
    E._ZONES.replace(C.POSTINGS, C.CARDS + "," + C.POPULAR + "," + C.AWARDS + "," + C.POSTINGS, 1)
    + f""", calls AS (
  SELECT 0 AS trait, 'CENTRAL_TOPIC' AS category, 0 AS call, movie_id, ({E._HITS}) / 6::DOUBLE AS score FROM cards WHERE {E._HITS} > 0
  UNION ALL SELECT 0, 'CENTRAL_TOPIC', 1, movie_id, {_WELL} FROM cards
  UNION ALL SELECT 0, 'SENSITIVE_CONTENT', 0, movie_id, 1 FROM cards WHERE list_has_any(keyword_ids, [2, 3]) OR list_contains(tag_ids, 1)
  UNION ALL SELECT 0, 'SENSITIVE_CONTENT', 1, movie_id, CASE WHEN maturity_rank >= 4 THEN 1 ELSE 0.5 END FROM cards WHERE maturity_rank >= 3
  UNION ALL SELECT 1, 'GENRE', 0, movie_id, 1 FROM cards WHERE list_contains(keyword_ids, 4)
  UNION ALL SELECT 1, 'AWARDS', 0, movie_id, least(count(*), 3) / 3::DOUBLE FROM awards WHERE ceremony <> 10 AND won GROUP BY movie_id
  UNION ALL SELECT 2, 'PERSON_CREDIT', 0, movie_id, {E._curve_sql("default")} FROM zones WHERE term IN (1, 2, 3) GROUP BY movie_id),
against AS (
  SELECT movie_id, true AS gate, 1::DOUBLE AS score FROM cards WHERE release_format IN (0, 2)
  UNION ALL SELECT movie_id, false, (len(list_intersect(keyword_ids, [7, 8])) + list_contains(tag_ids, 2)::INT) / 3::DOUBLE FROM cards WHERE list_has_any(keyword_ids, [7, 8]) OR list_contains(tag_ids, 2)
  UNION ALL SELECT movie_id, false, {_NICHE} FROM popular)"""
)
_FOLDS = """
folded AS (SELECT trait, category, movie_id, CASE category
  WHEN 'CENTRAL_TOPIC' THEN CASE WHEN count(*) = 2 THEN product(score) ELSE 0 END
  WHEN 'SENSITIVE_CONTENT' THEN exp((sum(ln(greatest(score, 0.1))) + (2 - count(*)) * ln(0.1)) / 2)
  ELSE max(score) END AS score FROM {calls} GROUP BY 1, 2, 3)"""
_NEGATIVE = """
negative AS (SELECT movie_id, bool_or(gate)::INT * (1 - coalesce(product(1 - score) FILTER (WHERE NOT gate), 1)) AS score FROM {against} GROUP BY 1)"""
_FLOW = f"""WITH{_CALLS}, pool AS (SELECT DISTINCT movie_id FROM calls JOIN cards USING (movie_id) WHERE NOT (category = 'CENTRAL_TOPIC' AND call = 1) AND release_format <> 3),
inside AS (SELECT calls.* FROM calls JOIN pool USING (movie_id)), gone AS (SELECT against.* FROM against JOIN pool USING (movie_id)),{_FOLDS.format(calls="inside")},{_NEGATIVE.format(against="gone")},
traits AS (SELECT trait, movie_id, CASE trait WHEN 0 THEN exp((sum(ln(greatest(score, 0.1))) + (2 - count(*)) * ln(0.1)) / 2) ELSE max(score) END AS score FROM folded GROUP BY 1, 2),
rare AS (SELECT trait, count(DISTINCT movie_id) / 150000::DOUBLE AS x FROM calls WHERE trait > 0 GROUP BY 1),
weights AS (SELECT t AS trait, w * coalesce(CASE WHEN x IS NULL THEN 1 WHEN x < 0.001 THEN 1.5 WHEN x < 0.01 THEN 1.2 WHEN x < 0.1 THEN 1 WHEN x < 0.3 THEN 0.75 ELSE 0.5 END, 1)::DOUBLE AS weight
  FROM (VALUES (0, 3.0::DOUBLE), (1, 1.75), (2, 1.0), (3, 0.6)) v(t, w) LEFT JOIN rare ON trait = t),
p AS (SELECT movie_id, sum(score * weight) AS p FROM traits JOIN weights USING (trait) GROUP BY 1), n AS (SELECT movie_id, score * (SELECT weight FROM weights WHERE trait = 3) AS n FROM negative),
s AS (SELECT movie_id, coalesce(p, 0) AS positive, 0 - coalesce(n, 0) AS negative, popularity FROM pool LEFT JOIN p USING (movie_id) LEFT JOIN n USING (movie_id) JOIN popular USING (movie_id))
SELECT movie_id, round(positive, 6) AS positive, round(negative, 6) AS negative,
  round(positive + negative + CASE WHEN positive > 0 THEN positive ELSE 1 END * 0.12::DOUBLE / (1 + exp(-12 * (popularity - 0.70))), 6) AS score FROM s ORDER BY score DESC, movie_id LIMIT 100"""
QUERIES = {
    "trait_fold_categories": (trait_fold_categories, f"WITH{_CALLS},{_FOLDS.format(calls='calls')} SELECT trait, category, movie_id, round(score, 6) AS score FROM folded"),
    "trait_negative": (trait_negative, f"WITH{_CALLS},{_NEGATIVE.format(against='against')} SELECT movie_id, round(score, 6) AS score FROM negative"),
    "flow_trait_search": (flow_trait_search, _FLOW),
}
