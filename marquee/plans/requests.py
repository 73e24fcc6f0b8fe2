"""Many trait requests in one job: requests, traits and calls are tables, each endpoint is one join over the calls of all requests.

A call is a row (call_id, request, trait, category, place, call, route, arguments). Endpoints return (call_id, movie_id, score); nothing is
read on the driver while the plan is built. What later steps read more than once is written: the specs, the tiers taken and the live calls (as small as
the requests), the scores of generator calls, the pool, and all scores within it.

Pool of a request: items of its generators that pass its hard filter, without shorts. A request without generators takes the calls of its
lowest promotion tier as generators. Under a hard filter, further tiers join in their order while fewer than
`CANDIDATE_FLOOR` items are found. A pool that is still empty is seeded by the neutral prior if the request has a filter or no
generator at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import endpoints as E
from ..operators import preferences as P
from ..operators import traits as R
from ..sources import catalogue as C
from ..sources.store import written
from .flows import neutral_prior

# Items of a neutral seed, items that a promoted vector call finds, ceremonies.
SEED_LIMIT, VECTOR_LIMIT, CEREMONIES = 2000, 2000, 12
#: Width of a runtime cell in minutes, and the cell of all longer items.
RUNTIME_CELL, LAST_CELL = 30, 40
TOP = 100
#: The least number of parts that the scores are dealt into: the tables of all their folds are in a task's memory at once, so that parts are not put together by size.
LEAST_PARTS = 96

CALL = (
    "call_id int, request int, trait int, positive boolean, category string, place int, call int, route string, kind string, ids array<long>, sources array<long>, "
    "tags array<long>, mode string, every boolean, mark int, low double, high double"
)
TRAIT = "request int, trait int, positive boolean, mode string, commitment double"
REQUEST = "request int, released_from double, released_to double, runtime_to double, genres array<long>, popularity string, quality string"


def keyword(ids: list[int], sources: list[int] = (), tags: list[int] = (), every: bool = False) -> dict:
    return {"route": "keyword", "ids": list(ids), "sources": list(sources), "tags": list(tags), "every": every}


def person(ids: list[int], role: str = "unknown", mode: str = "default") -> dict:
    return {"route": "entity", "ids": list(ids), "kind": role, "mode": mode}


def award(ids: list[int] = (), outcome: str = "any", mark: int = 1, floor: bool = True) -> dict:
    """outcome: any, won or nominated; floor: 1 from mark on, else the share of mark."""
    return {"route": "awards", "ids": list(ids), "kind": outcome, "mark": mark, "every": floor}


def franchise(ids: list[int], prefer_lineage: bool = True) -> dict:
    return {"route": "franchise_structure", "ids": list(ids), "every": prefer_lineage}


def media(ids: list[int]) -> dict:
    return {"route": "media_type", "ids": list(ids)}


def trend() -> dict:
    return {"route": "trending"}


def window(column: str, low: float, high: float) -> dict:
    """released (seconds), runtime (minutes) or maturity (ranks) between two finite bounds."""
    return {"route": "metadata", "kind": column, "low": float(low), "high": float(high)}


def prior(kind: str) -> dict:
    """popular, niche, acclaimed or poor: a call that only reranks."""
    return {"route": "metadata", "kind": kind}


def near(space: int, item: int) -> dict:
    """Likeness to an item in one vector space."""
    return {"route": "semantic", "ids": [item], "mark": space}


def request(traits: list[tuple], released: tuple[float, float] | None = None, runtime_to: float | None = None, genres: list[int] = (), popularity: str = "off", quality: str = "off") -> dict:
    """traits: (mode, commitment, positive, [(category, [call, ...]), ...])."""
    return {"traits": traits, "released": released or (None, None), "runtime_to": None if runtime_to is None else float(runtime_to), "genres": list(genres), "popularity": popularity, "quality": quality}


def spec_rows(requests: list[dict]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(call rows, trait rows, request rows) of requests, for callers that do not hold tables already."""
    calls, traits, heads = [], [], []
    for r, asked in enumerate(requests):
        heads.append((r, *asked["released"], asked["runtime_to"], asked["genres"], asked["popularity"], asked["quality"]))
        for t, (mode, commitment, positive, categories) in enumerate(asked["traits"]):
            traits.append((r, t, positive, mode, R.COMMITMENTS[commitment]))
            for place, (category, made) in enumerate(categories):
                for k, call in enumerate(made):
                    calls.append((len(calls), r, t, positive, category, place, k, call["route"], call.get("kind"), call.get("ids", []), call.get("sources", []), call.get("tags", []), call.get("mode"), call.get("every"), call.get("mark"), call.get("low"), call.get("high")))
    return calls, traits, heads


def spec_tables(spark: SparkSession, requests: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    calls, traits, heads = spec_rows(requests)
    return spark.createDataFrame(calls, CALL), spark.createDataFrame(traits, TRAIT), spark.createDataFrame(heads, REQUEST)


def planned(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Calls with their category's fold, whether they generate, their promotion tier (negative calls have none) and whether they gate."""
    rows = calls.join(F.broadcast(registry), ["category", "route"]).where("fold <> 'NO_OP'")
    generator = F.col("positive") & F.col("generator")
    # A negated call gates if its category does and a positive call of its kind would generate.
    return rows.withColumn("gate", F.col("gate") & F.col("generator")).withColumn("tier", F.when(F.col("positive"), F.col("tier")).otherwise(R.NEVER)).withColumn("generator", generator)


# Endpoints: each scores the calls of its route over the whole catalogue. The calls, as many as the requests have, are broadcast; the views are not dealt by terms or kinds.


def _of(calls: DataFrame, route: str) -> DataFrame:
    return calls.where(F.col("route") == route)


def entity_calls(calls: DataFrame, credits: DataFrame) -> DataFrame:
    asked = _of(calls, "entity").select("call_id", F.col("kind").alias("asked_role"), F.col("mode").alias("asked_mode"), F.explode("ids").alias("term"))
    rows = E.billing(credits.join(F.broadcast(asked), "term").where("asked_role = 'unknown' OR asked_role = role"))
    curve = reduce(lambda out, m: out.when(F.col("asked_mode") == m, F.col(f"as_{m}")), E.CURVES, F.when(F.col("role") != "actor", 1.0))
    return rows.groupBy("call_id", "movie_id").agg(F.max(curve).alias("score"))


def keyword_calls(calls: DataFrame, traits: DataFrame) -> DataFrame:
    kinds = {"keyword": "ids", "source": "sources", "tag": "tags"}
    own = _of(calls, "keyword")
    wanted = reduce(DataFrame.unionByName, [own.select("call_id", "every", F.lit(k).alias("kind"), F.explode(F.array_distinct(c)).alias("trait_id"), sum((F.size(F.array_distinct(x)) for x in kinds.values()), F.lit(0)).alias("asked")) for k, c in kinds.items()])
    hits = traits.join(F.broadcast(wanted), ["kind", "trait_id"]).groupBy("call_id", "every", "asked", "movie_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.select("call_id", "movie_id", F.when(F.col("every"), F.col("n") / F.col("asked")).otherwise(1.0).alias("score"))


def award_calls(calls: DataFrame, awards: DataFrame) -> DataFrame:
    all_but_one = F.array(*[F.lit(c).cast("long") for c in range(1, CEREMONIES + 1) if c != E.RAZZIE])
    asked = _of(calls, "awards").select("call_id", "every", "mark", F.col("kind").alias("outcome"), F.explode(F.when(F.size("ids") > 0, F.array_distinct("ids")).otherwise(all_but_one)).alias("ceremony"))
    rows = awards.withColumn("ceremony", F.col("ceremony").cast("long")).join(F.broadcast(asked), "ceremony").where("outcome = 'any' OR won = (outcome = 'won')")
    counted = rows.groupBy("call_id", "every", "mark", "movie_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("call_id", "movie_id", F.when(F.col("n") >= F.col("mark"), 1.0).when(F.col("every"), 0.0).otherwise(F.col("n") / F.col("mark")).alias("score")).where("score > 0")


def franchise_calls(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """entries: (movie_id, entry, lineage)."""
    asked = _of(calls, "franchise_structure").select("call_id", "every", F.explode("ids").alias("entry"))
    hits = entries.join(F.broadcast(asked), "entry").groupBy("call_id", "every", "movie_id").agg(F.max("lineage").alias("lineage"))
    some = hits.groupBy("call_id").agg(F.max("lineage").alias("some"))
    return hits.join(F.broadcast(some), "call_id").select("call_id", "movie_id", F.when(F.col("lineage") | ~F.col("every") | ~F.col("some"), 1.0).otherwise(E.UNIVERSE_ONLY).alias("score"))


def media_calls(calls: DataFrame, cards: DataFrame) -> DataFrame:
    asked = _of(calls, "media_type").select("call_id", F.explode(F.col("ids").cast("array<int>")).alias("release_format"))
    return cards.select("movie_id", "release_format").join(F.broadcast(asked), "release_format").select("call_id", "movie_id", F.lit(1.0).alias("score")).distinct()


def trending_calls(calls: DataFrame, trends: DataFrame, cards: DataFrame) -> DataFrame:
    """Positive trends of known items, in the upper half. The join's key is the route, of few calls."""
    known = trends.where("score > 0").join(cards.select("movie_id"), "movie_id").select("movie_id", E.dealbreaker_floor(F.col("score")).alias("score"), F.lit("trending").alias("route"))
    return known.join(F.broadcast(_of(calls, "trending").select("call_id", "route")), "route").select("call_id", "movie_id", "score")


def grace_of(kind: Column, low: Column, high: Column) -> Column:
    """How far outside its bounds a window still scores."""
    days = F.greatest(F.lit(P.LEAST_DATE_GRACE), F.least(0.5 * (high - low) / S.DAY, F.lit(P.MOST_DATE_GRACE)))
    return F.when(kind == "released", days * S.DAY).when(kind == "runtime", P.RUNTIME_GRACE).otherwise(1.0)


def _cell(kind: str, value: Column) -> Column:
    if kind == "released":
        return F.year(F.timestamp_seconds(value)).cast("int")
    return F.least(F.floor(value / RUNTIME_CELL), F.lit(LAST_CELL)).cast("int") if kind == "runtime" else value.cast("int")


def window_calls(calls: DataFrame, cards: DataFrame) -> DataFrame:
    """Windows of release, runtime and maturity: equal cells meet, then the exact score decides."""
    values = {"released": F.col("released"), "runtime": F.col("runtime"), "maturity": F.col("maturity_rank")}
    cells = reduce(DataFrame.unionByName, [cards.where(v.isNotNull()).select("movie_id", F.lit(k).alias("kind"), v.cast("double").alias("value"), _cell(k, v).alias("cell")) for k, v in values.items()])
    asked = _of(calls, "metadata").where("low IS NOT NULL").select("call_id", "kind", "low", "high", grace_of(F.col("kind"), F.col("low"), F.col("high")).alias("grace"))
    ends = [reduce(lambda out, k: out.when(F.col("kind") == k, _cell(k, at)), values, F.when(F.lit(False), 0)) for at in (F.col("low") - F.col("grace"), F.col("high") + F.col("grace"))]
    rows = cells.join(F.broadcast(asked.withColumn("cell", F.explode(F.sequence(*ends)))), ["kind", "cell"])
    gap = F.greatest(F.col("low") - F.col("value"), F.col("value") - F.col("high"), F.lit(0.0))
    smooth = F.greatest(F.lit(0.0), 1 - gap / F.col("grace"))
    score = F.when(F.col("kind") == "maturity", F.when(gap == 0, 1.0).when(gap <= 1, 0.5).otherwise(0.0)).otherwise(smooth)
    return rows.select("call_id", "movie_id", score.alias("score")).where(F.col("score") >= E.LEAST_GENERATED)


def _likeness(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", S.clamp(S.dot(F.col("vector"), F.col("head")) / (F.col("norm") * F.col("head_norm"))))


def _heads(calls: DataFrame, vectors: DataFrame) -> DataFrame:
    """(call_id, space, head, head_norm) of the vector calls: as many rows as there are such calls."""
    asked = _of(calls, "semantic").select("call_id", F.col("mark").alias("space"), F.element_at("ids", 1).alias("movie_id"))
    return vectors.join(F.broadcast(asked), ["space", "movie_id"]).select("call_id", "space", F.col("vector").alias("head"), F.col("norm").alias("head_norm"))


def vector_calls(calls: DataFrame, vectors: DataFrame, cards: DataFrame, k: int | None = VECTOR_LIMIT) -> DataFrame:
    """The k items that are most alike, for a vector call that generates; without k all that are alike at all."""
    rows = _likeness(vectors.join(F.broadcast(_heads(calls, vectors)), "space")).join(cards.select("movie_id"), "movie_id").where("score > 0")
    if k is None:
        return rows.select("call_id", "movie_id", "score")
    best = Window.partitionBy("call_id").orderBy(F.desc("score"), "movie_id")
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("call_id", "movie_id", "score")


def generated(calls: DataFrame, views: dict[str, DataFrame], bounded: bool = True) -> DataFrame:
    """(call_id, movie_id, score) of calls that generate, whatever their route. Calls that score every item (vectors, priors) give their best ones, or all if not bounded."""
    parts = [
        entity_calls(calls, views["credits"]),
        keyword_calls(calls, views["traits"]),
        award_calls(calls, views["awards"]),
        franchise_calls(calls, views["entries"]),
        media_calls(calls, views["cards"]),
        trending_calls(calls, views["trend"], views["cards"]),
        window_calls(calls, views["cards"]),
        vector_calls(calls, views["vectors"], views["cards"], VECTOR_LIMIT if bounded else None),
        prior_calls(calls, views["cards"].select("movie_id", "popularity", "reception"), None, bounded),
    ]
    return reduce(DataFrame.unionByName, [p.select("call_id", "movie_id", F.col("score").cast("double").alias("score")) for p in parts])


PRIORS = ("popular", "niche", "acclaimed", "poor")


def prior_calls(calls: DataFrame, items: DataFrame, key: str | None, bounded: bool = True) -> DataFrame:
    """Popularity and reception calls over items: those of the same request (key), or all, of which bounded calls give the best `UNBOUNDED_LIMIT`."""
    asked = _of(calls, "metadata").where(F.col("kind").isin(*PRIORS))
    p, r = F.col("popularity"), F.col("reception")
    made = {"popular": S.popularity_mode(p), "niche": S.popularity_mode(p, True), "acclaimed": S.reception_mode(r), "poor": S.reception_mode(r, True)}
    score = reduce(lambda out, k: out.when(F.col("kind") == k, made[k]), PRIORS, F.when(F.lit(False), 0.0))
    if key:
        return items.join(F.broadcast(asked.select(key, "call_id", "kind")), key).select("call_id", "movie_id", score.alias("score"))
    rows = items.withColumn("route", F.lit("metadata")).join(F.broadcast(asked.select("call_id", "kind", "route")), "route").select("call_id", "movie_id", score.alias("score"))
    if not bounded:
        return rows
    best = Window.partitionBy("call_id").orderBy(F.desc("score"), F.desc("movie_id"))
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= E.UNBOUNDED_LIMIT).drop("_r")


def reranked(calls: DataFrame, pool: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """(call_id, movie_id, score) of calls that only score a pool (request, movie_id)."""
    cards, vectors = views["cards"].select("movie_id", "popularity", "reception"), views["vectors"]
    priors = prior_calls(calls, pool.join(cards, "movie_id"), "request")
    heads = _heads(calls, vectors).join(calls.select("call_id", "request"), "call_id")
    vector = _likeness(pool.join(F.broadcast(heads), "request").join(vectors.select("movie_id", "space", "vector", "norm"), ["movie_id", "space"])).select("call_id", "movie_id", "score")
    rest = calls.where(~F.col("route").isin("semantic") & ~F.coalesce(F.col("kind").isin(*PRIORS), F.lit(False)))
    others = generated(rest, views).join(F.broadcast(rest.select("call_id", "request")), "call_id").join(pool, ["request", "movie_id"]).select("call_id", "movie_id", "score")
    return priors.unionByName(vector).unionByName(others)


def passing(rows: DataFrame, requests: DataFrame, cards: DataFrame) -> DataFrame:
    """rows (request, movie_id, ...) whose item passes the request's hard filter, and whether the item is a short; a null value fails an active bound."""
    short_form = F.coalesce(F.col("release_format") == R.SHORT_FORMAT, F.lit(False)).alias("short")
    d = rows.join(cards.select("movie_id", "released", "runtime", short_form, F.col("genre_ids").cast("array<long>").alias("genre_ids")), "movie_id").join(F.broadcast(requests.select("request", "released_from", "released_to", "runtime_to", "genres")), "request")
    dated = F.col("released_from").isNull() | F.coalesce(F.col("released").between(F.col("released_from"), F.col("released_to")), F.lit(False))
    brief = F.col("runtime_to").isNull() | F.coalesce(F.col("runtime") <= F.col("runtime_to"), F.lit(False))
    kind = (F.size("genres") == 0) | F.coalesce(F.arrays_overlap("genre_ids", "genres"), F.lit(False))
    return d.where(dated & brief & kind).select(*rows.columns, "short")


def filtered(requests: DataFrame) -> DataFrame:
    active = F.col("released_from").isNotNull() | F.col("runtime_to").isNotNull() | (F.size("genres") > 0)
    return requests.withColumn("active", active)


def tiers_taken(plan: DataFrame, found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, tier): 0 for generators, else the promoted tiers, as far as they are needed; at most eight rows a request.

    found: (request, tier, movie_id) of what each tier finds, without shorts.
    """
    offered = plan.where("generator").select("request", F.lit(0).alias("tier")).unionByName(plan.where(f"NOT generator AND positive AND tier < {R.NEVER}").select("request", "tier")).distinct()
    new = found.groupBy("request", "movie_id").agg(F.min("tier").alias("tier")).groupBy("request", "tier").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("request").orderBy("tier")
    counted = offered.join(new, ["request", "tier"], "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("at", F.row_number().over(order))
    return counted.join(F.broadcast(requests.select("request", "active")), "request").where((F.col("at") == 1) | (F.col("active") & (F.col("before") < R.CANDIDATE_FLOOR))).select("request", "tier")


def run_requests(calls: DataFrame, traits: DataFrame, requests: DataFrame, registry: DataFrame, views: dict[str, DataFrame], top: int = TOP) -> DataFrame:
    """(request, rank, movie_id, positive, negative, score): the best `top` items of every request.

    views: credits, traits (movie_id, kind, trait_id), awards, entries, cards, trend and vectors.
    """
    cards = views["cards"]
    asked = filtered(requests)
    plan = written(planned(calls, registry).join(F.broadcast(asked.select("request", "active")), "request"), "plan")
    heads = plan.groupBy("request").agg(F.max("generator").alias("generators"))
    # Promotable calls are run only where they may be needed.
    spare = plan.join(F.broadcast(heads), "request").where(f"positive AND NOT generator AND tier < {R.NEVER} AND (active OR NOT generators)").drop("generators")
    runs = plan.where("generator").withColumn("tier", F.lit(0)).unionByName(spare)
    hits = passing(generated(runs, views).join(F.broadcast(runs.select("call_id", "request", "tier")), "call_id"), requests, cards)
    found = written(hits, "found")

    full_length = found.where("NOT short").drop("short")
    taken = written(tiers_taken(plan, full_length.select("request", "tier", "movie_id"), asked), "taken")
    inside = full_length.join(F.broadcast(taken), ["request", "tier"])
    kept = inside.select("request", "movie_id").distinct()
    empty = asked.join(F.broadcast(heads), "request").where("active OR NOT generators").join(kept.select("request").distinct(), "request", "left_anti")
    neutral = neutral_prior(cards.where(~F.coalesce(F.col("release_format") == R.SHORT_FORMAT, F.lit(False)))).select("movie_id", "prior", F.lit(True).alias("_all"))
    seeded = passing(neutral.join(F.broadcast(empty.select("request", F.lit(True).alias("_all"))), "_all").select("request", "movie_id", "prior"), requests, cards)
    first = Window.partitionBy("request").orderBy(F.desc("prior"), F.desc("movie_id"))
    seed = seeded.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SEED_LIMIT).select("request", "movie_id")
    pool = written(kept.unionByName(seed), "pool")

    promoted = plan.where(f"NOT generator AND positive AND tier < {R.NEVER}").join(F.broadcast(taken), ["request", "tier"]).select("call_id").withColumn("promoted", F.lit(True))
    live = plan.join(F.broadcast(promoted), "call_id", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False))).withColumn("generator", F.col("generator") | F.col("promoted"))
    live = written(live, "live")
    maps = found.join(F.broadcast(live.where("generator").select("call_id")), "call_id").select("call_id", "movie_id", "score")
    rank_only = live.where("NOT generator").select(*plan.columns)
    # What the taken tiers found makes the pool, so all of it is inside.
    scored = written(inside.select("call_id", "movie_id", "score").unionByName(reranked(rank_only, pool, views)), "scored")
    return rank_requests(scored, maps, live, traits, requests, pool, cards, top)


def rank_requests(scored: DataFrame, maps: DataFrame, live: DataFrame, traits: DataFrame, requests: DataFrame, pool: DataFrame, cards: DataFrame, top: int) -> DataFrame:
    """Folds of calls, categories and traits, weights, negative traits and priors of all requests at once.

    Scores and the pool (rows without a trait) are dealt by item once; every fold keeps the item among its keys, so that none deals them again.
    """
    on = ["request", "trait"]
    specs = live.groupBy(*on, "positive", "category", "place", "fold").agg(F.count(F.lit(1)).alias("asked"))
    rows = scored.join(F.broadcast(live.select("call_id", *on, "positive", "category", "place", "call", "gate")), "call_id")
    rows = rows.unionByName(pool.select("request", "movie_id"), allowMissingColumns=True)
    rows = rows.repartition(max(LEAST_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "movie_id")
    place = [*on, "positive", "category", "place"]
    rows = rows.join(F.broadcast(specs.where("positive").select(*place, "fold", "asked")), place, "left")
    s = F.col("score")
    product = lambda x: F.coalesce(F.product(x), F.lit(1.0))
    against = [F.count(F.when(F.col("gate"), 1)).alias("met"), product(F.when(F.col("gate"), s)).alias("gated"), product(F.when(~F.col("gate"), 1 - s)).alias("missed")]
    folded = rows.groupBy(*place, "movie_id", "fold", "asked").agg(R.fold_calls(F.col("fold"), F.col("asked")).alias("score"), *against)
    # What a trait gives an item that none of its calls finds: the floor, if its fold or that of a category that counts has one.
    consensus, solo = F.max(F.col("fold") == "CONSENSUS"), F.min_by(F.col("fold") == "CONSENSUS", "place")
    kinds = specs.where("positive").groupBy(*on).agg(F.count(F.lit(1)).alias("surviving"), F.min("place").alias("first"), consensus.alias("_any"), solo.alias("_solo"))
    floored = (F.col("mode") == "FACETS") | ((F.col("mode") == "FRAMINGS") & F.col("_any")) | ((F.col("mode") == "SOLO") & F.col("_solo"))
    modes = traits.where("positive").join(F.broadcast(kinds), on).select(*on, "mode", "surviving", "first", F.when(floored, R.FLOOR).otherwise(0.0).alias("base"))
    n = F.count(F.lit(1))
    logs = F.sum(F.log(F.greatest(s, F.lit(R.FLOOR)))) + (F.col("surviving") - n) * F.log(F.lit(R.FLOOR))
    base = F.col("base")
    fold = F.when(F.col("mode") == "SOLO", F.coalesce(F.max(F.when(F.col("place") == F.col("first"), s)), base)).when(F.col("mode") == "FRAMINGS", F.greatest(F.max(s), base)).otherwise(F.exp(logs / F.col("surviving")))
    asked = live.where("NOT positive").groupBy(*on).agg(F.count(F.when(F.col("gate"), 1)).alias("gates"), F.count(F.when(~F.col("gate"), 1)).alias("fuzzies"))
    traited = folded.join(F.broadcast(modes), on, "left").join(F.broadcast(asked), on, "left")
    by_trait = traited.groupBy(*on, "positive", "movie_id", "mode", "surviving", "first", "base", "gates", "fuzzies").agg((fold - base).alias("score"), F.sum("met").alias("met"), product(F.col("gated")).alias("gated"), product(F.col("missed")).alias("missed"))
    gate, fuzzy = F.when(F.col("met") == F.col("gates"), F.col("gated")).otherwise(0.0), 1 - F.col("missed")
    negative = F.when(F.col("fuzzies") == 0, gate).when(F.col("gates") == 0, fuzzy).otherwise(gate * fuzzy)

    # Only traits of generators alone are weighted by their rarity; of promoted calls only full scores count.
    pure = live.where("positive").groupBy(*on).agg(F.min("generator").alias("pure")).where("pure").select(*on)
    matched = maps.join(F.broadcast(live.select("call_id", *on, "promoted")), "call_id").join(F.broadcast(pure), on).where(~F.col("promoted") | (F.col("score") >= R.TOP_SCORE))
    total = cards.agg(F.count(F.lit(1)).alias("total"))
    matches = F.broadcast(pure).join(matched.groupBy(*on).agg(F.countDistinct("movie_id").alias("matches")), on, "left").crossJoin(F.broadcast(total))
    rare = matches.select(*on, S.rarity(F.coalesce("matches", F.lit(0)) / F.col("total")).alias("rarity"))
    weights = traits.join(rare, on, "left").select(*on, (F.col("commitment") * F.coalesce("rarity", F.lit(1.0))).alias("weight"))

    weighed = lambda own, x: F.sum(F.when(own, x * F.col("weight")))
    sums = by_trait.join(F.broadcast(weights), on, "left").groupBy("request", "movie_id").agg(weighed(F.col("positive"), s).alias("positive"), weighed(~F.col("positive"), negative).alias("negative"), F.count(F.when(F.col("trait").isNull(), 1)).alias("pooled"))
    sums = sums.where("pooled > 0").drop("pooled")
    given = modes.join(F.broadcast(weights), on).groupBy("request").agg(F.sum(F.col("base") * F.col("weight")).alias("_given"))
    sums = sums.join(F.broadcast(given), "request", "left")
    sums = sums.select("request", "movie_id", (F.coalesce("positive", F.lit(0.0)) + F.coalesce("_given", F.lit(0.0))).alias("positive"), (0.0 - F.coalesce("negative", F.lit(0.0))).alias("negative"))
    cap = lambda c, caps: reduce(lambda out, k: out.when(F.col(c) == k, caps[k]), caps, F.when(F.lit(False), 0.0))
    d = sums.join(cards.select("movie_id", F.col("popularity").alias("_p"), "reception"), "movie_id").join(F.broadcast(requests.select("request", "popularity", "quality")), "request")
    by_popularity, by_quality = cap("popularity", R.POPULARITY_CAPS) * S.popularity_mode(F.col("_p")), cap("quality", R.QUALITY_CAPS) * S.reception_mode(F.col("reception"))
    lift = F.when(F.col("positive") > 0, F.col("positive")).otherwise(1.0) * F.when(F.col("popularity") != "off", by_popularity).otherwise(by_quality)
    d = d.select("request", "movie_id", C.r6(F.col("positive")).alias("positive"), C.r6(F.col("negative")).alias("negative"), C.r6(F.col("positive") + F.col("negative") + lift).alias("score"))
    best = Window.partitionBy("request").orderBy(F.desc("score"), "movie_id")
    return d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def views_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"credits": C.credits(spark, sf_dir), "traits": C.card_traits(spark, sf_dir), "awards": C.awards(spark, sf_dir), "entries": C.franchise_entries(spark, sf_dir), "cards": C.cards(spark, sf_dir), "trend": C.trend(spark, sf_dir), "vectors": C.vectors(spark, sf_dir)}


# Registered queries: ten requests of different shapes.

_1994, _1996 = P.epoch("1994-01-01"), P.epoch("1996-01-01")
REQUESTS = [
    request([("FACETS", "required", True, [("CENTRAL_TOPIC", [keyword([1, 5, 9], [2], [3, 9], every=True)])]), ("SOLO", "neutral", True, [("PERSON_CREDIT", [person([1, 2, 3], "actor")])])], popularity="medium"),
    request([("FRAMINGS", "elevated", True, [("AWARDS", [award(outcome="won", mark=3, floor=False)]), ("CULTURAL_STATUS", [prior("acclaimed")])]), ("SOLO", "supporting", False, [("MEDIA_TYPE", [media([0, 2])])])], quality="high"),
    # Rerankers only: the lowest tier generates.
    request([("FACETS", "required", True, [("PLOT_EVENTS", [near(1, 5)]), ("EMOTIONAL_EXPERIENTIAL", [near(4, 9)])]), ("SOLO", "diminished", True, [("GENERAL_APPEAL", [prior("popular")])])]),
    # A hard filter leaves few items: tiers are promoted one by one.
    request([("FACETS", "required", True, [("PERSON_CREDIT", [person([4], "director")]), ("NARRATIVE_SETTING", [near(2, 7)]), ("VIEWING_OCCASION", [near(6, 3)])])], released=(_1994, _1996), runtime_to=9),
    # Nothing can generate: the neutral seed, with a negative trait.
    request([("SOLO", "required", False, [("GENRE", [keyword([4])]), ("ELEMENT_PRESENCE", [near(3, 11)])])]),
    request([("SOLO", "neutral", True, [("TRENDING", [trend()])]), ("SOLO", "supporting", True, [("MEDIA_TYPE", [media([1, 4])])]), ("SOLO", "elevated", False, [("FRANCHISE_LINEAGE", [franchise([2])]), ("CULTURAL_STATUS", [prior("niche")])])]),
    request([("FACETS", "elevated", True, [("FRANCHISE_LINEAGE", [franchise([3, 4])]), ("MATURITY_RATING", [window("maturity", 2, 3)])])], genres=[2, 5]),
    request([("SOLO", "required", True, [("SENSITIVE_CONTENT", [keyword([2, 3], [], [1]), window("maturity", 4, 5), near(0, 2)])]), ("SOLO", "neutral", False, [("PERSON_CREDIT", [person([7])]), ("TRENDING", [trend()])])], popularity="high"),
    request([("FACETS", "required", True, [("RELEASE_DATE", [window("released", _1994, _1996)]), ("RUNTIME", [window("runtime", 20, 40)])]), ("FRAMINGS", "supporting", True, [("GENRE", [keyword([4, 6], [1]), near(5, 8)])])], quality="low"),
    # A filter, a generator that finds nothing and nothing to promote: the neutral seed under the filter.
    request([("SOLO", "required", True, [("PERSON_CREDIT", [person([999_999])])])], released=(_1994, _1996), genres=[1]),
]


def flow_trait_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten requests in one job."""
    calls, traits, requests = spec_tables(spark, REQUESTS)
    return run_requests(calls, traits, requests, R.category_rows(spark), views_of(spark, sf_dir))


def flow_trait_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers that each request takes its candidates from, with what each tier adds."""
    calls, _, requests = spec_tables(spark, REQUESTS)
    views, asked = views_of(spark, sf_dir), filtered(requests)
    plan = planned(calls, R.category_rows(spark)).join(F.broadcast(asked.select("request", "active")), "request")
    runs = plan.where(f"positive AND (generator OR tier < {R.NEVER})").withColumn("tier", F.when(F.col("generator"), 0).otherwise(F.col("tier")))
    hits = passing(generated(runs, views).join(F.broadcast(runs.select("call_id", "request", "tier")), "call_id"), requests, views["cards"])
    found = written(hits.where("NOT short").select("request", "tier", "movie_id"), "found")
    taken = tiers_taken(plan, found, asked)
    new = found.groupBy("request", "movie_id").agg(F.min("tier").alias("tier")).groupBy("request", "tier").agg(F.count(F.lit(1)).alias("added"))
    return taken.join(new, ["request", "tier"], "left").select("request", "tier", F.coalesce("added", F.lit(0)).alias("added"))


def trait_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold, route and tier: categories, generators, gates, and all items that the ten requests' calls of that kind find."""
    calls, _, _ = spec_tables(spark, REQUESTS)
    registry, keys = R.category_rows(spark), ["fold", "route", "tier"]
    counts = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("generator"), 1)).alias("generators"), F.count(F.when(F.col("gate"), 1)).alias("gates"))
    kinds = calls.join(F.broadcast(registry.select("category", *keys)), ["category", "route"]).select("call_id", *keys)
    items = generated(calls, views_of(spark, sf_dir), bounded=False).join(F.broadcast(kinds), "call_id").groupBy(*keys).agg(F.countDistinct("movie_id").alias("items"))
    return counts.join(items, keys, "left").withColumn("items", F.coalesce("items", F.lit(0)))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return f"{x}::BIGINT[]"
    return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def _values(name: str, rows: list[tuple], schema: str) -> str:
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"{name}({columns}) AS (VALUES " + ",\n  ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def _batch_sql(requests: list[dict], last: str) -> str:
    calls, traits, heads = spec_rows(requests)
    registry = [(name, route, fold, R.generates(name, route), R.promotion_tier(name, route), gate) for name, (routes, fold, _, gate) in R.CATEGORIES.items() for route in routes]
    years = f"greatest({P.LEAST_DATE_GRACE}::DOUBLE, least(0.5::DOUBLE * (high - low) / {S.DAY}::DOUBLE, {P.MOST_DATE_GRACE}::DOUBLE)) * {S.DAY}::DOUBLE"
    prior_of = """CASE kind WHEN 'popular' THEN 1 / (1 + exp(-12 * (popularity - 0.70))) WHEN 'niche' THEN 1 / (1 + exp(12 * (popularity - 0.40)))
      WHEN 'acclaimed' THEN 1 / (1 + exp(-0.22 * (reception - 70))) ELSE 1 / (1 + exp(0.22 * (reception - 50))) END"""
    curves = " ".join(f"WHEN c.mode = '{m}' THEN {E._curve_sql(m).removeprefix('max(').removesuffix(')').replace('place', 'credited.place')}" for m in E.CURVES)
    caps = lambda c, made: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in made.items()) + " END"
    return f"""WITH{C.CARDS},{C.POPULAR},{C.AWARDS},{E._ZONES.strip()},{C.VECTORS},
{_values("calls", calls, CALL)},
{_values("traits", traits, TRAIT)},
{_values("requests", heads, REQUEST)},
{_values("registry", registry, "category string, route string, fold string, generates boolean, tier int, gates boolean")},
asked AS (SELECT *, released_from IS NOT NULL OR runtime_to IS NOT NULL OR len(genres) > 0 AS active FROM requests),
plan AS (
  SELECT c.*, fold, active, c.positive AND generates AS generator, CASE WHEN c.positive THEN tier ELSE 8 END AS tier, generates AND gates AS gate
  FROM calls c JOIN registry USING (category, route) JOIN asked USING (request)),
heads AS (SELECT request, bool_or(generator) AS generators FROM plan GROUP BY 1),
credited AS (
  SELECT 'actor' AS role, term, movie_id, zone, place FROM zones
  UNION ALL SELECT DISTINCT ['director', 'writer', 'producer', 'composer'][l_linenumber], l_suppkey, l_partkey, NULL, NULL FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4),
trended AS (
  SELECT movie_id, 1 - sqrt((row_number() OVER (ORDER BY events DESC, movie_id) - 1)::DOUBLE / count(*) OVER ()) AS score
  FROM (SELECT user_id AS movie_id, count(*) AS events FROM events GROUP BY 1)),
heads_v AS (SELECT call_id, c.request, c.mark AS space, v.vector AS head FROM calls c JOIN vectors v ON v.movie_id = c.ids[1] AND v.space = c.mark WHERE route = 'semantic'),
alike AS (SELECT call_id, v.movie_id, least(greatest(list_cosine_similarity(v.vector, h.head), 0), 1) AS score FROM vectors v JOIN heads_v h USING (space)),
every_score AS (
  SELECT c.call_id, movie_id, max(CASE WHEN role <> 'actor' THEN 1::DOUBLE {curves} END) AS score
  FROM calls c JOIN credited ON list_contains(c.ids, term) AND (c.kind = 'unknown' OR c.kind = role) WHERE route = 'entity' GROUP BY 1, 2
  UNION ALL
  SELECT call_id, movie_id, CASE WHEN every THEN n::DOUBLE / (len(ids) + len(sources) + len(tags)) ELSE 1 END
  FROM (SELECT c.*, movie_id, len(list_intersect(keyword_ids, ids)) + len(list_intersect(source_ids, sources)) + len(list_intersect(tag_ids, tags)) AS n FROM calls c, cards WHERE route = 'keyword') WHERE n > 0
  UNION ALL
  SELECT call_id, movie_id, CASE WHEN count(*) >= any_value(mark) THEN 1::DOUBLE WHEN any_value(every) THEN 0 ELSE count(*)::DOUBLE / any_value(mark) END
  FROM calls c JOIN awards a ON (c.kind = 'any' OR won = (c.kind = 'won')) AND CASE WHEN len(ids) > 0 THEN list_contains(ids, ceremony) ELSE ceremony <> 10 END WHERE route = 'awards' GROUP BY 1, 2 HAVING NOT any_value(every) OR count(*) >= any_value(mark)
  UNION ALL
  SELECT call_id, movie_id, CASE WHEN lineage OR NOT every OR NOT bool_or(lineage) OVER (PARTITION BY call_id) THEN 1::DOUBLE ELSE 0.75 END
  FROM (SELECT call_id, every, movie_id, list_has_any(lineage_ids, ids) AS lineage FROM calls, cards WHERE route = 'franchise_structure' AND (list_has_any(lineage_ids, ids) OR list_has_any(universe_ids, ids)))
  UNION ALL SELECT call_id, movie_id, 1 FROM calls, cards WHERE route = 'media_type' AND list_contains(ids, release_format)
  UNION ALL SELECT call_id, movie_id, 0.5::DOUBLE + 0.5::DOUBLE * score FROM calls, trended JOIN cards USING (movie_id) WHERE route = 'trending' AND score > 0
  UNION ALL SELECT * FROM (
    SELECT call_id, movie_id, CASE kind WHEN 'maturity' THEN CASE WHEN maturity_rank BETWEEN low AND high THEN 1::DOUBLE WHEN greatest(low - maturity_rank, maturity_rank - high) <= 1 THEN 0.5 ELSE 0 END
      WHEN 'runtime' THEN greatest(0, 1 - greatest(low - runtime, runtime - high, 0) / 30::DOUBLE) ELSE greatest(0, 1 - greatest(low - released, released - high, 0) / ({years})) END AS score
    FROM calls, cards WHERE route = 'metadata' AND low IS NOT NULL AND CASE kind WHEN 'maturity' THEN maturity_rank IS NOT NULL WHEN 'runtime' THEN runtime IS NOT NULL ELSE released IS NOT NULL END) WHERE score >= 0.01
  UNION ALL SELECT call_id, movie_id, {prior_of} FROM calls, popular WHERE route = 'metadata' AND low IS NULL
  UNION ALL SELECT call_id, movie_id, score FROM alike JOIN cards USING (movie_id)),
fits AS (
  SELECT request, movie_id, release_format = 3 AS short FROM requests, cards
  WHERE (released_from IS NULL OR released BETWEEN released_from AND released_to) AND (runtime_to IS NULL OR runtime <= runtime_to) AND (len(genres) = 0 OR list_has_any(genre_ids, genres))),
found AS (
  SELECT p.request, CASE WHEN generator THEN 0 ELSE tier END AS tier, call_id, e.movie_id, e.score, short
  FROM (SELECT * FROM every_score QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY score DESC, movie_id) <= 5000) e JOIN plan p USING (call_id) JOIN fits f ON f.request = p.request AND f.movie_id = e.movie_id
  WHERE p.positive AND (generator OR tier < 8) AND NOT (route = 'semantic' AND e.score <= 0)),
offered AS (SELECT DISTINCT request, CASE WHEN generator THEN 0 ELSE tier END AS tier FROM plan WHERE positive AND (generator OR tier < 8)),
fresh AS (SELECT request, tier, count(*) AS n FROM (SELECT request, movie_id, min(tier) AS tier FROM found WHERE NOT short GROUP BY 1, 2) GROUP BY 1, 2),
taken AS (
  SELECT request, tier, added FROM (
    SELECT request, tier, coalesce(n, 0) AS added, coalesce(sum(n) OVER (PARTITION BY request ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY request ORDER BY tier) AS nth, active FROM offered LEFT JOIN fresh USING (request, tier) JOIN asked USING (request))
  WHERE nth = 1 OR active AND before < 25){last}"""


_RANKED = f""",
kept AS (SELECT DISTINCT request, movie_id FROM found JOIN taken USING (request, tier) WHERE NOT short),
empty AS (SELECT request FROM asked JOIN heads USING (request) WHERE (active OR NOT generators) AND request NOT IN (SELECT request FROM kept)),
pool AS (
  SELECT * FROM kept UNION ALL SELECT request, movie_id FROM (
    SELECT request, movie_id, round(0.8::DOUBLE * popularity + 0.2::DOUBLE * least(greatest(reception / 100, 0), 1), 6) AS prior FROM empty JOIN fits USING (request) JOIN popular USING (movie_id) WHERE NOT short)
  QUALIFY row_number() OVER (PARTITION BY request ORDER BY prior DESC, movie_id DESC) <= {SEED_LIMIT}),
live AS (SELECT p.*, NOT p.generator AND t.tier IS NOT NULL AND p.positive AND p.tier < 8 AS promoted, p.generator OR (t.tier IS NOT NULL AND p.positive AND p.tier < 8) AS generating FROM plan p LEFT JOIN taken t ON t.request = p.request AND t.tier = p.tier),
scored AS (
  SELECT l.*, movie_id, score FROM live l JOIN found f USING (call_id) JOIN pool USING (movie_id) WHERE generating AND pool.request = l.request
  UNION ALL SELECT l.*, movie_id, score FROM live l JOIN every_score USING (call_id) JOIN pool USING (movie_id) WHERE NOT generating AND pool.request = l.request),
folded AS (
  SELECT s.request, s.trait, s.category, s.place, movie_id, CASE s.fold WHEN 'SINGLE' THEN coalesce(max(score) FILTER (WHERE call = 0), 0) WHEN 'ADDITIVE' THEN CASE WHEN count(*) = any_value(n) THEN product(score) ELSE 0 END
    WHEN 'ALTERNATIVES' THEN max(score) ELSE exp((sum(ln(greatest(score, 0.1))) + (any_value(n) - count(*)) * ln(0.1)) / any_value(n)) END AS score
  FROM scored s JOIN (SELECT request, trait, place, count(*) AS n FROM live WHERE positive GROUP BY 1, 2, 3) USING (request, trait, place) WHERE positive GROUP BY 1, 2, 3, 4, 5, s.fold),
kinds AS (
  SELECT request, trait, mode, commitment, n, fst, CASE WHEN mode = 'FACETS' OR (mode = 'FRAMINGS' AND any_c) OR (mode = 'SOLO' AND solo_c) THEN 0.1::DOUBLE ELSE 0 END AS base
  FROM traits t JOIN (SELECT request, trait, count(DISTINCT place) AS n, min(place) AS fst, bool_or(fold = 'CONSENSUS') AS any_c, min_by(fold = 'CONSENSUS', place) AS solo_c FROM live WHERE positive GROUP BY 1, 2) USING (request, trait) WHERE t.positive),
by_trait AS (
  SELECT request, trait, movie_id, CASE any_value(mode) WHEN 'SOLO' THEN coalesce(max(score) FILTER (WHERE place = fst), any_value(base)) WHEN 'FRAMINGS' THEN greatest(max(score), any_value(base))
    ELSE exp((sum(ln(greatest(score, 0.1))) + (any_value(n) - count(*)) * ln(0.1)) / any_value(n)) END - any_value(base) AS score
  FROM folded JOIN kinds USING (request, trait) GROUP BY 1, 2, 3),
pure AS (SELECT request, trait FROM live WHERE positive GROUP BY 1, 2 HAVING bool_and(generating)),
rare AS (
  SELECT request, trait, (SELECT count(DISTINCT movie_id) FROM found f JOIN live l USING (call_id) WHERE l.request = pure.request AND l.trait = pure.trait AND (NOT promoted OR score >= 1 - 1e-6))::DOUBLE / (SELECT count(*) FROM cards) AS x FROM pure),
weights AS (
  SELECT request, trait, commitment * CASE WHEN x IS NULL THEN 1 WHEN x < 0.001 THEN 1.5 WHEN x < 0.01 THEN 1.2 WHEN x < 0.1 THEN 1 WHEN x < 0.3 THEN 0.75 ELSE 0.5 END::DOUBLE AS weight FROM traits LEFT JOIN rare USING (request, trait)),
bad AS (
  SELECT s.request, s.trait, movie_id, CASE WHEN any_value(fuzzies) = 0 THEN g WHEN any_value(gates) = 0 THEN z ELSE g * z END AS score FROM (
    SELECT request, trait, movie_id, count(*) FILTER (WHERE gate) AS met, coalesce(product(score) FILTER (WHERE gate), 1) AS gated, 1 - coalesce(product(1 - score) FILTER (WHERE NOT gate), 1) AS z FROM scored WHERE NOT positive GROUP BY 1, 2, 3) s
    JOIN (SELECT request, trait, count(*) FILTER (WHERE gate) AS gates, count(*) FILTER (WHERE NOT gate) AS fuzzies FROM live WHERE NOT positive GROUP BY 1, 2) USING (request, trait), LATERAL (SELECT CASE WHEN met = gates THEN gated ELSE 0 END AS g)
  GROUP BY 1, 2, 3, g, z),
given AS (SELECT request, sum(base * weight) AS g FROM kinds JOIN weights USING (request, trait) GROUP BY 1),
p AS (SELECT request, movie_id, sum(score * weight) AS p FROM by_trait JOIN weights USING (request, trait) GROUP BY 1, 2),
n AS (SELECT request, movie_id, sum(score * weight) AS n FROM bad JOIN weights USING (request, trait) GROUP BY 1, 2),
ends AS (SELECT pool.request, movie_id, coalesce(p, 0) + coalesce(g, 0) AS positive, 0 - coalesce(n, 0) AS negative, popular.popularity, reception, r.popularity AS by_p, r.quality AS by_q
  FROM pool LEFT JOIN p USING (request, movie_id) LEFT JOIN n USING (request, movie_id) LEFT JOIN given USING (request) JOIN popular USING (movie_id) JOIN requests r ON r.request = pool.request),
done AS (SELECT request, movie_id, round(positive, 6) AS positive, round(negative, 6) AS negative, round(positive + negative + CASE WHEN positive > 0 THEN positive ELSE 1 END * CASE WHEN by_p <> 'off'
    THEN CASE by_p WHEN 'low' THEN 0.05::DOUBLE WHEN 'medium' THEN 0.12 ELSE 0.20 END / (1 + exp(-12 * (popularity - 0.70)))
    ELSE CASE by_q WHEN 'off' THEN 0::DOUBLE WHEN 'low' THEN 0.025 WHEN 'medium' THEN 0.06 ELSE 0.10 END / (1 + exp(-0.22 * (reception - 70))) END, 6) AS score FROM ends)
SELECT request, row_number() OVER (PARTITION BY request ORDER BY score DESC, movie_id) AS rank, movie_id, positive, negative, score FROM done QUALIFY rank <= {TOP}"""
QUERIES = {
    "flow_trait_batch": (flow_trait_batch, _batch_sql(REQUESTS, _RANKED)),
    "trait_categories": (
        trait_categories,
        _batch_sql(REQUESTS, """,
kinds AS (SELECT fold, route, tier, count(*) AS n, count(*) FILTER (WHERE generates) AS generators, count(*) FILTER (WHERE gates) AS gates FROM registry GROUP BY 1, 2, 3),
found_by AS (SELECT fold, route, r.tier, count(DISTINCT movie_id) AS items FROM calls JOIN registry r USING (category, route) JOIN every_score USING (call_id) WHERE NOT (route = 'semantic' AND score <= 0) GROUP BY 1, 2, 3)
SELECT fold, route, tier, n, generators, gates, coalesce(items, 0) AS items FROM kinds LEFT JOIN found_by USING (fold, route, tier)"""),
    ),
    "flow_trait_promotions": (flow_trait_promotions, _batch_sql(REQUESTS, " SELECT request, tier, added FROM taken")),
}
