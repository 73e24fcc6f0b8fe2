"""Similar items of one anchor and of several: lanes, their weights, multipliers, and floors.

Anchors are a stated, bounded set; what is read from them on the driver is a handful of rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from . import preferences as P
from .retrieval import trait_idf
from .vector import MAX_ANCHORS, decayed, similarities, top_per_space

# Weights of the spaces (in the order of the slices), of the lanes, and their changes by kind of anchor.
SPACE_WEIGHTS = (0.45, 0.25, 1.00, 0.55, 1.00, 0.75, 0.30, 0.55)
SPACE_WEIGHTS_MULTI = (0.65, 0.35, 1.00, 0.35, 1.00, 0.65, 0.65, 0.65)
LANES = {"shape": 0.60, "franchise": 0.12, "source": 0.04, "quality": 0.06, "format": 0.04, "themes": 0.12, "cast": 0.03, "specific_award": 0.04}
SINGLE_LANES = ("shape", "franchise", "source", "quality", "format", "themes")
ADJUSTMENTS = {"cult": {"quality": 0.26, "shape": -0.10}, "prestige": {"quality": 0.16, "shape": -0.06}, "franchise": {"franchise": 0.18, "shape": -0.08}, "source": {"source": 0.08, "shape": -0.04}}
MIDDLE_QUALITY = 0.03
# Multipliers with their gates on the shape lane.
STUDIO_GATE, STUDIO_STRENGTH, ERA_FLOOR, ERA_RANGE, ERA_YEARS = 0.60, 0.10, 0.60, 0.40, 18.0
DIRECTOR_GATE, DIRECTOR_STRENGTH, DIRECTOR_FLOOR, DIRECTOR_FLOOR_GATE = 0.30, 0.30, 0.35, 0.20
COUNTRY_MATCH, COUNTRY_MISS, FORMAT_MISS, SHORT_MISS = 1.05, 0.75, 0.35, 0.30
COMBO_IDF, COMBO_FROM, COMBO_FACTOR, LEAST_MASS = 0.30, 0.30, 0.50, 1.0
# Reception and reach of the named shapes, their strengths, and how far one shape stands for another.
REACH_HIGH, REACH_LOW = 100_000, 10_000
POOR, POOR_RAZZIE, ACCLAIMED, ACCLAIMED_AWARD = 50.0, 60.0, 80.0, 65.0
STRENGTHS = {"dogshit": 0.15, "cult_garbage": 0.15, "hidden_gem": 0.15, "prestige": 0.08, "mainstream_blockbuster": 0.08}
CROSS = {
    ("prestige", "hidden_gem"): 0.7,
    ("cult_garbage", "dogshit"): 0.7,
    ("prestige", "mainstream_blockbuster"): 0.4,
    ("cult_garbage", "mainstream_blockbuster"): 0.25,
    ("mainstream_blockbuster", "hidden_gem"): 0.15,
    ("mainstream_blockbuster", "dogshit"): 0.10,
}
LEAST_COHESION = 0.5


def _ids(row: Row, name: str) -> list[int]:
    return [int(x) for x in row[name] or []]


def lane_to_max(d: DataFrame, lane: str) -> DataFrame:
    """A lane divided by its best score; a lane without a positive score is empty."""
    best = d.agg(F.max(lane).alias("_best"))
    return d.crossJoin(F.broadcast(best)).where("_best > 0").select("movie_id", S.clamp(F.col(lane) / F.col("_best")).alias(lane))


def shape_lane(vectors: DataFrame, anchors: list[int], k: int = 2000, weights: tuple[float, ...] = SPACE_WEIGHTS) -> DataFrame:
    """(movie_id, shape): decayed similarity over all spaces by their weights, divided by the best."""
    share = F.element_at(F.array(*[F.lit(w / sum(weights)) for w in weights]), (F.col("space") + 1).cast("int"))
    rows = decayed(top_per_space(similarities(vectors, anchors).where("score > 0"), k))
    return lane_to_max(rows.groupBy("movie_id").agg(F.sum(F.col("decayed") * share).alias("shape")), "shape")


def franchise_lane(anchor: Row) -> Column:
    """1 for the same lineage and a shared subgroup, .70 for the lineage, .55 for subgroup and universe, .30 for the universe alone."""
    same, group, universe = (P._any_of(F.col(c), _ids(anchor, c)) for c in ("lineage_ids", "subgroup_ids", "universe_ids"))
    return F.when(same & group, 1.0).when(same, 0.70).when(group & universe, 0.55).when(universe, 0.30).otherwise(0.0)


def quality_lane(bucket: str, reception: Column, pct: Column, non_razzie: Column, razzie: Column) -> Column:
    """The formula of the anchor's quality bucket: cult, prestige or middle."""
    r = reception
    if bucket == "cult":
        return S.clamp(0.40 * F.coalesce(S.clamp((50 - r) / 30), F.lit(0.0)) + 0.50 * S.clamp((pct - 0.75) / 0.20) + 0.10 * razzie)
    if bucket == "prestige":
        known = F.greatest(S.clamp((pct - 0.50) / 0.30), non_razzie)
        return S.clamp(0.80 * F.coalesce(S.clamp((r - 75) / 20), F.lit(0.0)) + 0.20 * known + 0.20 * non_razzie)
    return S.clamp(0.80 * pct + 0.20 * F.coalesce(r, F.lit(0.0)) / 100)


def quality_bucket(reception: float | None, pct: float) -> str:
    if reception is not None and reception <= 45 and pct >= 0.89:
        return "cult"
    return "prestige" if reception is not None and reception >= 85 and pct >= 0.75 else "middle"


def lane_weights(kinds: list[str], bucket: str, lanes: tuple[str, ...] = SINGLE_LANES) -> dict[str, float]:
    """Base weights of the lanes with the changes of the anchor's kinds, none below 0, scaled to 1; all on shape if none is left."""
    raw = {lane: LANES[lane] for lane in lanes}
    if bucket == "middle":
        raw["quality"] = MIDDLE_QUALITY
    for kind in kinds:
        for lane, change in ADJUSTMENTS.get(kind, {}).items():
            raw[lane] = raw.get(lane, 0.0) + change
    raw = {lane: max(w, 0.0) for lane, w in raw.items()}
    total = sum(raw.values())
    return {lane: w / total for lane, w in raw.items()} if total > 0 else {lane: float(lane == "shape") for lane in raw}


def shape_class(reception: Column, votes: Column, picture_award: Column, bad_razzie: Column) -> Column:
    """Named shape by reception and reach; a picture award lowers the bar of acclaim, a razzie raises that of poor."""
    low = votes < REACH_LOW
    poor = F.when(bad_razzie, POOR_RAZZIE).otherwise(POOR)
    acclaimed = F.when(picture_award, ACCLAIMED_AWARD).otherwise(ACCLAIMED)
    bad = F.when(low, "dogshit").otherwise("cult_garbage")
    good = F.when(low, "hidden_gem").otherwise("prestige")
    known = F.when(votes >= REACH_HIGH, "mainstream_blockbuster")
    unrated = F.when(bad_razzie, bad).when(picture_award, good).otherwise(known)
    return F.when(reception.isNull(), unrated).when(reception <= poor, bad).when(reception >= acclaimed, good).otherwise(known)


def shape_multiplier(cohesion: dict[str, float], shape: Column) -> Column:
    """1 + strength x cohesion, the cohesion of the anchors' shapes with the candidate's, if that is .5 or more."""
    out = F.lit(1.0)
    for name, strength in STRENGTHS.items():
        met = sum(c * (1.0 if a == name else CROSS.get((a, name), CROSS.get((name, a), 0.0))) for a, c in cohesion.items())
        if met >= LEAST_COHESION:
            out = F.when(shape == name, 1 + strength * met).otherwise(out)
    return out


def traits_of(d: DataFrame) -> DataFrame:
    """(movie_id, kind, trait_id) of keyword and genre traits."""
    keywords = d.select("movie_id", F.lit("keyword").alias("kind"), F.explode(F.col("keyword_ids").cast("array<long>")).alias("trait_id"))
    return keywords.unionByName(d.select("movie_id", F.lit("genre").alias("kind"), F.explode(F.col("genre_ids").cast("array<long>")).alias("trait_id")))


def themes_lane(traits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(movie_id, themes): idf of the shared traits over that of all wanted, at least 1, times a bonus for several rarer ones. wanted: (kind, trait_id, idf)."""
    mass = wanted.agg(F.greatest(F.lit(LEAST_MASS), F.sum("idf")).alias("mass"))
    shared = traits.join(F.broadcast(wanted), ["kind", "trait_id"]).groupBy("movie_id").agg(F.sum("idf").alias("idf"), F.sum(F.when(F.col("idf") >= COMBO_IDF, F.col("idf")).otherwise(0.0)).alias("rarer"))
    bonus = 1 + COMBO_FACTOR * F.greatest(F.lit(0.0), F.col("rarer") - COMBO_FROM)
    return shared.crossJoin(F.broadcast(mass)).where("idf > 0").select("movie_id", S.clamp(F.col("idf") / F.col("mass") * bonus).alias("themes"))


def source_lane(cards: DataFrame, anchor: Row) -> DataFrame:
    """(movie_id, source): the best idf of the shared source types."""
    sources = cards.select("movie_id", F.explode("source_ids").alias("source_id"))
    counted = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("df")).where(F.col("source_id").isin(_ids(anchor, "source_ids") or [-1]))
    total = cards.agg(F.count(F.lit(1)).alias("total"))
    idf = counted.crossJoin(total).select("source_id", (F.log(F.col("total") / F.col("df")) / F.log("total")).alias("idf"))
    return sources.join(F.broadcast(idf), "source_id").groupBy("movie_id").agg(F.max("idf").alias("source"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with the vote percentile, award flags, lead person and release year."""
    cards = C.cards(spark, sf_dir)
    won = F.exists("win_ids", lambda x: x != 10)
    return cards.select(
        "*", won.cast("double").alias("non_razzie"), F.array_contains("win_ids", 10).cast("double").alias("razzie"), F.array_contains("win_ids", 1).alias("picture"), F.year(F.timestamp_seconds("released")).alias("year")
    )


def _auteurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, directors): the curated directors of each item; here people whose number divides by 5."""
    lines = C.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_suppkey % 5 = 0")
    return lines.groupBy(F.col("l_partkey").alias("movie_id")).agg(F.collect_set("l_suppkey").alias("directors"))


ANCHOR = 12


def single_anchor_lanes(spark: SparkSession, sf_dir: str, anchor_id: int = ANCHOR) -> DataFrame:
    """Candidates of one anchor with all six lanes, the multipliers and the final score."""
    cards = _signals(spark, sf_dir)
    anchor = cards.where(F.col("movie_id") == anchor_id).first()
    if anchor is None:
        raise LookupError(f"no item {anchor_id}")
    directors = _auteurs(spark, sf_dir)
    own = directors.where(F.col("movie_id") == anchor_id).first()
    auteurs = sorted(own["directors"]) if own else []
    bucket = quality_bucket(anchor["reception"], anchor["pct"])
    kinds = [k for k, on in (("cult", bucket == "cult"), ("prestige", bucket == "prestige"), ("franchise", bool(anchor["lineage_ids"])), ("source", bool(anchor["source_ids"]))) if on]
    weights = lane_weights(kinds, bucket)

    wanted = trait_idf(cards).join(F.broadcast(traits_of(cards.where(F.col("movie_id") == anchor_id)).select("kind", "trait_id")), ["kind", "trait_id"]).select("kind", "trait_id", "idf")
    others = cards.where(F.col("movie_id") != anchor_id)
    lanes = shape_lane(C.vectors(spark, sf_dir), [anchor_id])
    themes, source = themes_lane(traits_of(others), wanted), source_lane(cards, anchor)
    d = others.join(lanes, "movie_id").join(themes, "movie_id", "left").join(source, "movie_id", "left").join(directors, "movie_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = d.select(
        "movie_id",
        "shape",
        franchise_lane(anchor).alias("franchise"),
        zero(F.col("source")).alias("source"),
        quality_lane(bucket, F.col("reception"), F.col("pct"), F.col("non_razzie"), F.col("razzie")).alias("quality"),
        (F.col("release_format") == anchor["release_format"]).cast("double").alias("format"),
        zero(F.col("themes")).alias("themes"),
        F.when(P._any_of(F.coalesce("directors", F.array().cast("array<long>")), auteurs), 1.0).otherwise(0.0).alias("director"),
        F.when(F.col("company") == anchor["company"], ERA_FLOOR + ERA_RANGE * F.exp(-F.abs(F.col("year") - anchor["year"]) / ERA_YEARS)).otherwise(0.0).alias("studio"),
        F.when(P._any_of(F.col("language_ids"), _ids(anchor, "language_ids")), COUNTRY_MATCH).otherwise(COUNTRY_MISS).alias("country"),
        F.when((F.col("release_format") == 3) & F.lit(anchor["release_format"] != 3), SHORT_MISS).otherwise(1.0).alias("short"),
        shape_class(F.col("reception"), F.col("votes") * 1000, F.col("picture"), F.col("razzie") > 0).alias("class"),
    )
    anchor_class = spark.createDataFrame([(anchor["reception"], anchor["votes"] * 1000, bool(anchor["picture"]), anchor["razzie"] > 0)], "r double, v long, p boolean, z boolean").select(shape_class(F.col("r"), F.col("v"), F.col("p"), F.col("z"))).first()[0]
    base = sum((w * F.col(lane) for lane, w in weights.items()), F.lit(0.0))
    boost = F.when(F.col("shape") >= STUDIO_GATE, 1 + STUDIO_STRENGTH * F.col("studio")).otherwise(1.0) * F.when(F.col("shape") >= DIRECTOR_GATE, 1 + DIRECTOR_STRENGTH * F.col("director")).otherwise(1.0)
    factor = boost * F.col("country") * F.when(F.col("format") == 1, 1.0).otherwise(FORMAT_MISS) * F.col("short") * shape_multiplier({anchor_class: 1.0} if anchor_class else {}, F.col("class"))
    floor = F.when((F.col("director") == 1) & (F.col("shape") >= DIRECTOR_FLOOR_GATE), DIRECTOR_FLOOR).otherwise(0.0)
    order = sorted(weights, key=lambda lane: list(LANES).index(lane))
    lead = F.array_max(F.array(*[F.struct((weights[lane] * F.col(lane)).alias("x"), F.col(lane).alias("raw"), F.lit(-i).alias("at"), F.lit(lane).alias("lane")) for i, lane in enumerate(order)]))["lane"]
    return d.withColumn("base", base).withColumn("score", F.greatest(base * factor, floor)).withColumn("lane", lead)


def sim_single_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = single_anchor_lanes(spark, sf_dir)
    rounded = [C.r6(F.col(c)).alias(c) for c in ("shape", "franchise", "source", "quality", "format", "themes", "base", "score")]
    return d.select("movie_id", *rounded, "director", "class").orderBy(F.desc("score"), "movie_id").limit(100)


def sim_shape_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_lane(C.vectors(spark, sf_dir), [ANCHOR]).select("movie_id", C.r6(F.col("shape")).alias("shape"))


# Several anchors.

ANCHORS = (3, 8, 12, 20)


def repetition(ratio: Column) -> Column:
    """2 ln(1 + 9 r) / ln 10 for a trait that a share r of the anchors has."""
    return 2 * F.log1p(9 * ratio) / math.log(10)


def trait_cohesion(traits: DataFrame, n: int) -> DataFrame:
    """(kind, cohesion): by kind, of the trait that most anchors share; 0 if none is shared by two. traits: (movie_id, kind, trait_id) of the n anchors."""
    counted = traits.groupBy("kind", "trait_id").agg(F.countDistinct("movie_id").alias("m"))
    return counted.groupBy("kind").agg(F.max("m").alias("m")).select("kind", F.when(F.col("m") < 2, 0.0).otherwise(repetition(F.col("m") / n)).alias("cohesion"))


def cast_lane(candidates: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(movie_id, cast, floor, weight): share of the leads that two anchors or more have in common. Both: (movie_id, term) of the three best billed."""
    shared = anchors.groupBy("term").agg(F.countDistinct("movie_id").alias("m")).where("m >= 2")
    whole = shared.agg(F.count(F.lit(1)).alias("leads"), (F.max("m") / n).alias("ratio"))
    met = candidates.join(F.broadcast(shared), "term").groupBy("movie_id").agg(F.countDistinct("term").alias("hits"))
    r = F.col("ratio")
    return met.crossJoin(F.broadcast(whole)).select("movie_id", (F.col("hits") / F.col("leads")).alias("cast"), F.when(r >= 0.5, 0.25 + 0.20 * r).otherwise(0.0).alias("floor"), (0.05 + 0.10 * r).alias("weight"))


def director_lane(candidates: DataFrame, anchors: DataFrame, n: int, curated: Column) -> DataFrame:
    """(movie_id, director, ratio): .67 + .33 r for a curated director of a share r of the anchors, .33 r for others of two or more; the best one."""
    counted = anchors.groupBy("term").agg((F.countDistinct("movie_id") / n).alias("r"), F.countDistinct("movie_id").alias("m"))
    worth = F.when(curated, 0.67 + 0.33 * F.col("r")).when(F.col("m") >= 2, 0.33 * F.col("r")).otherwise(0.0)
    return candidates.join(F.broadcast(counted), "term").groupBy("movie_id").agg(F.max(worth).alias("director"), F.max("r").alias("ratio"))


def sim_multi_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast, director, themes, source and country lanes of every candidate of four anchors that has one."""
    n, named = len(ANCHORS), F.col("movie_id").isin(*ANCHORS)
    cards = C.cards(spark, sf_dir)
    billed = C.person_postings(spark, sf_dir).where("position <= 3").select("movie_id", "term")
    lines = C.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("movie_id"), F.col("l_suppkey").alias("term")).distinct()
    cast = cast_lane(billed.where(~named), billed.where(named), n)
    director = director_lane(lines.where(~named), lines.where(named), n, F.col("term") % 5 == 0)
    repeated = traits_of(cards.where(named)).groupBy("kind", "trait_id").agg(F.countDistinct("movie_id").alias("m")).where("m >= 2").select("kind", "trait_id")
    themes = themes_lane(traits_of(cards.where(~named)), trait_idf(cards).join(F.broadcast(repeated), ["kind", "trait_id"]).select("kind", "trait_id", "idf"))
    country = cards.where(named).select(F.explode("language_ids").alias("c"), "movie_id").groupBy("c").agg(F.countDistinct("movie_id").alias("m")).where("m >= 2").agg(F.collect_set("c").alias("agreed"))
    d = cards.where(~named).crossJoin(F.broadcast(country)).select("movie_id", F.when(F.arrays_overlap("language_ids", "agreed"), COUNTRY_MATCH).otherwise(COUNTRY_MISS).alias("country"))
    d = d.join(cast, "movie_id", "left").join(director, "movie_id", "left").join(themes, "movie_id", "left")
    filled = [C.r6(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("cast", "floor", "director", "ratio", "themes")]
    return d.where("cast IS NOT NULL OR director IS NOT NULL OR themes IS NOT NULL").select("movie_id", "country", *filled)


def sim_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion of the anchors' keywords, genres, sources, formats and languages."""
    cards = C.cards(spark, sf_dir).where(F.col("movie_id").isin(*ANCHORS))
    kinds = {"keyword": "keyword_ids", "genre": "genre_ids", "source": "source_ids", "language": "language_ids", "tag": "tag_ids"}
    traits = [cards.select("movie_id", F.lit(k).alias("kind"), F.explode(F.col(c).cast("array<long>")).alias("trait_id")) for k, c in kinds.items()]
    traits.append(cards.select("movie_id", F.lit("format").alias("kind"), F.col("release_format").cast("long").alias("trait_id")))
    return trait_cohesion(reduce(DataFrame.unionByName, traits), len(ANCHORS)).select("kind", C.r6(F.col("cohesion")).alias("cohesion"))


def centroid_lane(vectors: DataFrame, anchors: list[int], weights: tuple[float, ...] = SPACE_WEIGHTS_MULTI) -> DataFrame:
    """(movie_id, shape): similarity to the mean of the anchors' unit vectors, in the spaces that all anchors have, by base and cohesion weights."""
    if len(anchors) > MAX_ANCHORS:
        raise ValueError(f"at most {MAX_ANCHORS} anchors")
    v = F.col("vector")
    unit = vectors.select("movie_id", "space", F.transform(v, lambda x: x / F.col("norm")).alias("unit"))
    heads = unit.where(F.col("movie_id").isin(anchors))
    whole = heads.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(anchors)).select("space")
    heads = heads.join(F.broadcast(whole), "space", "left_semi")
    mean = heads.select("space", F.posexplode("unit")).groupBy("space", "pos").agg(F.avg("col").alias("x")).groupBy("space").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("head"))
    a, b = heads.select("space", F.col("movie_id").alias("a"), F.col("unit").alias("ua")), heads.select("space", F.col("movie_id").alias("b"), F.col("unit").alias("ub"))
    close = a.join(b, "space").where("a < b").groupBy("space").agg(F.avg(S.dot(F.col("ua"), F.col("ub"))).alias("c"))
    base = F.element_at(F.array(*[F.lit(w / sum(weights)) for w in weights]), (F.col("space") + 1).cast("int"))
    tied = close.select("space", (0.75 * S.clamp((F.col("c") - 0.55) / 0.30, 0.10, 1.0) + 0.25 * base).alias("w"))
    share = tied.crossJoin(tied.agg(F.sum("w").alias("all"))).select("space", (F.col("w") / F.col("all")).alias("w"))
    scored = unit.where(~F.col("movie_id").isin(anchors)).join(F.broadcast(mean.join(share, "space")), "space")
    scored = scored.select(F.lit(0).alias("anchor"), "space", "movie_id", "w", F.least(F.lit(1.0), S.dot(F.col("unit"), F.col("head")) / S.norm(F.col("head"))).alias("score")).where("score > 0")
    return lane_to_max(decayed(top_per_space(scored, 2000)).groupBy("movie_id").agg(F.sum(F.col("decayed") * F.col("w")).alias("shape")), "shape")


def sim_multi_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_lane(C.vectors(spark, sf_dir), list(ANCHORS)).select("movie_id", C.r6(F.col("shape")).alias("shape"))


def _single_sql() -> str:
    """The single-anchor flow, with the anchor's own rows as scalar subqueries."""
    share = "[" + ", ".join(f"{w / sum(SPACE_WEIGHTS)}::DOUBLE" for w in SPACE_WEIGHTS) + "]"
    a = f"(SELECT {{}} FROM sig WHERE movie_id = {ANCHOR})"
    has = lambda c: f"list_has_any({c}, {a.format(c)})"
    klass = """CASE WHEN reception <= CASE WHEN razzie > 0 THEN 60 ELSE 50 END THEN CASE WHEN votes * 1000 < 10000 THEN 'dogshit' ELSE 'cult_garbage' END
    WHEN reception >= CASE WHEN picture THEN 65 ELSE 80 END THEN CASE WHEN votes * 1000 < 10000 THEN 'hidden_gem' ELSE 'prestige' END
    WHEN votes * 1000 >= 100000 THEN 'mainstream_blockbuster' END"""
    kinds = lambda lane: " + ".join(
        [f"{LANES[lane]}::DOUBLE" if lane != "quality" else f"CASE WHEN bucket = 'middle' THEN {MIDDLE_QUALITY} ELSE {LANES['quality']} END::DOUBLE"]
        + [f"CASE WHEN {k}_kind THEN {change.get(lane, 0)} ELSE 0 END::DOUBLE" for k, change in ADJUSTMENTS.items()]
    )
    raw = ", ".join(f"greatest({kinds(lane)}, 0) AS w_{lane}" for lane in SINGLE_LANES)
    total = "(" + " + ".join(f"w_{lane}" for lane in SINGLE_LANES) + ")"
    base = " + ".join(f"w_{lane} / {total} * l.{lane}" for lane in SINGLE_LANES)
    cross = "CASE " + " ".join(f"WHEN class = '{c}' AND a.class_a = '{b}' THEN {1 + STRENGTHS[c] * m}::DOUBLE" for c in STRENGTHS for b in STRENGTHS if (m := 1.0 if b == c else CROSS.get((b, c), CROSS.get((c, b), 0.0))) >= LEAST_COHESION) + " ELSE 1 END"
    return f"""WITH{C.CARDS},{C.VECTORS},
sig AS (SELECT *, percent_rank() OVER (ORDER BY votes) AS pct, (len(list_filter(win_ids, lambda x: x <> 10)) > 0)::INT::DOUBLE AS non_razzie, list_contains(win_ids, 10)::INT::DOUBLE AS razzie,
  list_contains(win_ids, 1) AS picture, year(make_timestamp(released * 1000000)) AS year FROM cards),
scored AS (SELECT h.movie_id AS anchor, v.space, v.movie_id, list_cosine_similarity(v.vector, h.vector) AS score FROM vectors v JOIN vectors h ON v.space = h.space
  WHERE h.movie_id = {ANCHOR} AND v.movie_id <> {ANCHOR} AND list_cosine_similarity(v.vector, h.vector) > 0),
top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY space ORDER BY score DESC, movie_id) <= 2000),
ends AS (SELECT *, max(score) OVER (PARTITION BY space) AS hi, min(score) OVER (PARTITION BY space) AS lo FROM top),
raw_shape AS (SELECT movie_id, sum(CASE WHEN hi = lo THEN 1 ELSE exp(-3 * (hi - score) / (hi - lo)) END * {share}[space + 1]) AS s FROM ends GROUP BY 1),
lane_shape AS (SELECT movie_id, s / (SELECT max(s) FROM raw_shape) AS shape FROM raw_shape),
tr AS (SELECT movie_id, 'keyword' AS kind, CAST(unnest(keyword_ids) AS BIGINT) AS t FROM cards UNION ALL SELECT movie_id, 'genre', CAST(unnest(genre_ids) AS BIGINT) FROM cards),
idf AS (SELECT kind, t, ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)) AS idf FROM tr GROUP BY 1, 2),
want AS (SELECT kind, t, idf FROM tr JOIN idf USING (kind, t) WHERE movie_id = {ANCHOR}),
sh AS (SELECT movie_id, sum(idf) AS i, sum(CASE WHEN idf >= 0.3 THEN idf ELSE 0 END) AS rarer FROM tr JOIN want USING (kind, t) WHERE movie_id <> {ANCHOR} GROUP BY 1),
lane_themes AS (SELECT movie_id, least(1, i / greatest(1, (SELECT sum(idf) FROM want)) * (1 + 0.5 * greatest(0, rarer - 0.3))) AS themes FROM sh WHERE i > 0),
src AS (SELECT movie_id, unnest(source_ids) AS s FROM cards), sidf AS (SELECT s, ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)) AS idf FROM src GROUP BY 1),
lane_source AS (SELECT movie_id, max(idf) AS source FROM src JOIN sidf USING (s) WHERE s IN (SELECT s FROM src WHERE movie_id = {ANCHOR}) GROUP BY 1),
dirs AS (SELECT DISTINCT l_partkey AS movie_id, l_suppkey AS d FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 = 0),
lane_dir AS (SELECT DISTINCT movie_id, 1::DOUBLE AS director FROM dirs WHERE d IN (SELECT d FROM dirs WHERE movie_id = {ANCHOR})),
a AS (SELECT *, {klass} AS class_a, CASE WHEN reception <= 45 AND pct >= 0.89 THEN 'cult' WHEN reception >= 85 AND pct >= 0.75 THEN 'prestige' ELSE 'middle' END AS bucket FROM sig WHERE movie_id = {ANCHOR}),
k AS (SELECT bucket, bucket = 'cult' AS cult_kind, bucket = 'prestige' AS prestige_kind, len(lineage_ids) > 0 AS franchise_kind, len(source_ids) > 0 AS source_kind FROM a), w AS (SELECT {raw} FROM k),
l AS (SELECT sig.movie_id, shape,
  CASE WHEN {has("sig.lineage_ids")} AND {has("sig.subgroup_ids")} THEN 1 WHEN {has("sig.lineage_ids")} THEN 0.70 WHEN {has("sig.subgroup_ids")} AND {has("sig.universe_ids")} THEN 0.55 WHEN {has("sig.universe_ids")} THEN 0.30 ELSE 0 END::DOUBLE AS franchise,
  coalesce(source, 0) AS source, CASE k.bucket WHEN 'cult' THEN least(1, 0.40 * least(greatest((50 - reception) / 30, 0), 1) + 0.50 * least(greatest((pct - 0.75) / 0.20, 0), 1) + 0.10 * razzie)
    WHEN 'prestige' THEN least(1, 0.80 * least(greatest((reception - 75) / 20, 0), 1) + 0.20 * greatest(least(greatest((pct - 0.50) / 0.30, 0), 1), non_razzie) + 0.20 * non_razzie)
    ELSE least(1, 0.80 * pct + 0.20 * reception / 100) END AS quality,
  (release_format = {a.format("release_format")})::INT::DOUBLE AS format, coalesce(themes, 0) AS themes, coalesce(director, 0) AS director,
  CASE WHEN company = {a.format("company")} THEN 0.6 + 0.4 * exp(-abs(year - {a.format("year")}) / 18.0::DOUBLE) ELSE 0 END AS studio, CASE WHEN {has("sig.language_ids")} THEN 1.05 ELSE 0.75 END::DOUBLE AS country,
  CASE WHEN release_format = 3 AND {a.format("release_format")} <> 3 THEN 0.3 ELSE 1 END::DOUBLE AS short, {klass} AS class
  FROM sig JOIN lane_shape USING (movie_id) LEFT JOIN lane_themes USING (movie_id) LEFT JOIN lane_source USING (movie_id) LEFT JOIN lane_dir USING (movie_id), k),
b AS (SELECT l.*, {base} AS base, {cross} AS cross_m FROM l, w, a),
f AS (SELECT *, greatest(base * CASE WHEN shape >= 0.6 THEN 1 + 0.1 * studio ELSE 1 END * CASE WHEN shape >= 0.3 THEN 1 + 0.3 * director ELSE 1 END * country * CASE WHEN format = 1 THEN 1 ELSE 0.35 END * short * cross_m,
  CASE WHEN director = 1 AND shape >= 0.2 THEN 0.35 ELSE 0 END) AS final FROM b)
SELECT movie_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("shape", "franchise", "source", "quality", "format", "themes", "base"))}, round(final, 6) AS score, director, class FROM f ORDER BY score DESC, movie_id LIMIT 100"""


_IN = f"IN {ANCHORS}"
_MULTI = f"""WITH{C.CARDS},{C.POSTINGS}, billed AS (SELECT movie_id, term FROM postings WHERE position <= 3),
leads AS (SELECT term, count(DISTINCT movie_id) AS m FROM billed WHERE movie_id {_IN} GROUP BY 1 HAVING m >= 2),
c AS (SELECT movie_id, count(DISTINCT term)::DOUBLE / (SELECT count(*) FROM leads) AS "cast", (SELECT max(m) / 4::DOUBLE FROM leads) AS r FROM billed JOIN leads USING (term) WHERE movie_id NOT {_IN} GROUP BY 1),
lines AS (SELECT DISTINCT l_partkey AS movie_id, l_suppkey AS term FROM lineitem WHERE l_linenumber = 1),
dm AS (SELECT term, count(DISTINCT movie_id) AS m FROM lines WHERE movie_id {_IN} GROUP BY 1),
d AS (SELECT movie_id, max(CASE WHEN term % 5 = 0 THEN 0.67 + 0.33 * m / 4::DOUBLE WHEN m >= 2 THEN 0.33 * m / 4::DOUBLE ELSE 0 END) AS director, max(m / 4::DOUBLE) AS ratio FROM lines JOIN dm USING (term) WHERE movie_id NOT {_IN} GROUP BY 1),
tr AS (SELECT movie_id, 'keyword' AS kind, CAST(unnest(keyword_ids) AS BIGINT) AS t FROM cards UNION ALL SELECT movie_id, 'genre', CAST(unnest(genre_ids) AS BIGINT) FROM cards),
idf AS (SELECT kind, t, ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)) AS idf FROM tr GROUP BY 1, 2),
want AS (SELECT kind, t, idf FROM idf WHERE (kind, t) IN (SELECT (kind, t) FROM tr WHERE movie_id {_IN} GROUP BY kind, t HAVING count(DISTINCT movie_id) >= 2)),
sh AS (SELECT movie_id, sum(idf) AS i, sum(CASE WHEN idf >= 0.3 THEN idf ELSE 0 END) AS rarer FROM tr JOIN want USING (kind, t) WHERE movie_id NOT {_IN} GROUP BY 1),
th AS (SELECT movie_id, least(1, i / greatest(1, (SELECT sum(idf) FROM want)) * (1 + 0.5 * greatest(0, rarer - 0.3))) AS themes FROM sh WHERE i > 0),
lang AS (SELECT l FROM (SELECT movie_id, unnest(language_ids) AS l FROM cards WHERE movie_id {_IN}) GROUP BY 1 HAVING count(DISTINCT movie_id) >= 2)
SELECT movie_id, CASE WHEN list_has_any(language_ids, (SELECT list(l) FROM lang)) THEN 1.05::DOUBLE ELSE 0.75 END AS country, round(coalesce("cast", 0), 6) AS "cast",
  round(coalesce(CASE WHEN r >= 0.5 THEN 0.25 + 0.2 * r ELSE 0 END, 0), 6) AS floor, round(coalesce(director, 0), 6) AS director, round(coalesce(ratio, 0), 6) AS ratio, round(coalesce(themes, 0), 6) AS themes
FROM cards LEFT JOIN c USING (movie_id) LEFT JOIN d USING (movie_id) LEFT JOIN th USING (movie_id) WHERE movie_id NOT {_IN} AND ("cast" IS NOT NULL OR director IS NOT NULL OR themes IS NOT NULL)"""
_COHESION = (
    f"WITH{C.CARDS}, t AS ("
    + " UNION ALL ".join([f"SELECT movie_id, '{k}' AS kind, CAST(unnest({c}) AS BIGINT) AS t FROM cards WHERE movie_id {_IN}" for k, c in (("keyword", "keyword_ids"), ("genre", "genre_ids"), ("source", "source_ids"), ("language", "language_ids"), ("tag", "tag_ids"))])
    + f" UNION ALL SELECT movie_id, 'format', release_format FROM cards WHERE movie_id {_IN}), m AS (SELECT kind, t, count(DISTINCT movie_id) AS m FROM t GROUP BY 1, 2)"
    + " SELECT kind, round(CASE WHEN max(m) < 2 THEN 0 ELSE 2 * ln(1 + 9 * max(m) / 4::DOUBLE) / ln(10) END, 6) AS cohesion FROM m GROUP BY 1"
)
_SHARES = "[" + ", ".join(f"{w / sum(SPACE_WEIGHTS_MULTI)}::DOUBLE" for w in SPACE_WEIGHTS_MULTI) + "]"
_CENTROID = f"""WITH{C.VECTORS}, u AS (SELECT movie_id, space, [x / sqrt(list_sum([y * y FOR y IN vector])) FOR x IN vector] AS u FROM vectors),
h AS (SELECT * FROM u WHERE movie_id {_IN}), mean AS (SELECT space, list(x ORDER BY i) AS head FROM (SELECT space, i, avg(u[i]) AS x FROM h, range(1, {C.DIMS + 1}) r(i) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT a.space, avg(list_dot_product(a.u, b.u)) AS c FROM h a JOIN h b ON a.space = b.space AND a.movie_id < b.movie_id GROUP BY 1),
w AS (SELECT space, 0.75 * least(greatest((c - 0.55) / 0.30, 0.10), 1) + 0.25 * {_SHARES}[space + 1] AS w FROM c),
s AS (SELECT u.space, movie_id, w / (SELECT sum(w) FROM w) AS w, least(1, list_cosine_similarity(u.u, head)) AS score FROM u JOIN mean USING (space) JOIN w USING (space) WHERE movie_id NOT {_IN}),
e AS (SELECT *, max(score) OVER (PARTITION BY space) AS hi, min(score) OVER (PARTITION BY space) AS lo FROM (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY space ORDER BY score DESC, movie_id) <= 2000)),
r AS (SELECT movie_id, sum(w * CASE WHEN hi = lo THEN 1 ELSE exp(-3 * (hi - score) / (hi - lo)) END) AS x FROM e GROUP BY 1)
SELECT movie_id, round(x / (SELECT max(x) FROM r), 6) AS shape FROM r"""
QUERIES = {
    "sim_shape_lane": (sim_shape_lane, _single_sql().split(",\ntr AS (")[0] + " SELECT movie_id, round(shape, 6) AS shape FROM lane_shape"),
    "sim_single_anchor": (sim_single_anchor, _single_sql()),
    "sim_multi_lanes": (sim_multi_lanes, _MULTI),
    "sim_multi_shape": (sim_multi_shape, _CENTROID),
    "sim_cohesion": (sim_cohesion, _COHESION),
}
