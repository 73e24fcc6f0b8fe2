"""Vector scores over several spaces: blends and weights of the first scorer, calibrated carvers and qualifiers of the second.

Each space's query is one vector; similarities stay per (space, item) until they are folded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from .vector import decayed, similarities, top_per_space

# Blend of subquery and original, weights by relevance, share of the anchor space; probe, elbow and rescale bounds.
SUBQUERY, ORIGINAL = 0.8, 0.2
RELEVANCE = {"none": 0.0, "small": 1.0, "medium": 2.0, "large": 3.0}
ANCHOR_SHARE = 0.8
PROBE, LEAST_PROBE, FLAT, FLAT_ELBOW, FLOOR = 2000, 20, 0.05, 0.85, 0.9
SPAN_LEAST, SPAN_DIVISOR, EARLY_KNEE = 5, 100, 10
TOP_BAND, NO_SPREAD = 0.85, 0.01
CENTRAL, SUPPORTING = 2.0, 1.0


def space_weights(relevance: dict[int, str], subqueries: set[int], anchor: int = 0) -> dict[int, tuple[float, bool, bool]]:
    """By space: weight, whether the original ran, whether the subquery ran. A subquery lifts an irrelevant space to small; the anchor space, which only
    runs the original, has .8 of the mean of the active others; weights add up to 1."""
    raw, ran = {}, {}
    for space, size in relevance.items():
        if space != anchor:
            effective = "small" if size == "none" and space in subqueries else size
            raw[space], ran[space] = RELEVANCE[effective], (size != "none", space in subqueries)
    active = [w for w in raw.values() if w > 0]
    raw[anchor], ran[anchor] = (ANCHOR_SHARE * sum(active) / len(active) if active else 1.0), (True, False)
    total = sum(raw.values())
    return {space: (w / total, *ran[space]) for space, w in raw.items()}


def blended(original: DataFrame, subquery: DataFrame, plan: DataFrame) -> DataFrame:
    """(space, movie_id, score, weight): the blend of both probes where both ran, else the one that ran; scores of 0 and less are left out.

    plan: (space, weight, original, subquery); a probe that did not find an item counts 0.
    """
    both = original.select("space", "movie_id", F.col("score").alias("o")).join(subquery.select("space", "movie_id", F.col("score").alias("q")), ["space", "movie_id"], "full_outer")
    d = both.join(F.broadcast(plan.where("original OR subquery")), "space")
    o, q = F.coalesce("o", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    score = F.when(F.col("original") & F.col("subquery"), SUBQUERY * q + ORIGINAL * o).when(F.col("original"), o).otherwise(q)
    return d.select("space", "movie_id", score.alias("score"), "weight").where("score > 0")


def weighted_total(rows: DataFrame) -> DataFrame:
    """(movie_id, score): weighted sum over the spaces of scores that decay from each space's best."""
    spread = decayed(rows.withColumn("anchor", F.lit(0)))
    return spread.groupBy("movie_id").agg(F.sum(F.col("decayed") * F.col("weight")).alias("score"))


def ewma(values: np.ndarray, span: int) -> np.ndarray:
    out, alpha = np.empty(len(values)), 2.0 / (span + 1)
    out[0] = values[0]
    for i in range(1, len(values)):
        out[i] = alpha * values[i] + (1 - alpha) * out[i - 1]
    return out


def knees(values: np.ndarray, sensitivity: float = 1.0) -> list[int]:
    """Knees of a falling convex curve by the Kneedle rule: maxima of the difference to the diagonal after which it falls by the sensitivity's margin before it rises to another."""
    n = len(values)
    low, high = float(values.min()), float(values.max())
    if n < 3 or high <= low:
        return []
    difference = (1 - (values - low) / (high - low)) - np.arange(n) / (n - 1)
    margin = sensitivity / (n - 1)
    found, at, threshold = [], None, 0.0
    for i in range(1, n):
        peak = i < n - 1 and difference[i] >= difference[i - 1] and difference[i] >= difference[i + 1] and difference[i] > 0
        if peak and (at is None or difference[i] > difference[at]):
            at, threshold = i, difference[i] - margin
        elif at is not None and difference[i] < threshold:
            found.append(at)
            at = None
    return found


def calibrate(values: np.ndarray) -> tuple[float, float, bool]:
    """(elbow, floor, raw) of similarities in falling order: raw if there is nothing to calibrate on, a fixed share of the best for short and flat curves."""
    if not len(values) or values[0] <= 0:
        return 0.0, 0.0, True
    elbow = FLAT_ELBOW * float(values[0])
    if len(values) >= LEAST_PROBE and values[0] - values[-1] >= FLAT:
        at = knees(ewma(values, max(SPAN_LEAST, len(values) // SPAN_DIVISOR)))
        if at:
            chosen = at[1] if at[0] < EARLY_KNEE and len(at) >= 2 else at[0]
            found = float(np.clip(values[chosen], 0, 1))
            elbow = found if found > 0 else elbow
    return elbow, FLOOR * elbow, False


def calibrations(scored: DataFrame) -> DataFrame:
    """(anchor, space, elbow, floor, raw) from each space's best PROBE similarities; a group holds no more than these."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        elbow, floor, raw = calibrate(np.sort(rows["score"].to_numpy())[::-1])
        return pd.DataFrame({"anchor": [rows["anchor"].iloc[0]], "space": [rows["space"].iloc[0]], "elbow": [elbow], "floor": [floor], "raw": [raw]})

    return top_per_space(scored, PROBE).groupBy("anchor", "space").applyInPandas(one, "anchor long, space int, elbow double, floor double, raw boolean")


def elbow_decay(score: Column) -> Column:
    """1 from the elbow up, 0 from the floor down, linear between; the clamped similarity if raw. Needs columns elbow, floor and raw."""
    between = (score - F.col("floor")) / (F.col("elbow") - F.col("floor"))
    return F.when(F.col("raw"), S.clamp(score)).when(score >= F.col("elbow"), 1.0).when(score <= F.col("floor"), 0.0).otherwise(between)


def pool_rescale(rows: DataFrame) -> DataFrame:
    """Min to max rescale of scores within each space of a pool; the top band is 1, and a space without spread is 1 throughout."""
    ends = rows.groupBy("space").agg(F.min("score").alias("_low"), (F.max("score") - F.min("score")).alias("_spread"))
    scaled = (F.col("score") - F.col("_low")) / F.col("_spread")
    value = F.when(F.col("_spread") < NO_SPREAD, 1.0).when(scaled >= TOP_BAND, 1.0).otherwise(scaled)
    return rows.join(F.broadcast(ends), "space").withColumn("score", value).drop("_low", "_spread")


def max_fold(rows: DataFrame) -> DataFrame:
    """Best score over the spaces, at least 0."""
    return rows.groupBy("movie_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def weighted_fold(rows: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Weighted mean over all asked spaces; a missing one counts 0."""
    by_space = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return rows.groupBy("movie_id").agg(S.clamp(F.sum(F.col("score") * by_space[F.col("space").cast("int")]) / sum(weights.values())).alias("score"))


# Registered queries.

_RELEVANCE = {1: "large", 2: "none", 3: "medium", 4: "none", 5: "small", 6: "none", 7: "large"}
_SUBQUERIES = {1, 4, 7}
_SPACES = {1: CENTRAL, 3: SUPPORTING, 5: SUPPORTING}


def _probe(spark: SparkSession, sf_dir: str, anchor: int, k: int) -> DataFrame:
    return top_per_space(similarities(C.vectors(spark, sf_dir), [anchor]), k)


def sem_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scorer: originals by item 2, subqueries by item 5, over all eight spaces."""
    plan = space_weights(_RELEVANCE, _SUBQUERIES)
    table = spark.createDataFrame([(s, *x) for s, x in plan.items()], "space int, weight double, original boolean, subquery boolean")
    rows = blended(_probe(spark, sf_dir, 2, 100), _probe(spark, sf_dir, 5, 100).where(F.col("space").isin(*_SUBQUERIES)), table)
    return weighted_total(rows).select("movie_id", C.r6(F.col("score")).alias("score"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(C.vectors(spark, sf_dir), [9]).where(F.col("space").isin(*_SPACES))


def sem_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualifier over a pool: rescaled within the pool, then the weighted mean of three spaces."""
    pool = _asked(spark, sf_dir).where("movie_id % 3 = 1")
    return weighted_fold(pool_rescale(pool), _SPACES).select("movie_id", C.r6(F.col("score")).alias("score"))


def sem_carver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carver: each space's scores against its elbow, the best over the spaces; items without any are left out."""
    scored = _asked(spark, sf_dir)
    rows = top_per_space(scored, PROBE).join(F.broadcast(calibrations(scored)), ["anchor", "space"])
    return max_fold(rows.withColumn("score", elbow_decay(F.col("score")))).where("score > 0").select("movie_id", C.r6(F.col("score")).alias("score"))


def sem_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promoted qualifier: elbow scores, then the weighted mean."""
    scored = _asked(spark, sf_dir)
    rows = top_per_space(scored, PROBE).join(F.broadcast(calibrations(scored)), ["anchor", "space"])
    return weighted_fold(rows.withColumn("score", elbow_decay(F.col("score"))), _SPACES).select("movie_id", C.r6(F.col("score")).alias("score"))


def sem_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elbow scores by the fixed share of the best similarity, the rule for curves without a knee; per space and item."""
    ends = _asked(spark, sf_dir).groupBy("space").agg((FLAT_ELBOW * F.max("score")).alias("elbow"))
    rows = _asked(spark, sf_dir).join(F.broadcast(ends), "space").withColumn("floor", FLOOR * F.col("elbow")).withColumn("raw", F.col("elbow") <= 0)
    return rows.select("space", "movie_id", C.r6(elbow_decay(F.col("score"))).alias("score"))


def channel_weights(vector: str, lexical: str, metadata: str, has_entities: bool, has_preferences: bool) -> dict[str, float]:
    """Weights of the three channels: one without input is none, one with input is at least small; they add up to 1."""
    fixed = {"vector": vector, "lexical": ("small" if lexical == "none" else lexical) if has_entities else "none", "metadata": ("small" if metadata == "none" else metadata) if has_preferences else "none"}
    raw = {k: RELEVANCE[v] for k, v in fixed.items()}
    total = sum(raw.values())
    return {k: v / total if total else float(k == "vector") for k, v in raw.items()}


def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine's fusion: vector, lexical and metadata scores of all candidates (a missing one 0), then relevance in steps of .01 with the quality prior; the best 200."""
    from .preferences import meta_preferences
    from .retrieval import join_compound_lexical

    vector = sem_blend(spark, sf_dir).withColumnRenamed("score", "vector")
    lexical = join_compound_lexical(spark, sf_dir).groupBy("movie_id").agg(F.max("score").alias("lexical"))
    cards = C.cards(spark, sf_dir).select("movie_id", "reception")
    d = vector.join(lexical, "movie_id", "full_outer").join(meta_preferences(spark, sf_dir).select("movie_id", F.col("score").alias("metadata")), "movie_id", "left").join(cards, "movie_id", "left")
    w = channel_weights("large", "none", "medium", True, True)
    score = sum((F.lit(x) * F.coalesce(k, F.lit(0.0)) for k, x in w.items()), F.lit(0.0))
    quality = C.r6(S.clamp((F.coalesce("reception", F.lit(60.0)) - 30) / 60))
    ranked = d.select("movie_id", F.bround(C.r6(score), 2).alias("bucket"), quality.alias("quality"))
    return ranked.orderBy(F.desc("bucket"), F.desc("quality"), "movie_id").limit(200)


def _probe_sql(anchor: int, k: int, name: str) -> str:
    return f"{name} AS (SELECT v.space, v.movie_id, list_cosine_similarity(v.vector, h.vector) AS score FROM vectors v JOIN vectors h ON v.space = h.space WHERE h.movie_id = {anchor} AND v.movie_id <> {anchor} QUALIFY row_number() OVER (PARTITION BY v.space ORDER BY score DESC, v.movie_id) <= {k})"


_PLAN = ", ".join(f"({s}, {w}::DOUBLE, {o}, {q})" for s, (w, o, q) in space_weights(_RELEVANCE, _SUBQUERIES).items())
_BLEND = f"""{C.VECTORS}, {_probe_sql(2, 100, "po")}, {_probe_sql(5, 100, "pq")}, plan AS (SELECT * FROM (VALUES {_PLAN}) v(space, weight, orig, subq)),
bo AS (SELECT space, movie_id, coalesce(po.score, 0) AS o, coalesce(pq.score, 0) AS q FROM po FULL JOIN (SELECT * FROM pq WHERE space IN (1, 4, 7)) pq USING (space, movie_id)),
bl AS (SELECT space, movie_id, weight, CASE WHEN orig AND subq THEN 0.8 * q + 0.2 * o WHEN orig THEN o ELSE q END AS score FROM bo JOIN plan USING (space) WHERE orig OR subq),
be AS (SELECT *, max(score) OVER (PARTITION BY space) AS hi, min(score) OVER (PARTITION BY space) AS lo FROM bl WHERE score > 0),
vec AS (SELECT movie_id, round(sum(weight * CASE WHEN hi = lo THEN 1 ELSE exp(-3 * (hi - score) / (hi - lo)) END), 6) AS score FROM be GROUP BY 1)"""
_ASKED = f"{C.VECTORS}, {_probe_sql(9, 10**9, 'alls')}, asked AS (SELECT * FROM alls WHERE space IN (1, 3, 5))"
_QUALIFIER = f"""WITH {_ASKED}, r AS (SELECT *, min(score) OVER (PARTITION BY space) AS lo, max(score) OVER (PARTITION BY space) - min(score) OVER (PARTITION BY space) AS sp FROM asked WHERE movie_id % 3 = 1),
s AS (SELECT space, movie_id, CASE WHEN sp < 0.01 OR (score - lo) / sp >= 0.85 THEN 1 ELSE (score - lo) / sp END AS score FROM r)
SELECT movie_id, round(sum(score * CASE WHEN space = 1 THEN 2 ELSE 1 END) / 4::DOUBLE, 6) AS score FROM s GROUP BY 1"""
_FLAT = f"""WITH {_ASKED}, e AS (SELECT *, 0.85 * max(score) OVER (PARTITION BY space) AS el FROM asked)
SELECT space, movie_id, round(CASE WHEN el <= 0 THEN least(greatest(score, 0), 1) WHEN score >= el THEN 1 WHEN score <= 0.9 * el THEN 0 ELSE (score - 0.9 * el) / (el - 0.9 * el) END, 6) AS score FROM e"""
QUERIES = {
    "sem_blend": (sem_blend, f"WITH {_BLEND} SELECT * FROM vec"),
    "sem_qualifier": (sem_qualifier, _QUALIFIER),
    "sem_flat": (sem_flat, _FLAT),
    "sem_carver": (sem_carver, None),
    "sem_promoted": (sem_promoted, None),
    "fused_search": (fused_search, None),
}
