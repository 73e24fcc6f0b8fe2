"""Vector retrieval in two stages: byte codes find candidates in one pass, exact vectors decide. The exact way stays in `vector`.

Codes are whole numbers of -127 to 127 with one scale a vector, written once. A task scores its batch against all heads by one matrix product a space.
Half a scale times the sum of a head's sizes bounds how far a code's cosine may be off, so a row is dropped only if its upper bound is below the lower bounds
of as many rows as are kept: no row of the exact answer is lost, and rows with equal scores all reach the second stage. Filters and a format apply before
scoring, and a pool may restrict what is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources import catalogue as C
from ..sources.store import stored, written
from .vector import MAX_ANCHORS

LEVELS = 127
#: Candidates of the first stage for each row asked for.
OVERSAMPLE = 3
#: Added to each bound for the rounding of sums.
SLACK = 1e-9


def encoded(vectors: DataFrame) -> DataFrame:
    """(movie_id, space, format, scale, codes): unit vectors as bytes; a vector of zeros has scale 0."""
    unit = F.transform("vector", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0))
    d = vectors.select("movie_id", "space", "format", unit.alias("unit")).withColumn("scale", (F.array_max(F.transform("unit", F.abs)) / LEVELS).cast("float"))
    codes = F.transform("unit", lambda x: F.when(F.col("scale") > 0, F.round(x / F.col("scale"))).otherwise(0.0).cast("tinyint"))
    return d.select("movie_id", "space", "format", "scale", codes.alias("codes"))


@stored("vector_codes", "embeddings")
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(C.vectors(spark, sf_dir))


def _heads(vectors: DataFrame, anchors: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """space -> (anchor ids, unit vectors): at most MAX_ANCHORS rows a space."""
    if len(anchors) > MAX_ANCHORS:
        raise ValueError(f"at most {MAX_ANCHORS} anchors")
    rows = vectors.where(F.col("movie_id").isin(anchors) & (F.col("norm") > 0)).select("space", "movie_id", "vector", "norm").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["space"], r["movie_id"])):
        by.setdefault(r["space"], []).append((r["movie_id"], np.array(r["vector"]) / r["norm"]))
    return {s: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for s, x in by.items()}


def candidates(codes: DataFrame, heads: dict[int, tuple[np.ndarray, np.ndarray]], kept: int, anchors: list[int]) -> DataFrame:
    """(anchor, space, movie_id) of all rows that may be among the `kept` nearest to a head by exact cosine."""

    def pruned(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(ids) <= kept:
            return ids, low, high
        stay = high >= np.partition(low, -kept)[-kept]
        return ids[stay], low[stay], high[stay]

    def run(batches):
        best = {}
        for batch in batches:
            space, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            scale, matrix = np.asarray(batch.column(2)).astype(np.float64), np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            for s in np.unique(space):
                if s not in heads:
                    continue
                at = np.flatnonzero((space == s) & ~np.isin(ids, anchors))
                near = (matrix[at].astype(np.float64) @ heads[s][1].T) * scale[at, None]
                off = scale[at, None] / 2 * np.abs(heads[s][1]).sum(axis=1) + SLACK
                for k, anchor in enumerate(heads[s][0].tolist()):
                    new = ids[at], near[:, k] - off[:, k], near[:, k] + off[:, k]
                    best[anchor, s] = pruned(*(np.concatenate(x) for x in zip(best[anchor, s], new))) if (anchor, s) in best else pruned(*new)
        for (anchor, s), (own, low, high) in best.items():
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor, np.int64)), pa.array(np.full(n, s, np.int32)), pa.array(own), pa.array(low), pa.array(high)], ["anchor", "space", "movie_id", "low", "high"])

    rows = codes.select("movie_id", F.col("space").cast("int").alias("space"), "scale", "codes").mapInArrow(run, "anchor long, space int, movie_id long, low double, high double")
    rows = written(rows, "near")
    by = Window.partitionBy("anchor", "space").orderBy(F.desc("low"))
    bar = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= kept).groupBy("anchor", "space").agg(F.min("low").alias("_bar"))
    return rows.join(F.broadcast(bar), ["anchor", "space"]).where(F.col("high") >= F.col("_bar")).select("anchor", "space", "movie_id")


def top_two_stage(codes: DataFrame, vectors: DataFrame, anchors: list[int], k: int, oversample: int = OVERSAMPLE, formats: list[int] | None = None, restrict: DataFrame | None = None) -> DataFrame:
    """(anchor, space, movie_id, score, rank): the best k by exact cosine among the first stage's candidates."""
    heads = _heads(vectors, anchors)
    open_codes = codes.where(F.col("format").isin(formats)) if formats is not None else codes
    if restrict is not None:
        open_codes = open_codes.join(restrict.select("movie_id").distinct(), "movie_id", "left_semi")
    found = candidates(open_codes, heads, k * oversample, anchors)
    own = vectors.where(F.col("movie_id").isin(anchors)).select(F.col("movie_id").alias("anchor"), "space", F.col("vector").alias("head"), F.col("norm").alias("head_norm"))
    met = found.join(vectors.select("movie_id", "space", "vector", "norm"), ["movie_id", "space"]).join(F.broadcast(own), ["anchor", "space"])
    scored = met.select("anchor", "space", "movie_id", _cosine().alias("score"))
    by = Window.partitionBy("anchor", "space").orderBy(F.desc("score"), "movie_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _cosine() -> Column:
    return S.dot(F.col("vector"), F.col("head")) / (F.col("norm") * F.col("head_norm"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows (anchor, space, movie_id) that are found."""
    keys = ["anchor", "space", "movie_id"]
    hits, total = exact.join(found.select(*keys), keys).count(), exact.count()
    return hits / total if total else 1.0


# Registered queries.


def vec_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of each space for three anchors."""
    return top_two_stage(vector_codes(spark, sf_dir), C.vectors(spark, sf_dir), [0, 1, 7], 20).select("anchor", "space", "movie_id", C.r6(F.col("score")).alias("score"))


def vec_two_stage_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within a pool and two formats."""
    pool = C.table(spark, sf_dir, "part").where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("movie_id"))
    found = top_two_stage(vector_codes(spark, sf_dir), C.vectors(spark, sf_dir), [0, 1, 7], 10, formats=[1, 2, 3], restrict=pool)
    return found.select("anchor", "space", "movie_id", C.r6(F.col("score")).alias("score"))


_EXACT = f"""WITH{C.VECTORS}, scored AS (
  SELECT h.movie_id AS anchor, v.space, v.movie_id, list_cosine_similarity(v.vector, h.vector) AS score
  FROM vectors v JOIN vectors h ON v.space = h.space WHERE h.movie_id IN (0, 1, 7) AND v.movie_id NOT IN (0, 1, 7){{also}})
SELECT anchor, space, movie_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY anchor, space ORDER BY score DESC, movie_id) <= {{k}}"""
QUERIES = {
    "vec_two_stage": (vec_two_stage, _EXACT.format(also="", k=20)),
    "vec_two_stage_restricted": (vec_two_stage_restricted, _EXACT.format(also=" AND v.format IN (1, 2, 3) AND v.movie_id IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 1)", k=10)),
}
