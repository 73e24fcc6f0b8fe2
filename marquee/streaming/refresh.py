"""Trend scores kept up to date by a stream: decayed counts by item, published as a whole after every batch.

The state is a versioned view of events by item and day. A batch adds its events to the state before it and publishes the sum and the new scores;
readers see the old version until then. A batch that is run again after a failure finds its version published and does nothing, so
events count once. An event weighs half for every HALF_LIFE days that it lies before the latest day seen. Counts and weights are whole numbers, so
neither the order of rows nor the batches they come in matter: a late row weighs what it would have weighed in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalogue as C
from ..sources import store

STATE, SCORES = "trend_state", "trend_scores"
#: Days in which a weight halves, and binary places of a weight. A day that weighs nothing any more leaves the state.
HALF_LIFE, PLACES = 7.0, 20


def daily(events: DataFrame) -> DataFrame:
    """(movie_id, day, events) of events, days since 1970; rows without an item or a time do not count."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy(F.col("user_id").alias("movie_id"), F.unix_date(F.to_date(F.col("ts").cast("timestamp"))).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def weight_of(age: Column, half_life: float = HALF_LIFE) -> Column:
    """2 ** -(age / half_life) as a whole number of 2 ** -PLACES."""
    return F.round(F.pow(F.lit(2.0), PLACES - age / half_life)).cast("long")


def added(state: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if state is None else state.unionByName(new)
    summed = both.groupBy("movie_id", "day").agg(F.sum("events").alias("events"))
    latest = both.agg(F.max("day").alias("_latest"))
    return summed.crossJoin(F.broadcast(latest)).where(weight_of(F.col("_latest") - F.col("day")) > 0).drop("_latest")


def weighed(state: DataFrame) -> DataFrame:
    """(movie_id, weight, events): the events that still weigh, and their weight on the latest day."""
    latest = state.agg(F.max("day").alias("_latest"))
    rows = state.crossJoin(F.broadcast(latest)).withColumn("_w", weight_of(F.col("_latest") - F.col("day"))).where("_w > 0")
    return rows.groupBy("movie_id").agg(F.sum(F.col("events").cast("decimal(19,0)") * F.col("_w").cast("decimal(19,0)")).alias("weight"), F.sum("events").alias("events"))


def scores(state: DataFrame) -> DataFrame:
    """(movie_id, events, rank, score): 1 - sqrt(rank / n) by weight, equal ones by id; places come from ranges of the weights."""
    items = weighed(state)
    total = items.agg(F.count(F.lit(1)).alias("_total"))
    placed = store.numbered(items, [F.col("weight").desc(), F.col("movie_id")], "place")
    ranked = placed.crossJoin(F.broadcast(total)).withColumn("rank", F.col("place") - 1)
    return ranked.select("movie_id", "events", "rank", (1 - F.sqrt(F.col("rank") / F.col("_total"))).alias("score"))


def refresh_batch(batch: DataFrame, batch_id: int, sf_dir: str) -> None:
    """One step of the stream, safe to repeat. Version batch_id + 1 of the state is published before that of the scores; a step between them is caught up."""
    spark = batch.sparkSession
    version = batch_id + 1
    if store.published(spark, sf_dir).get(STATE, (0,))[0] < version:
        store.publish(spark, sf_dir, STATE, added(store.previous(spark, sf_dir, STATE), daily(batch)), version, f"batch {batch_id}")
    store.publish(spark, sf_dir, SCORES, scores(store.previous(spark, sf_dir, STATE)), version, f"batch {batch_id}")


def start(spark: SparkSession, events: DataFrame, sf_dir: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the trend scores of sf_dir up to date with a stream of events. checkpoint must outlive the query, in a folder that driver and executors share."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: refresh_batch(batch, batch_id, sf_dir)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published scores; an empty table before the first batch."""
    found = store.previous(spark, sf_dir, SCORES)
    return spark.createDataFrame([], "movie_id long, events long, rank long, score double") if found is None else found


# Registered queries.


def trend_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state and the scores that the stream comes to once it has read the whole table."""
    return scores(added(None, daily(C.table(spark, sf_dir, "events")))).withColumn("score", C.r6(F.col("score")))


QUERIES = {
    "trend_refresh": (
        trend_refresh,
        f"""WITH d AS (SELECT user_id AS movie_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, count(*) AS events FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT *, round(pow(2.0::DOUBLE, {PLACES} - ((SELECT max(day) FROM d) - day) / {HALF_LIFE}::DOUBLE))::BIGINT AS w FROM d),
        s AS (SELECT movie_id, sum(events::HUGEINT * w) AS weight, sum(events)::BIGINT AS events FROM w WHERE w > 0 GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, movie_id) - 1 AS rank, count(*) OVER () AS n FROM s)
        SELECT movie_id, events, rank, round(1 - sqrt(rank::DOUBLE / n), 6) AS score FROM r""",
    )
}
