"""The trend stream: stopped, restarted, run twice and late rows give what one pass over the table gives."""

import pytest
from pyspark.sql import functions as F

from marquee.sources import store
from marquee.streaming import refresh as S

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def want(events):
    return sorted(tuple(r) for r in S.scores(S.added(None, S.daily(events))).collect())


def drop(events, folder, part):
    events.where(part).coalesce(1).write.mode("append").parquet(folder)


def test_stopped_and_restarted_stream_equals_one_pass(spark, tmp_path, events):
    sf, inbox, checkpoint = str(tmp_path / "sf"), str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
    assert S.live_scores(spark, sf).count() == 0
    drop(events, inbox, "event_id % 3 = 1")  # later parts hold earlier times too: late rows
    drop(events, inbox, "event_id % 3 = 0")
    S.start(spark, stream(), sf, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in S.live_scores(spark, sf).collect()) == want(events.where("event_id % 3 <> 2"))
    drop(events, inbox, "event_id % 3 = 2")
    S.start(spark, stream(), sf, checkpoint).awaitTermination()
    assert sorted(tuple(r) for r in S.live_scores(spark, sf).collect()) == want(events)
    assert store.published(spark, sf)[S.SCORES][0] == 3


def test_a_batch_that_fails_is_repeated_once(spark, tmp_path, events, monkeypatch):
    sf = str(tmp_path)
    S.refresh_batch(events.where("event_id % 2 = 0"), 0, sf)
    old = sorted(tuple(r) for r in S.live_scores(spark, sf).collect())
    real, calls = store._publish, []

    def fails_between(session, where, rows):
        calls.append(rows[0][0])
        if rows[0][0] == S.SCORES:
            raise OSError("lost")
        real(session, where, rows)

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", fails_between)
        with pytest.raises(OSError):
            S.refresh_batch(events.where("event_id % 2 = 1"), 1, sf)
    assert calls == [S.STATE, S.SCORES] and sorted(tuple(r) for r in S.live_scores(spark, sf).collect()) == old
    S.refresh_batch(events.where("event_id % 2 = 1"), 1, sf)
    S.refresh_batch(events.where("event_id % 2 = 1"), 1, sf)
    assert sorted(tuple(r) for r in S.live_scores(spark, sf).collect()) == want(events)


def test_null_items_and_times_do_not_count(spark, events):
    odd = spark.createDataFrame([(1, None, 5, "x", 0.0, None), (2, None, None, None, None, None)], EVENTS)
    assert want(events.unionByName(odd)) == want(events)
    assert want(events.limit(0)) == []


def test_newer_events_weigh_more(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 1), (2, "2024-01-08", 2), (3, "2024-01-01", 3), (4, "2024-01-01", 3), (5, "2023-12-25", 4), (6, "2020-01-01", 5)], "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.movie_id: int(r.weight) for r in S.weighed(S.added(None, S.daily(rows))).collect()}
    assert got == {1: 1 << 19, 2: 1 << 20, 3: 1 << 20, 4: 1 << 18}  # the oldest day weighs nothing and is gone
