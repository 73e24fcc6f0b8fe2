"""The view store: one publish, old versions through failures, refreshes of changed tables, and plans that read views alone."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import names as N
from marquee.operators import traits as R
from marquee.plans import requests as Q
from marquee.sources import catalogue as C
from marquee.sources import store

FROM = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "embeddings", "supplier", "nation", "customer", "orders", "events")


@pytest.fixture
def base(spark, tmp_path):
    """A copy of the small tables whose files a test may change."""
    for name in TABLES:
        spark.read.parquet(f"{FROM}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_are_built_once_and_read(spark, base):
    assert store.published(spark, base) == {}
    first = C.cards(spark, base)
    assert sorted(map(str, first.collect())) == sorted(map(str, C.cards.build(spark, base).select(*first.columns).collect()))
    version, path, *_ = store.published(spark, base)["cards"]
    assert version == 1
    store.forget(spark, base)
    C.cards(spark, base).count()
    assert store.published(spark, base)["cards"][:2] == (1, path)
    assert path in C.cards(spark, base).inputFiles()[0]


def test_refresh_publishes_all_views_together(spark, base):
    versions = store.refresh(spark, base)
    assert set(versions) == set(store._builders) and set(versions.values()) == {1}
    again = store.refresh(spark, base, ["awards", "cards"])
    assert again == {"cards": 2, "awards": 2} and store.published(spark, base)["postings"][0] == 1


def test_a_failed_refresh_leaves_the_old_version(spark, base, monkeypatch):
    store.refresh(spark, base, ["cards", "awards"])
    old = {k: v[:2] for k, v in store.published(spark, base).items()}
    before = C.cards(spark, base).count()
    spark.read.parquet(f"{FROM}/lineitem.parquet").limit(1).withColumn("l_partkey", F.lit(1).cast("long")).write.mode("append").parquet(f"{base}/lineitem.parquet")

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", fail)
        with pytest.raises(OSError):
            store.refresh(spark, base, ["cards", "awards"])
    with monkeypatch.context() as m:  # the second view fails, the first is written but not published
        m.setitem(store._builders, "awards", (fail, store._builders["awards"][1]))
        with pytest.raises(OSError):
            store.refresh(spark, base, ["cards", "awards"])
    assert {k: v[:2] for k, v in store.published(spark, base).items()} == old
    assert store.view(spark, base, "cards").count() == before and not store._pending
    assert store.refresh(spark, base, ["cards", "awards"]) == {"cards": 2, "awards": 2}


def test_changed_tables_are_noticed_by_the_next_session(spark, base):
    votes = C.cards(spark, base).agg(F.sum("votes")).first()[0]
    one = spark.read.parquet(f"{base}/lineitem.parquet").limit(1)
    one.write.mode("append").parquet(f"{base}/lineitem.parquet")
    assert C.cards(spark, base).agg(F.sum("votes")).first()[0] == votes
    store.forget(spark, base)
    assert C.cards(spark, base).agg(F.sum("votes")).first()[0] == votes + 1
    assert store.published(spark, base)["cards"][0] == 2


def test_old_versions_are_retired(spark, base):
    for _ in range(4):
        store.refresh(spark, base, ["awards"])
    gone = store.retire(spark, base)
    assert len(gone) == 2 and store.retire(spark, base) == []
    assert C.awards(spark, base).count() > 0


def test_flows_scan_views_and_no_base_table(spark, base):
    store.refresh(spark, base)
    for query in (R.flow_trait_search, Q.flow_trait_batch):
        files = query(spark, base).inputFiles()
        assert files and not [f for f in files if any(f"/{t}.parquet/" in f for t in TABLES)]


def test_string_ids_last(spark, base):
    before = {r.norm: r.string_id for r in N.dictionary(spark, base).collect()}
    assert sorted(before.values()) == list(range(1, len(before) + 1)) and list(before) and [n for n, _ in sorted(before.items(), key=lambda x: x[1])] == sorted(before, key=str.encode)
    more = spark.createDataFrame([(9_999_999, "Supplier", 3, 0.0), (8, "x", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    more.write.mode("append").parquet(f"{base}/supplier.parquet")
    store.forget(spark, base)
    after = {r.norm: r.string_id for r in N.dictionary(spark, base).collect()}
    assert {n: after[n] for n in before} == before
    new = sorted(set(after) - set(before), key=str.encode)
    assert new and [after[n] for n in new] == list(range(len(before) + 1, len(after) + 1))


def test_numbers_are_places(spark):
    d = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "k int").repartition(7)
    got = store.numbered(d, [F.col("k").desc()], "place").collect()
    assert sorted((r.place, r.k) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
