"""Versioned store of derived views: written first, published in one step, read by every query.

A view is a function of base tables. `refresh` writes new versions of views beside the old ones and then appends one file to the
manifest that names them all; until that file is there, readers go on with the old versions. A view that was never
published, or whose base files have changed since, is refreshed when a session first reads it.
"""

from __future__ import annotations

import atexit
import functools
import json
import re
import shutil
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "view string, version long, path string, state string, columns string"
#: Versions of a view that `retire` leaves.
KEPT = 2

_builders: dict[str, tuple[Callable, tuple[str, ...]]] = {}
_own_dirs: dict[str, str] = {}
#: By session and store: where each view was found.
_known: dict[tuple[str, str], dict[str, tuple[str, str]]] = {}
#: By store, while it is refreshed: views that are written but not yet published.
_pending: dict[str, dict[str, tuple[str, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine, a folder of our own. A cluster without it is an error."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"/tmp/checkpoints/views-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def root(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the views over one set of base tables."""
    return f"{shared_dir(spark)}/views/{uuid.uuid5(uuid.NAMESPACE_URL, sf_dir.rstrip('/')).hex}"


def stored(name: str, *bases: str) -> Callable:
    """Makes a function (spark, sf_dir) of base tables, or of other views over them, a view that is read from the store."""

    def wrap(build: Callable) -> Callable:
        _builders[name] = (build, bases)

        @functools.wraps(build)
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            return view(spark, sf_dir, name)

        read.build = build
        return read

    return wrap


def state_of(spark: SparkSession, sf_dir: str, bases: Iterable[str]) -> str:
    """A digest of the names, lengths and times of the base tables' files; their content is not read."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{b}.parquet" for b in sorted(bases)])
    return files.agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")))).first()[0]


def published(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, str, str, str]]:
    """view -> (version, path, state, columns) of the newest version of each view."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{root(spark, sf_dir)}/published")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    newest = manifest.groupBy("view").agg(F.max(F.struct("version", "path", "state", "columns")).alias("x"))
    return {r["view"]: tuple(r["x"]) for r in newest.collect()}


def previous(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The newest published version of a view, whatever the state of its base tables: what a view that only grows is built upon."""
    found = published(spark, sf_dir).get(name)
    return None if found is None else spark.read.schema(StructType.fromJson(json.loads(found[3]))).parquet(found[1])


def publish(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, version: int, state: str) -> bool:
    """Writes and publishes a version of a view that is made outside of the store; False, without writing, if that version or a later one is there.

    So a writer that starts again after a failure may repeat its last step.
    """
    if published(spark, sf_dir).get(name, (0,))[0] >= version:
        return False
    path = f"{root(spark, sf_dir)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _publish(spark, sf_dir, [(name, version, path, state, df.schema.json())])
    return True


def _publish(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> None:
    """The one step that readers see: a file of the manifest, committed by a rename."""
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root(spark, sf_dir)}/published")


def refresh(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> dict[str, int]:
    """Writes new versions of views (all, in the order of their definition) and publishes them together; returns their versions.

    If any of them fails, none is published and the old versions stay in use. A view may read others; of those in the same
    refresh it sees the new versions.
    """
    names = [n for n in _builders if names is None or n in set(names)]
    where, old = root(spark, sf_dir), published(spark, sf_dir)
    outer = _pending.get(where)
    _pending[where] = dict(outer or {})
    rows = []
    try:
        for name in names:
            build, bases = _builders[name]
            state, path = state_of(spark, sf_dir, bases), f"{where}/{name}/{uuid.uuid4().hex}"
            made = build(spark, sf_dir)
            made.write.parquet(path)
            columns = made.schema.json()
            _pending[where][name] = (path, columns)
            rows.append((name, old.get(name, (0,))[0] + 1, path, state, columns))
        _publish(spark, sf_dir, rows)
    finally:
        if outer is None:
            del _pending[where]
        else:
            _pending[where] = outer
    seen = _known.setdefault((spark.sparkContext.applicationId, where), {})
    seen.update({name: (path, columns) for name, _, path, _, columns in rows})
    return {name: version for name, version, *_ in rows}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The published version of a view; a missing or outdated one is refreshed first, once a session."""
    where = root(spark, sf_dir)
    found = _pending.get(where, {}).get(name) or _known.setdefault((spark.sparkContext.applicationId, where), {}).get(name)
    if found is None:
        for known, (_, path, state, columns) in published(spark, sf_dir).items():
            if known in _builders and known not in _known[spark.sparkContext.applicationId, where] and state == state_of(spark, sf_dir, _builders[known][1]):
                _known[spark.sparkContext.applicationId, where][known] = (path, columns)
        if name not in _known[spark.sparkContext.applicationId, where]:
            refresh(spark, sf_dir, [name])
        found = _known[spark.sparkContext.applicationId, where][name]
    path, columns = found
    return spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(path)


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Looks at the manifest and the base files anew with the next read, as a new session does."""
    _known.pop((spark.sparkContext.applicationId, root(spark, sf_dir)), None)


def retire(spark: SparkSession, sf_dir: str, keep: int = KEPT) -> list[str]:
    """Deletes versions of views that are not among the newest `keep` of the manifest; returns their paths."""
    where = root(spark, sf_dir)
    manifest = spark.read.schema(MANIFEST).parquet(f"{where}/published")
    kept = {p for r in manifest.groupBy("view").agg(F.slice(F.sort_array(F.collect_set(F.struct("version", "path")), asc=False), 1, keep).alias("x")).collect() for _, p in r["x"]}
    folder = spark._jvm.org.apache.hadoop.fs.Path(where)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for name in _builders:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
        for status in system.listStatus(at) if system.exists(at) else []:
            path = f"{where}/{name}/{status.getPath().getName()}"
            if path not in kept:
                system.delete(status.getPath(), True)
                gone.append(path)
    return gone


def numbered(df: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """df with a column of this name: the place of each row by `order`, from 1 and gapless, without a global sort in one task.

    Rows are dealt by ranges and written, so that the counts of the ranges and the places in them come from the same dealing.
    """
    order = order if isinstance(order, list) else [order]
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, place), name)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(counts.select("_part", earlier.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def written(df: DataFrame, name: str) -> DataFrame:
    """A result of this job that is read more than once: written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
