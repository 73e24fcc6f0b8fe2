"""Helpers shared by the operators: shared-folder tables, Arrow batch maps, word hashes."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest amount of text, in bytes, that a Python function sees at once (one longer text is its own slice).
SLICE_BYTES = 4 << 20
#: Rows of a table that the driver holds at a time on their way to a file.
SENT_ROWS = 2_000_000
_ASCII_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_own_dirs: dict[str, str] = {}
_mapped: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray]] = {}
#: Lists that gather written tables while `temporary` is open.
_temporary: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine (tests), a folder of our own. A cluster without it is an error."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"/tmp/checkpoints/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors. The table stays until discard or the folder's end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written = path
    for made in _temporary:
        made.append(read)
    return read


@contextmanager
def temporary():
    """Gathers the tables of materialise that are made inside, for discard_but."""
    _temporary.append(made := [])
    try:
        yield made
    finally:
        _temporary.remove(made)


def discard_but(made: list[DataFrame], *kept: DataFrame) -> None:
    """Deletes the gathered tables that the result does not read."""
    discard(*[df for df in made if not any(df is k for k in kept)])


def no_clash(columns, *outputs: str) -> None:
    """An error if a column that is carried along has the name of one that is made."""
    if clash := set(columns) & set(outputs):
        raise ValueError(f"columns {sorted(clash)} are outputs")


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def send_table(df: DataFrame, rows: int, kind: str) -> tuple[str, str, str]:
    """Files of a table's keys in order and of their values of a numpy kind, which every executor gets for mapped_table.

    df: (key, value); a key is a long spread evenly over all longs, as a hash is. The driver holds about SENT_ROWS rows at a time.
    """
    if "files" not in _own_dirs:
        _own_dirs["files"] = os.path.realpath(tempfile.mkdtemp(prefix="tables-"))
        atexit.register(shutil.rmtree, _own_dirs["files"], ignore_errors=True)
    name = uuid.uuid4().hex
    paths = [f"{_own_dirs['files']}/{name}.{x}" for x in ("keys", "values")]
    cuts = max(1, -(-rows // SENT_ROWS))
    edges = [(k << 64) // cuts - (1 << 63) for k in range(cuts + 1)]
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as values:
        for low, end in zip(edges[:-1], edges[1:], strict=True):
            part = df.where(F.col("key").between(low, end - 1)).toArrow()
            key = part.column("key").to_numpy()
            order = np.argsort(key, kind="stable")
            key[order].tofile(keys)
            part.column("value").to_numpy()[order].astype(kind).tofile(values)
    for path in paths:
        df.sparkSession.sparkContext.addFile(path)
    return (*map(os.path.basename, paths), kind)


def mapped_table(sent: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of send_table, on the driver or a worker: maps of the files, which the workers of a machine share and which need no memory of theirs."""
    if sent not in _mapped:
        if len(_mapped) >= 16:
            _mapped.clear()
        kinds = ((sent[0], "int64"), (sent[1], sent[2]))
        _mapped[sent] = tuple(np.asarray(np.memmap(at, kind, "r")) if os.path.getsize(at := SparkFiles.get(name)) else np.zeros(0, kind) for name, kind in kinds)
    return _mapped[sent]


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def hash_share(id_col: Column) -> Column:
    """A reproducible number in [0, 1) for an id, used to draw bounded samples."""
    return F.pmod(F.xxhash64(F.lit("share"), id_col), F.lit(1 << 30)) / float(1 << 30)


def _slices(batch: pa.RecordBatch, text_at: int, most: int):
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size.astype(np.int64)), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_text(df: DataFrame, columns: list[Column], fn, schema: str, make=None, finish=None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Arrow map over the selected columns, the last of which is the text (or bytes).

    fn(batch, state) returns a list of Arrow arrays in the order of schema, or None for no rows;
    finish(state), if given, returns such a list once at the end of the partition.
    """
    names = [x.split()[0] for x in _split_schema(schema)]

    def run(batches):
        state = make() if make else None
        for batch in batches:
            for part in _slices(batch, batch.num_columns - 1, slice_bytes):
                out = fn(part, state)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, names)
            # A worker lives on for later tasks: what it holds no more goes back.
            pa.default_memory_pool().release_unused()
        if finish is not None:
            out = finish(state)
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select(*columns).mapInArrow(run, schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(texts: list[str | None], known: WordHash, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space words of all texts, one after another, and the offset of each text (n + 1)."""
    words, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            words += (raw.translate(_LOWER) if lower else raw).split()
        offsets[i + 1] = len(words)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), offsets


def count_space(raw: bytes) -> int:
    """ASCII white space bytes (blank, \\t, \\n, \\v, \\f, \\r)."""
    return len(raw) - len(raw.translate(None, _ASCII_SPACE))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Newton's method for a small logistic regression; returns weights with the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
