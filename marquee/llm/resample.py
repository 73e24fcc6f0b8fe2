"""Importance resampling towards a target distribution over hashed word runs.

1. One pass over the texts counts each document's features by bucket; the sparse document-by-bucket matrix is written as CSR
   blocks (row pointers, bucket numbers, counts), a block for each slice of texts.
2. Column sums of the blocks give both distributions: at most `buckets` numbers leave a task, and as many reach the driver.
3. A sparse matrix-vector product of each block with the buckets' gains gives the weights; texts are not read again.
4. Scores add Gumbel noise keyed by the id, so the best scores are a draw without replacement. Ranks come from a
   histogram of the scores (whole numbers of a bounded range) and an order inside each score, not from one global sort.
"""

from __future__ import annotations

import zlib
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_text, materialise, no_clash

BUCKETS = 10_000
SEED = 2024
#: Words whose bucket a task remembers.
MOST_KNOWN = 300_000
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """feature bytes -> crc32 modulo the number of buckets, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value


def words_of(text: str | None) -> list[bytes]:
    """Runs of lower-cased ASCII letters, digits and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to `longest` words, joined by a blank."""
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)] if longest > 1 else words


def csr_blocks(df: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, n_words, indptr, indices, counts) blocks of the document-by-bucket matrix, one row of it for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, known: Buckets):
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        found = [np.fromiter(map(known.__getitem__, features_of(w, longest)), np.int64) for w in words]
        cells = np.concatenate([i * buckets + x for i, x in enumerate(found)])
        cells, counts = np.unique(cells, return_counts=True)
        indptr = np.searchsorted(cells, np.arange(len(words) + 1, dtype=np.int64) * buckets)
        block = [pa.array([x.tobytes()], pa.binary()) for x in (indptr.astype(np.int64), (cells % buckets).astype(np.int32), counts.astype(np.int32))]
        return [pa.ListArray.from_arrays([0, len(words)], batch.column(0)), pa.array([[len(w) for w in words]], pa.list_(pa.int64())), *block]

    schema = f"ids array<{kind}>, n_words array<long>, indptr binary, indices binary, counts binary"
    return map_text(df, [F.col(id_col), F.col(text_col)], fn, schema, lambda: Buckets(buckets))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Count of each bucket over all blocks; a task sends at most one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1), strict=True):
                np.add.at(total, np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int32))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for r in blocks.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r.bucket] = r.n
    return sums


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, the floored thousandfold logarithm of the smoothed target share over the smoothed source share."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log(((t + 1) * (all_source + n)) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(blocks: DataFrame, gains: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each document's features, 0 without any."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                indptr, indices, counts = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
                # Running totals, so that empty rows need no special case.
                gained = np.concatenate([[0], np.cumsum(counts * gains[indices])])
                held = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                total, n = gained[indptr[1:]] - gained[indptr[:-1]], held[indptr[1:]] - held[indptr[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], [id_col, "n_words", "n_features", "weight"])

    return blocks.select("ids", "n_words", "indptr", "indices", "counts").mapInArrow(run, f"{id_col} {kind}, n_words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED):
    """Thousandfold Gumbel noise from the first 32 bits of a hash of seed and id (a null id counts as empty text), floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, id_col: str = "doc_id") -> DataFrame:
    """scored (id, n_features, weight, score, eligible) with rank: 1, 2, ... of the best percent of the eligible rows, else null.

    Scores are whole numbers within some 100,000 values (both logarithms are bounded), so the histogram has no more rows than that.
    """
    cells = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.orderBy(F.col("score").desc())
    cells = cells.withColumn("_before", F.sum("_n").over(higher) - F.col("_n")).withColumn("_drawn", F.expr(f"sum(_n) OVER () * {int(percent)} DIV 100"))
    cells = materialise(cells.where("_before < _drawn").select(F.col("score").alias("_cell"), "_before", "_drawn"), "cells")
    met = scored.join(F.broadcast(cells), F.col("eligible") & (F.col("score") == F.col("_cell")), "left")
    inside = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    place = F.col("_before") + F.row_number().over(inside)
    drawn = met.where("_cell IS NOT NULL").withColumn("rank", F.when(place <= F.col("_drawn"), place))
    rest = met.where("_cell IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(id_col, "n_features", "weight", "score", "rank").unionByName(rest.select(id_col, "n_features", "weight", "score", "rank"))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of df; rank tells the draw of `percent` of those with least_words words.

    Null and empty texts have no features and weight 0. Equal scores go by id, nulls last, then by count and weight; rows equal in all of
    these share the ranks in no fixed order. An empty target or df gives gains from the smoothing alone. Extra columns are not read; the id column may
    not have the name of an output.
    """
    no_clash([id_col], "n_words", "n_features", "weight", "score", "rank", "eligible")
    blocks = materialise(csr_blocks(df, longest, buckets, id_col, text_col), "csr")
    aim = column_sums(csr_blocks(target, longest, buckets, target_id, target_text), buckets)
    weights = weigh(blocks, gains_of(column_sums(blocks, buckets), aim), id_col)
    scored = weights.select(id_col, "n_features", "weight", (F.col("weight") + noise(id_col, seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return ranked(materialise(scored, "scored"), percent, id_col)
