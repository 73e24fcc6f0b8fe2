"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

A row's global number follows from its keys alone (hash bucket, then key order within the bucket), so
it does not depend on file layout or on recomputed tasks. The permutation is a bijection of
0..n-1, so `shard = position % shards` and `slot = position // shards` are computable for any
row number, and `invert` finds the row number of a shard and slot. Shard sizes differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import mix64

ROUNDS = 6


def _round(half: np.ndarray, key: int, size: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (mix64(half.astype(np.uint64) ^ salt) % np.uint64(size)).astype(np.int64)


def _sides(n: int) -> tuple[int, int]:
    """Side lengths of a mixed-radix domain of at least n cells, with fewer than a side's cells to spare."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _once(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _sides(n)
    left, right = x // b, x % b
    for r in range(ROUNDS):
        if r % 2:
            right = (right + _round(left, seed * 31 + r, b)) % b
        else:
            left = (left + _round(right, seed * 31 + r, a)) % a
    return left * b + right


def _back(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _sides(n)
    left, right = y // b, y % b
    for r in reversed(range(ROUNDS)):
        if r % 2:
            right = (right - _round(left, seed * 31 + r, b)) % b
        else:
            left = (left - _round(right, seed * 31 + r, a)) % a
    return left * b + right


def _walk(x, n: int, seed: int, step) -> np.ndarray:
    out = step(np.asarray(x, np.int64), n, seed)
    while (far := out >= n).any():
        out[far] = step(out[far], n, seed)
    return out


def permute(rows, n: int, seed: int) -> np.ndarray:
    """Position of each row number below n; a bijection of 0..n-1 for every n and seed."""
    return _walk(rows, n, seed, _once)


def invert(positions, n: int, seed: int) -> np.ndarray:
    """Row number at each position: the inverse of permute."""
    return _walk(positions, n, seed, _back)


def own_name(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    name = "_own"
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def global_row_numbers(df: DataFrame, keys: list[str], buckets: int = 4096, row: str = "_row", rows: str = "_rows") -> DataFrame:
    """Adds `row` (0..n-1, gapless) and `rows` (n), replacing columns of these names.

    Rows with equal keys are interchangeable and get adjacent numbers; null keys sort first. One
    count per hash bucket (at most `buckets` rows, hence the broadcast) gives each bucket's offset.
    """
    df = df.drop(row, rows)
    bucket, offset = own_name(df) + "_bucket", own_name(df) + "_offset"
    bucketed = df.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = bucketed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        bucket,
        F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias(offset),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(rows),
    )
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*keys))
    return bucketed.join(F.broadcast(offsets), bucket).withColumn(row, F.col(offset) + rank - 1).drop(bucket, offset)


def _position(row: str, rows: str, seed: int) -> Column:
    @F.pandas_udf("long")
    def position(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(n.iloc[0]), seed)) if len(number) else number

    return position(F.col(row), F.col(rows))


def assign_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 20_24, buckets: int = 4096) -> DataFrame:
    """Adds `shard` (int) and `slot` (long, gapless from 0 in each shard) to every row.

    keys: columns that tell rows apart (an id first; more for rows that may share it). Nulls,
    repeated rows and empty tables are fine; input columns named shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    own = own_name(df)
    row, rows, at = (own + x for x in ("_row", "_rows", "_at"))
    placed = global_row_numbers(df, keys, buckets, row, rows).withColumn(at, _position(row, rows, seed))
    return placed.select(*df.columns, (F.col(at) % shards).cast("int").alias("shard"), F.floor(F.col(at) / shards).cast("long").alias("slot"))
