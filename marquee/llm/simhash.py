"""SimHash near-duplicate components by pivot distance tables.

1. One pass over the texts gives a 64-bit fingerprint of each row. Equal fingerprints are one class, so copies are never paired.
2. Each class gets a row of the pivot table: its Hamming distances to many reference fingerprints (an anchor, the anchor with
   two neighbouring bits flipped, with one bit flipped, and random ones). Distances obey the triangle inequality, so two
   fingerprints at most `most` bits apart differ by at most that in every coordinate.
3. How a distance changes from the anchor to a pair-flipped pivot tells the agreement in those two bits: 0, 1 or 2. Of
   BLOCKS blocks of such pairs, all but `most` are unchanged between linked fingerprints, so linked ones share the agreements
   of at least one choice of BLOCKS - most blocks. Those are the bucket keys.
4. Inside a bucket, pairs whose rows of the table differ by more than `most` in some coordinate are discarded; survivors are
   verified by XOR and population count. A bucket returns a spanning forest of its links, fewer than it has members.
5. Buckets of more than LIMIT members are streamed on and dealt again by the single-bit pivots: the same bits in all runs of four but
   `most`, which at most 16 ** most fingerprints share. So no pair is left out and no group grows with the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _LOWER, discard_but, map_text, materialise, no_clash, temporary
from .near_dup import components

SEED = 42
BLOCKS = 6
#: Members of a bucket that are compared with each other at once.
LIMIT = 256
PAIRS = 32
_rng = np.random.default_rng(20260303)
ANCHOR = _rng.integers(0, 2**64, dtype=np.uint64)
_at = np.arange(PAIRS, dtype=np.uint64) * np.uint64(2)
#: The anchor, the pair-flipped, the single-flipped and the random reference fingerprints.
PIVOTS = np.concatenate([[ANCHOR], ANCHOR ^ (np.uint64(3) << _at), ANCHOR ^ (np.uint64(1) << _at), _rng.integers(0, 2**64, 31, dtype=np.uint64)])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the blank-joined runs of `width` lower-cased words, repeats included; fewer words are one run, none have none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in runs), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    set_in = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        some = hashes[lo : lo + (1 << 16)].astype("<u8")
        set_in += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, _):
        prints = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
        return [batch.column(0), pa.array(prints.view(np.int64), pa.int64())]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, fp long")


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to PIVOTS (columns)."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def agreements(table: np.ndarray) -> np.ndarray:
    """For each pair of bits, in how many a fingerprint differs from the anchor, read off the table (0 to 2)."""
    return ((table[:, :1] - table[:, 1 : PAIRS + 1]) + 2) // 2


def _left_out(most: int):
    """(number, pairs of bits that count) for each choice of `most` blocks that may differ."""
    blocks = np.array_split(np.arange(PAIRS), BLOCKS)
    for k, out in enumerate(combinations(range(BLOCKS), most)):
        yield k, np.concatenate([b for i, b in enumerate(blocks) if i not in out])


def coarse_keys(fps: np.ndarray, most: int) -> np.ndarray:
    """Bucket keys (a column for each choice of blocks left out): the agreements of the other blocks in base 3, and the choice."""
    agree, keys = agreements(distance_table(fps)).astype(np.int64), []
    choices = list(_left_out(most))
    for k, pairs in choices:
        keys.append((agree[:, pairs] @ 3 ** np.arange(len(pairs), dtype=np.int64)) * len(choices) + k)
    return np.column_stack(keys)


def fine_keys(fps: np.ndarray, most: int) -> np.ndarray:
    """Bucket keys (a column for each choice of `most` runs of four bits left out): all other bits, read off the single-bit pivots."""
    table = distance_table(fps)
    agree, first = agreements(table), (table[:, :1] - table[:, PAIRS + 1 : 2 * PAIRS + 1] + 1) // 2
    pairs = (first.astype(np.uint64) | ((agree - first).astype(np.uint64) << np.uint64(1))) << _at
    fours = pairs[:, ::2] | pairs[:, 1::2]
    whole = np.bitwise_or.reduce(fours, axis=1)
    return np.column_stack([whole ^ np.bitwise_or.reduce(fours[:, list(out)], axis=1) for out in combinations(range(PAIRS // 2), most)]).view(np.int64)


def forest(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) links that span the linked parts of each bucket; keys are sorted, a fingerprint is in a bucket once."""
    table, label = distance_table(fps), np.arange(len(fps))
    low, high = np.searchsorted(keys, keys), np.searchsorted(keys, keys, side="right")
    at, off, a, b = np.arange(len(fps)), 0, [], []
    while len(at):
        off += 1
        at = at[at + off < high[at]]
        x = at[label[at] != label[at + off]]
        x = x[np.abs(table[x] - table[x + off]).max(1, initial=0) <= most]
        for i in x[np.bitwise_count(fps[x] ^ fps[x + off]) <= most].tolist():
            mine, theirs = label[i], label[i + off]
            if mine != theirs:
                a.append(i)
                b.append(i + off)
                part = label[low[i] : high[i]]
                part[part == theirs] = mine
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def _links(rows: DataFrame, keys: list[str], most: int, limit: int) -> DataFrame:
    """(a, b, again) from rows (keys, fp): links within buckets of up to `limit` rows, and the members of larger ones as (fp, fp, true).

    Rows arrive sorted by bucket, so only a bucket that may go on in the next batch is held, and no more of it than `limit`.
    """

    def run(batches):
        held, passed = None, None
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(len(keys) + 1)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)) + 1
            starts, bucket = np.concatenate([[0], edge]), np.zeros(n, np.int64)
            bucket[edge] = 1
            bucket, sizes = np.cumsum(bucket), np.diff(np.concatenate([[0], edge, [n]]))
            large = sizes > limit
            if passed is not None and passed == tuple(c[0] for c in columns[:-1]):
                large[0] = True
            last = tuple(c[-1] for c in columns[:-1])
            passed = last if large[-1] else None
            keep = n if large[-1] else int(starts[-1])
            held = None if large[-1] else [c[keep:] for c in columns]
            yield found(bucket[:keep], columns[-1][:keep], large)
        if held is not None:
            yield found(np.zeros(len(held[0]), np.int64), held[-1], np.array([False]))

    def found(bucket, fps, large):
        again = large[bucket]
        on = fps[again]
        a, b = forest(bucket[~again], fps[~again].view(np.uint64), most)
        marks = np.zeros(len(a) + len(on), bool)
        marks[len(a) :] = True
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a.view(np.int64), on])), pa.array(np.concatenate([b.view(np.int64), on])), pa.array(marks)], ["a", "b", "again"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.select(*keys, "fp").mapInArrow(run, "a long, b long, again boolean")


def _keyed(classes: DataFrame, make, most: int) -> DataFrame:
    """(choice, key, fp) rows of every class by make(fps, most)."""

    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0))
            keys = make(fps.view(np.uint64), most)
            n, choices = keys.shape if len(fps) else (0, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(choices, dtype=np.int32), n)), pa.array(keys.reshape(-1)[: n * choices], pa.int64()), pa.array(np.repeat(fps, choices))], ["choice", "key", "fp"])

    return classes.select("fp").mapInArrow(run, "choice int, key long, fp long")


def near_links(classes: DataFrame, most: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b) links that span all fingerprints of classes (distinct fp) at most `most` bits apart."""
    first = materialise(_links(_keyed(classes, coarse_keys, most), ["choice", "key"], most, limit), "links")
    again = first.where("again").select(F.col("a").alias("fp")).distinct()
    # No more than 16 ** most fingerprints share a fine key, so none is passed on again.
    second = _links(_keyed(again, fine_keys, most), ["choice", "key"], most, 16**most)
    return materialise(first.unionByName(second).where("NOT again").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")


def simhash_components(df: DataFrame, width: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) per row: 16 hex digits and the least id reachable over links of at most `most` differing bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null id take part; a component
    of null ids only has a null component_id. Repeated rows are rows of one class. Extra columns are not read; the id column may not
    have the name of a column that is made.
    """
    no_clash([id_col], "fp", "member", "label", "fingerprint", "component_id")
    with temporary() as made:
        rows = materialise(fingerprints(df, width, id_col, text_col), "fingerprints")
        classes = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("member")), "classes")
        labels = components(near_links(classes, most, limit))
    discard_but(made, rows, classes, labels)
    marked = classes.join(labels.withColumnRenamed("cls", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = marked.groupBy("label").agg(F.min("member").alias("component_id"))
    of_class = marked.join(least, "label").select("fp", "component_id")
    return rows.join(of_class, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
