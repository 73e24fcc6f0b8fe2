"""Packing by shortest-pack-first over the length histogram.

Texts become token pieces of at most `capacity` ids. The histogram of piece lengths (at most
`capacity` numbers, whatever the corpus) is packed on the driver: lengths longest first, each
into the open pack pattern with the most room left, updating pattern counts. Patterns are then joined back to
pieces by each piece's rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import map_text, materialise

CAPACITY = 1024
#: Sub-groups within which pieces of one length are ranked, so that one length may hold any share of the rows.
SPREAD = 256


def token_pieces(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, ids) pieces of each text's ids followed by end_id.

    ids are packed as little-endian unsigned numbers of two bytes if the vocabulary allows it, else of four. Null and empty
    texts give the end id alone. Pieces are full but for a text's last one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    stored, wide = ("<u2", 2) if tokens.vocabulary_size(tokenizer) <= 1 << 16 else ("<u4", 4)

    def fn(batch: pa.RecordBatch, _):
        raw, ends = tokens.huggingface_encoder(tokenizer).encode_column(batch.column(1))
        packed, end = np.frombuffer(raw, "<u4").astype(stored, copy=False).tobytes(), np.asarray([end_id], stored).tobytes()
        row, start, length, total, ids = [], [], [], [], []
        for i, (lo, hi) in enumerate(itertools.pairwise(ends.tolist())):
            own = packed[wide * lo : wide * hi] + end
            for at in range(0, hi - lo + 1, capacity):
                row.append(i)
                start.append(at)
                ids.append(own[wide * at : wide * (at + capacity)])
                length.append(len(ids[-1]) // wide)
                total.append(hi - lo + 1)
        return [batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, start long, length long, doc_tokens long, ids binary", slice_bytes=1 << 19)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) pack patterns that use each length exactly as often as the histogram has it."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a length lies outside 1..capacity")
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=None)
            if room is None:  # new packs, each filled with this length
                fits = capacity // length
                whole, rest = divmod(left, fits)
                for lengths, count in (((length,) * fits, whole), ((length,) * rest, 1)):
                    if lengths and count:
                        open_packs[capacity - sum(lengths)].append((lengths, count))
                break
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append((pattern, count - used))
            open_packs[room - length].append(((*pattern, length), used))
            left -= used
        done += open_packs.pop(0, [])
    return done + [x for packs in open_packs.values() for x in packs if x[1]]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Per length, its places sorted by rank: first ranks, first sequences and offsets."""
    rows: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            for own, x in zip(rows[length], (taken[length], sequence, offset), strict=True):
                own.append(x)
            taken[length] += count
            offset += length
        sequence += count
    return [(length, *x) for length, x in rows.items()]


def pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (longs) to rows that have a length from 1 to capacity.

    keys order the pieces of one length (ties are interchangeable). Offsets within a sequence are
    gapless from 0. pieces is read twice; hand in a written table. Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    spread = pieces.withColumn("_sub", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    counts = spread.groupBy(length_col, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy(length_col).agg(F.sum("_n")).collect()}
    places = spark.createDataFrame(_places(pack_histogram(histogram, capacity)), f"{length_col} long, _firsts array<long>, _sequences array<long>, _offsets array<long>")
    before = Window.partitionBy(length_col).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(length_col, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(length_col, "_sub").orderBy(*keys))
    ranked = spread.withColumn("_in", rank - 1).join(firsts, [length_col, "_sub"]).withColumn("_rank", F.col("_first") + F.col("_in"))
    # The places of all lengths are bounded by the capacity, whatever the number of rows.
    placed = ranked.join(F.broadcast(places), length_col).withColumn("_at", F.size(F.filter("_firsts", lambda first: first <= F.col("_rank"))))
    sequence = F.element_at("_sequences", F.col("_at")) + F.col("_rank") - F.element_at("_firsts", F.col("_at"))
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), F.element_at("_offsets", F.col("_at")).alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces, then pack: one row per piece with its ids, sequence and offset."""
    pieces = materialise(token_pieces(df, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, [id_col, "start", "ids"], capacity=capacity)


def digest_ids(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids_crc32, taken from their ids as little-endian 32-bit numbers, in place of these."""
    names = [*packed.drop("ids").columns, "ids_crc32"]

    def run(batches):
        for batch in batches:
            ids, length = batch.column(batch.num_columns - 1).to_pylist(), batch.column("length").to_pylist()
            crc = [zlib.crc32(raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4")) for raw, n in zip(ids, length, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names)

    return packed.select(*names[:-1], "ids").mapInArrow(run, packed.drop("ids").withColumn("ids_crc32", F.lit(0).cast("long")).schema)
