"""Phrases of frequent adjacent words, by hierarchical pair naming.

1. One pass over the texts cuts them into blocks: a block holds the words of one language that a task has read, as a list of
   distinct words and one number for each position, 0 where a piece ends. All lists of a block are packed, as Arrow batches hold many blocks.
2. A name is the number of a frequent k-gram, given once for the whole corpus. Distinct words (k = 1), or distinct pairs of adjacent
   (k-1)-gram names (k > 1), are counted in each block and dealt to buckets by their hash, as packed arrays. A bucket adds up what its
   blocks have counted, names what is seen often enough, and sends the names back to the blocks that hold it, which replace
   their positions. So a phrase with a rare part is never counted, a very common word is one entry of each block, and the number
   of buckets follows from the number of entries.
3. A named pair points to its two (k-1)-grams. Those pointers give the phrase, the counts of all its cuts, and the longer
   phrases around a phrase. Only the two pointers of each longer phrase need a look: any phrase that holds the words k + 2
   long holds them k + 1 long at least as often.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, map_text, materialise, mix64

#: Bytes of text that the blocks of a task hold at a time, about.
BLOCK_BYTES = 16 << 20
#: Entries (of one block each) that a bucket gets, about, and the least number of buckets.
BUCKET_ENTRIES, LEAST_BUCKETS = 400_000, 32
#: Bytes of one text that are cut into words at a time.
CUT_BYTES = 4 << 20
#: First of two rankings of each language is split so often.
SALTS = 64
#: Compression of packed numbers and words, and of the lists of a block's pairs, which are read once.
LEVEL, PAIR_LEVEL = 6, 1
END = b"."
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def _packed(numbers: np.ndarray, level: int = LEVEL) -> bytes:
    """Whole numbers from 0, compressed: in as few bytes each as the greatest needs, first bytes together, then second ones, and so on."""
    size = next(n for n in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * n - (n == 8)))
    planes = numbers.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.compress(planes.tobytes(), level)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return planes.T.copy().view(f"<u{raw[0]}").reshape(-1).astype(np.int64)


def _packed_words(words: list[bytes]) -> bytes:
    """Words hold no blank, so one parts them."""
    return zstandard.compress(b" ".join(words), LEVEL)


def _unpacked_words(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b" ") if raw else []


class Block:
    """Positions and distinct words of one language; a piece's end is word 0."""

    def __init__(self):
        self.words, self.parts, self.size = defaultdict(count().__next__), [], 0
        self.words[END]

    def add(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass").translate(_PIECES)
        self.size += len(raw)
        while raw:
            # A cut falls on a blank or an end, so no word is split; pieces go on.
            cut = len(raw)
            if cut > CUT_BYTES:
                cut = min((x for x in (raw.find(b" ", CUT_BYTES), raw.find(b"\n", CUT_BYTES)) if x >= 0), default=cut)
            found = raw[:cut].replace(b"\n", b" . ").split(b" ")
            self.parts.append(np.fromiter((self.words[w] for w in found if w), np.int32))
            raw = raw[cut:]
        self.parts.append(np.zeros(1, np.int32))

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """Words, the most frequent first (so positions are small numbers), their counts, and the packed positions."""
        at = np.concatenate(self.parts)
        counts = np.bincount(at, minlength=len(self.words))
        order = np.argsort(-counts[1:], kind="stable") + 1
        rank = np.zeros(len(counts), np.int32)
        rank[order] = np.arange(1, len(counts), dtype=np.int32)
        words = list(self.words)
        return [words[k] for k in order], counts[order], _packed(rank[at])


def word_blocks(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(block, lang, entries, n, words, counts, at): distinct words and all words, packed text and counts, at a packed number for each position (n for the n-th word, 0 for an end)."""

    def make():
        return {"blocks": defaultdict(Block), "next": (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32}

    def flush(state):
        rows = [(lang, *block.row()) for lang, block in state["blocks"].items()]
        ids = range(state["next"], state["next"] + len(rows))
        state["next"] += len(rows)
        state["blocks"].clear()
        numbers = [pa.array(x, pa.int64()) for x in (ids, [len(r[1]) for r in rows], [int(r[2].sum()) for r in rows])]
        packed = [pa.array(x, pa.binary()) for x in ([_packed_words(r[1]) for r in rows], [_packed(r[2]) for r in rows], [r[3] for r in rows])]
        return [numbers[0], pa.array([r[0] for r in rows], pa.string()), *numbers[1:], *packed]

    def fn(batch: pa.RecordBatch, state):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                state["blocks"][lang].add(text)
        return flush(state) if sum(b.size for b in state["blocks"].values()) >= BLOCK_BYTES else None

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    return map_text(df, [lang, F.col(text_col)], fn, "block long, lang string, entries long, n long, words binary, counts binary, at binary", make, flush)


def _rising(numbers: np.ndarray) -> bytes:
    return _packed(np.diff(numbers, prepend=0))


def _key_columns(pairs: bool) -> list[str]:
    return ["lefts", "rights"] if pairs else ["words"]


DEALT = {False: "words binary", True: "lefts binary, rights binary"}
NAMED = {False: "words array<string>", True: "lefts array<long>, rights array<long>"}


def dealt(blocks: DataFrame, pairs: bool, buckets: int) -> DataFrame:
    """(bucket, block, lang, i, c, keys): each block's entries by bucket, packed; i is an entry's number in its block, from 1."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                counts = _unpacked(batch.column(2)[k].as_py())
                if pairs:
                    keys = [_unpacked(batch.column(c)[k].as_py()) for c in (3, 4)]
                    h = mix64(keys[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ keys[1].astype(np.uint64))
                else:
                    words = _unpacked_words(batch.column(3)[k].as_py()) if len(counts) else []
                    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(counts))
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
                parts = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                n = len(parts)
                if not n:
                    continue
                own = [pa.array([_packed(x[at]) for at in parts], pa.binary()) for x in keys] if pairs else [pa.array([_packed_words([words[i] for i in at]) for at in parts], pa.binary())]
                head = [pa.array(bucket[[at[0] for at in parts]], pa.int32()), pa.array([batch.column(0)[k].as_py()] * n, pa.int64()), pa.array([batch.column(1)[k].as_py()] * n, pa.string())]
                tail = [pa.array([_rising(at + 1) for at in parts], pa.binary()), pa.array([_packed(counts[at]) for at in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*head, *tail, *own], ["bucket", "block", "lang", "i", "c", *_key_columns(pairs)])
            pa.default_memory_pool().release_unused()

    return blocks.select("block", "lang", "counts", *_key_columns(pairs)).mapInArrow(run, f"bucket int, block long, lang string, i binary, c binary, {DEALT[pairs]}")


def _numbered(rows: pa.Table, pairs: bool) -> tuple[np.ndarray, list]:
    """(number of each entry's key, distinct keys by number) of rows of one language."""
    if not pairs:
        words = [w.decode("utf-8", "surrogatepass") for x in rows.column("words").to_pylist() for w in _unpacked_words(x)]
        coded = pa.array(words, pa.string()).dictionary_encode()
        return np.asarray(coded.indices), [coded.dictionary]
    left, right = (np.concatenate([_unpacked(x) for x in rows.column(c).to_pylist()]) for c in ("lefts", "rights"))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.concatenate([[True], (np.diff(left) != 0) | (np.diff(right) != 0)])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return number, [pa.array(left[first]), pa.array(right[first])]


def named(blocks: DataFrame, pairs: bool, least: int, back: bool, name: str) -> DataFrame:
    """Written rows of two kinds: (block, i, id), a block's entries that have a name; (lang, keys, f, ids), the names of a bucket, with a null block."""
    total = blocks.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ENTRIES))
    columns = _key_columns(pairs)

    def give(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, first = key[0].as_py(), 0
        out = {c: [] for c in ("block", "i", "id", "lang", *columns, "f", "ids")}

        def put(**row):
            for c, x in out.items():
                x.append(row.get(c))

        for lang in rows.column("lang").unique().to_pylist():
            own = rows.filter(pc.equal(rows.column("lang"), lang))
            number, keys = _numbered(own, pairs)
            f = np.zeros(len(keys[0]), np.int64)
            counts = [_unpacked(c) for c in own.column("c").to_pylist()]
            np.add.at(f, number, np.concatenate(counts))
            often = np.flatnonzero(f >= least)
            ids = np.full(len(f), -1, np.int64)
            ids[often] = (first + np.arange(len(often))) * buckets + bucket
            first += len(often)
            if not len(often):
                continue
            taken = [k.take(pa.array(often)) for k in keys]
            put(lang=lang, f=f[often], ids=ids[often], **{c: k.to_numpy() if pairs else k.to_pylist() for c, k in zip(columns, taken, strict=True)})
            at = 0
            for block, i, c in zip(own.column("block").to_pylist(), own.column("i").to_pylist(), counts, strict=True):
                given = ids[number[at : at + len(c)]]
                at += len(c)
                if back and (given >= 0).any():
                    put(block=block, i=_rising(np.cumsum(_unpacked(i))[given >= 0]), id=_packed(given[given >= 0]))
        kinds = {"block": pa.int64(), "i": pa.binary(), "id": pa.binary(), "lang": pa.string(), "words": pa.list_(pa.string())}
        return pa.table({c: pa.array(x, kinds.get(c, pa.list_(pa.int64()))) for c, x in out.items()})

    schema = f"block long, i binary, id binary, lang string, {NAMED[pairs]}, f array<long>, ids array<long>"
    return materialise(dealt(blocks, pairs, buckets).groupBy("bucket").applyInArrow(give, schema), name)


def names_of(table: DataFrame, pairs: bool) -> DataFrame:
    """(lang, id, f, word) or (lang, id, f, left, right): a row for each name."""
    singular = {"ids": "id", "f": "f", "words": "word", "lefts": "left", "rights": "right"}
    columns = ["ids", "f", *_key_columns(pairs)]
    rows = table.where("block IS NULL").select("lang", F.explode(F.arrays_zip(*columns)).alias("_e"))
    return rows.select("lang", *[F.col("_e")[c].alias(singular[c]) for c in columns])


def pairs_of(at: np.ndarray, local: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left names, right names, counts, positions) of adjacent named positions; at holds an entry's number or 0 for an end.

    Of several positions in a row without a pair one 0 is left, so the new positions are no longer than what is frequent.
    """
    to = np.zeros(max(int(at.max(initial=0)), int(local.max(initial=0))) + 1, np.int32)
    to[local] = np.arange(1, len(local) + 1, dtype=np.int32)
    now = to[at]
    both = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
    n = len(local) + 1
    pairs, number, counts = np.unique(now[both].astype(np.int64) * n + now[both + 1], return_inverse=True, return_counts=True)
    then = np.zeros(max(len(now) - 1, 0), np.int32)
    then[both] = number + 1
    kept = (then > 0) | np.concatenate([[False], then[:-1] > 0])[: len(then)]
    return ids[pairs // n - 1], ids[pairs % n - 1], counts, then[kept]


def pair_blocks(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(block, lang, lefts, rights, counts, at): each block with its distinct pairs of adjacent names and a number for each position."""
    schema = "block long, lang string, entries long, lefts binary, rights binary, counts binary, at binary"
    kinds = dict(zip(("block", "lang", "entries", "lefts", "rights", "counts", "at"), (pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4), strict=True))

    def replace(key: tuple[pa.Scalar, ...], block: pa.Table, given: pa.Table) -> pa.Table:
        if not block.num_rows or not given.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        local = np.concatenate([np.cumsum(_unpacked(x)) for x in given.column("i").to_pylist()])
        ids = np.concatenate([_unpacked(x) for x in given.column("id").to_pylist()])
        *columns, then = pairs_of(_unpacked(block.column("at")[0].as_py()), local, ids)
        row = [key[0].as_py(), block.column("lang")[0].as_py(), len(columns[0]), *[_packed(x, PAIR_LEVEL) for x in columns], _packed(then)]
        return pa.table({c: pa.array([x], k) for (c, k), x in zip(kinds.items(), row, strict=True)})

    back = names.where("block IS NOT NULL").select("block", "i", "id")
    return blocks.select("block", "lang", "at").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(replace, schema)


def _views(words: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """For k = 2, 3, ...: (id, lang, f, phrase, last, heads, tails); heads and tails count the first and the last 1, 2, ... k-1 words."""
    none = F.array().cast("array<long>")
    view = words.select("id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    out = []
    for pairs in levels:
        x = view.select(F.col("id").alias("left"), F.col("phrase").alias("_head"), F.array_append("heads", F.col("f")).alias("heads"))
        y = view.select(F.col("id").alias("right"), "last", F.array_append("tails", F.col("f")).alias("tails"))
        view = pairs.join(x, "left").join(y, "right").select("id", "lang", "f", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "heads", "tails")
        out.append(view)
    return out


def _score(a: Column, total: Column) -> Column:
    """floor(2000000 a / total) without loss."""
    return F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def collocations(df: DataFrame, longest: int = 4, least: int = 30, inside_percent: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each language.

    A null language is `und`; null, empty and very long texts are allowed (a text is cut at blanks, its pieces go on). Extra
    columns are not read. An empty table gives no rows. Equal scores go by a, then by the phrase's bytes, so ranks are definite.
    """
    blocks = materialise(word_blocks(df, lang_col, text_col), "blocks")
    totals = materialise(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    table = named(blocks, False, least, longest > 1, "words")
    words, levels = names_of(table, False), []
    for k in range(2, longest + 1):
        before, blocks = blocks, materialise(pair_blocks(blocks, table), f"pairs{k}")
        discard(before)
        table = named(blocks, True, least, k < longest, f"names{k}")
        levels.append(names_of(table, True))
    discard(blocks)

    found = []
    for k, (view, longer) in enumerate(zip(_views(words, levels), [*levels[1:], None], strict=True), 2):
        cuts = [F.struct(_score(F.col("f"), F.element_at("heads", j) + F.element_at("tails", k - j)).alias("score"), F.lit(j).alias("k"), F.element_at("heads", j).alias("l"), F.element_at("tails", k - j).alias("r")) for j in range(1, k)]
        scored = view.withColumn("cut", F.array_min(F.array(*cuts)))
        if longer is not None:
            around = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("_longer"))
            percent = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
            scored = scored.join(around, "id", "left").where(F.col("_longer").isNull() | (percent("_longer", 100) < percent("f", inside_percent)))
        found.append(scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = candidates.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("_first", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_first") <= top)
    ranks = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
