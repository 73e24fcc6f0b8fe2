"""Near-duplicate components by banded MinHash with odd sketches.

1. One pass over the texts: hashed word shingles, their exact set digest, MinHash samples folded
   into bands, and the odd sketch (a parity bitmap) of the scaled MinHash sample: the shingles whose hash lies under a
   bound that halves as sets grow.
2. Equal sets form one class at once, so copies are never paired.
3. In each band bucket every class is paired with the bucket's hub (its least class id), not with every
   other class. Odd sketches drop pairs whose XOR population count shows too low a similarity; the
   rest are confirmed on full shingle sets. Confirmed links give components.
4. Buckets that still hold several components are compared in blocks on their odd sketches: first
   each class with its nearest partner of another component, one pair a class. Where components still differ, the
   classes with a partner that may be linked meet with their texts, and only links that join two components leave the
   group. Nothing is capped, and no group returns more links than it has rows.

With 22 bands of 4 samples a pair at similarity 0.8 shares no band with probability 1e-5; a sketch drops a pair only if it
differs in more bits than four standard deviations over what the least similarity gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, discard_but, map_text, materialise, mix64, no_clash, temporary, word_hashes

BANDS, ROWS = 22, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Shingles in a scaled MinHash sample, about; larger sets are sampled at a power of two.
SAMPLE = 1024
#: Standard deviations that an estimate may lie off before its pair is dropped.
SLACK = 4.0
#: Classes of one bucket compared at a time; a row has some 500 bytes, so two blocks take a few MB.
BLOCK = 4096
#: Shingles of the texts compared at a time, about.
BLOCK_WEIGHT = 1_000_000
#: Members whose sets meet a hub's set in one group.
GROUP = 128
#: Most rows (of ids and class ids) that are sent to every executor instead of shuffling the texts.
BROADCAST_ROWS = 200_000
_known = WordHash()
_rng = np.random.default_rng(20260101)
_XOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int, known: WordHash) -> list[np.ndarray]:
    """Sorted distinct hashed shingles of each text; a text with fewer words than width is one shingle, one without words is empty."""
    words, offsets = word_hashes(texts, known, lower=True)
    out, seed, mult = [], np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)

    def join(columns):
        h = np.full(len(columns[0]), seed)
        for c in columns:
            h = (h ^ c) * mult
            h ^= h >> np.uint64(29)
        return mix64(h)

    whole = join([words[j : len(words) - width + 1 + j] for j in range(width)]) if len(words) >= width else words[:0]
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(whole[lo : hi - width + 1]))
        elif hi > lo:
            out.append(join([words[i : i + 1] for i in range(lo, hi)]))
        else:
            out.append(words[:0])
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have percent / 100 of their union in common."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (n x BANDS) of non-empty sets."""
    joined, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    mins = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        mins[:, k] = np.minimum.reduceat((joined ^ _XOR[k]) * _MUL[k], starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), np.uint64(b + 1))
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ mins[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def level_of(n: int) -> int:
    """A set of n shingles is sampled at 2 ** -level."""
    return max(0, (max(1, -(-n // SAMPLE)) - 1).bit_length())


def odd_sketch(shingles: np.ndarray, level: int) -> np.ndarray:
    """Parity bitmap of the sample (sets are sorted by hash, so the sample is a head of them)."""
    taken = shingles[: np.searchsorted(shingles, np.uint64(1 << (64 - level)))] if level else shingles
    bit = (mix64(taken) >> np.uint64(54)).astype(np.int64)
    parity = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def most_differing(total, level, percent: int):
    """Bits in which sketches of two sets with `total` shingles together may differ at percent / 100 similarity.

    The sets then differ in at most D = total (1 - J) / (1 + J) shingles, and no more bits than that can differ. Of larger sets
    D 2^-level are sampled, and d sampled ones set n/2 (1 - exp(-2 d / n)) of n bits.
    """
    whole = total * (100 - percent) / (100 + percent)
    rate = 0.5**level
    d = whole * rate
    d = d + SLACK * np.sqrt(d * (1 - rate) + 2 * d * d / SKETCH_BITS) + 3
    return np.where(level == 0, whole + 1e-9, SKETCH_BITS / 2 * (1 - np.exp(-2 * d / SKETCH_BITS)))


def sketch_table(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, cls, bands, level, odd, more) of every row; cls is null for rows without words."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, known):
        sets = shingle_sets(batch.column(1).to_pylist(), width, known)
        n = len(sets)
        full = [i for i in range(n) if len(sets[i])]
        bands = [None] * n
        if full:
            for i, k in zip(full, bands_of([sets[i] for i in full]).view(np.int64), strict=True):
                bands[i] = k
        level = [level_of(len(s)) for s in sets]
        odd = [odd_sketch(s, k).view(np.int64) if len(s) else None for s, k in zip(sets, level, strict=True)]
        # A partner up to a quarter larger may be sampled one level on.
        more = [odd_sketch(s, k + 1).view(np.int64) if 2 * len(s) > SAMPLE else None for s, k in zip(sets, level, strict=True)]
        digests = [set_digest(s) if len(s) else None for s in sets]
        return [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(level, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, n_shingles long, cls binary, bands array<long>, level int, odd array<long>, more array<long>", WordHash, slice_bytes=1 << 20)


def _differing(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def close_pairs(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sizes and odd sketches allow percent / 100 similarity."""
    for x in "ab":
        pairs = pairs.join(sketch.select(*[F.col(c).alias(x if c == "cls" else f"{c}_{x}") for c in ("cls", "n_shingles", "level", "odd", "more")]), x)
    sized = pairs.where((100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")) & (F.abs(F.col("level_a") - F.col("level_b")) <= 1))
    bits = F.when(F.col("level_a") == F.col("level_b"), _differing("odd_a", "odd_b")).when(F.col("level_a") < F.col("level_b"), _differing("more_a", "odd_b")).otherwise(_differing("odd_a", "more_b"))

    # most_differing as an expression.
    whole, rate = (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - percent) / (100 + percent), F.pow(F.lit(0.5), F.greatest("level_a", "level_b"))
    d = whole * rate
    d = d + SLACK * F.sqrt(d * (1 - rate) + 2 * d * d / SKETCH_BITS) + 3
    allowed = F.when(F.greatest("level_a", "level_b") == 0, whole + 1e-9).otherwise(SKETCH_BITS / 2 * (1 - F.exp(-2 * d / SKETCH_BITS)))
    return sized.where(bits <= allowed).select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs of classes whose full sets reach percent / 100.

    pairs: distinct (a, b); members: (cls, member) with one id for each class; texts: (id, text). A class's text meets at most
    about GROUP partners' texts in one group, where the sets are made anew and checked against the class ids.
    """
    spark = pairs.sparkSession
    shared = materialise(pairs, "pairs")
    sizes = shared.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    dealt = shared.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / GROUP)))
    wanted = dealt.select("a", "salt", F.col("b").alias("cls"), F.lit(False).alias("hub"))
    wanted = wanted.unionByName(dealt.select("a", "salt", F.col("a").alias("cls"), F.lit(True).alias("hub")).distinct())
    asked = materialise(wanted.join(members, "cls"), "asked")
    rows = asked.count()
    # Few enough to send everywhere, else the texts are shuffled to them.
    small = F.broadcast(asked) if rows <= BROADCAST_ROWS else asked
    chunk = F.pmod(F.xxhash64("a", "salt"), F.lit(max(1, rows // GROUP)))
    met = texts.join(small, texts["id"].eqNullSafe(small["member"])).select(chunk.alias("chunk"), "a", "salt", "cls", "hub", "text")

    def check(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("a", "ascending"), ("salt", "ascending"), ("hub", "descending")])
        cls, hubs = rows.column("cls").to_pylist(), rows.column("hub").to_pylist()
        a, b, hub, at = [], [], None, None
        for lo in range(0, len(cls), GROUP):
            sets = shingle_sets(rows.column("text").slice(lo, GROUP).to_pylist(), width, _known)
            for own, is_hub, x in zip(cls[lo : lo + GROUP], hubs[lo : lo + GROUP], sets, strict=True):
                if set_digest(x) != own:
                    continue  # another text under the same id
                if is_hub:
                    hub, at = x, own
                    continue
                if linked(x, hub, percent):
                    a.append(at)
                    b.append(own)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return met.groupBy("chunk").applyInArrow(check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(cls, label) for every class in a link: label is the least class reachable.

    Each round hooks every component to its least neighbour and jumps once, then goes on with the links between
    labels only; rounds grow with the logarithm of the links.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    edges = links
    while True:
        one = edges.join(labels.select(F.col("cls").alias("a"), F.col("label").alias("la")), "a")
        two = one.join(labels.select(F.col("cls").alias("b"), F.col("label").alias("lb")), "b")
        cross = materialise(two.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "cross")
        # Labels are classes too: a label's own label may be smaller by now.
        roots = labels.select(F.col("cls").alias("label"), F.col("label").alias("up")).where("label <> up")
        hooks = cross.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("hook"))
        moved = labels.join(hooks, "label", "left").join(roots, "label", "left").where("hook IS NOT NULL OR up IS NOT NULL")
        if moved.isEmpty():
            return labels
        step = labels.join(hooks, "label", "left").join(roots, "label", "left").select("cls", F.least("label", "hook", "up").alias("label"))
        labels = materialise(step, "labels")
        edges = cross


def _open_rows(shared_rows: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several labels, without the hub, which has met them all; minor: not of the bucket's largest label."""
    labelled = shared_rows.where("n > 2").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rows = labelled.where("cls <> hub").join(several, "key", "left_semi")
    held = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_c")).groupBy("key").agg(F.max_by("label", F.struct("_c", "label")).alias("bulk"))
    return materialise(rows.join(held, "key").withColumn("minor", F.col("label") != F.col("bulk")).join(bits, "cls").select("key", "cls", "label", "minor", "n_shingles", "level", "odd", "more", "bands"), "open")


def _meetings(rows: DataFrame, weight: str) -> DataFrame:
    """rows with g, i, j and block: the groups in which blocks of one bucket meet.

    A block has about BLOCK rows and BLOCK_WEIGHT of the weight. Rows of a bucket's largest label never meet each
    other, so they are sent once per block of the others; a bucket of one block is one of many in its group.
    """
    load = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(weight) / BLOCK_WEIGHT)
    sizes = rows.groupBy("key", "minor").agg(load.alias("load")).groupBy("key").agg(F.sum("load").alias("all"), F.coalesce(F.sum(F.when(F.col("minor"), F.col("load"))), F.lit(0.0)).alias("few"))
    total = rows.agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.coalesce(F.sum(weight), F.lit(0)) / BLOCK_WEIGHT)).first()[0]
    sizes = sizes.withColumn("p", F.ceil("few").cast("int")).withColumn("q", F.ceil(F.col("all") - F.col("few")).cast("int"))
    one = F.col("all") <= 1
    dealt = rows.join(sizes, "key")
    block = F.when(one, F.lit(0)).when(F.col("minor"), F.pmod(F.xxhash64("cls"), F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(F.xxhash64("cls"), F.greatest("q", F.lit(1)))).cast("int")
    last = F.when(one, F.lit(0)).when(F.col("minor"), F.col("p") + F.col("q") - 1).otherwise(F.col("p") - 1)
    met = dealt.withColumn("block", block).where(last >= 0).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    group = F.when(one, F.pmod(F.xxhash64("key"), F.lit(max(1, int(total))))).otherwise(F.col("key"))
    return met.select(*rows.columns, "block", group.alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _buckets_of(rows: pa.Table):
    """rows sorted by bucket, and each bucket's first and last-but-one position."""
    rows = rows.sort_by([("key", "ascending"), ("cls", "ascending")])
    keys = rows.column("key").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return rows, keys, list(zip(edges[:-1], edges[1:], strict=True))


def _sides(block: np.ndarray, lo: int, hi: int, i: int, j: int):
    """(position, positions it meets) for every pair of positions of a bucket in blocks i and j, each pair once."""
    own = np.arange(lo, hi)
    left, right = own[block[lo:hi] == i], own[block[lo:hi] == j]
    for x in left:
        yield x, right[right > x] if i == j else right


def _sketch_distance(x: int, others: np.ndarray, odd, more, level) -> np.ndarray:
    theirs = np.where((level[others] < level[x])[:, None], more[others], odd[others])
    mine = np.where((level[others] > level[x])[:, None], more[x], odd[x])
    return np.bitwise_count(theirs ^ mine).sum(1)


def _fitting(x: int, others: np.ndarray, size, level, percent: int) -> np.ndarray:
    fits = (100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])) & (np.abs(level[others] - level[x]) <= 1)
    return others[fits]


def _sketch_meetings(open_rows: DataFrame, percent: int, found, schema: str) -> DataFrame:
    """found(...) of every two blocks that meet: it is handed the rows and an iterator of (position, positions whose sketches allow a link, distances)."""

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rows, keys, buckets = _buckets_of(rows)
        block, codes = rows.column("block").to_numpy(), np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
        odd = np.array(rows.column("odd").to_pylist(), np.int64).reshape(len(rows), -1).view(np.uint64)
        more = np.array([x if x is not None else [0] * odd.shape[1] for x in rows.column("more").to_pylist()], np.int64).reshape(len(rows), -1).view(np.uint64)
        size, level = rows.column("n_shingles").to_numpy(), rows.column("level").to_numpy()

        def candidates():
            for lo, hi in buckets:
                for x, others in _sides(block, lo, hi, i, j):
                    others = _fitting(x, others[codes[others] != codes[x]], size, level, percent)
                    if len(others):
                        far = _sketch_distance(x, others, odd, more, level)
                        near = far <= most_differing(size[others] + size[x], np.maximum(level[others], level[x]), percent)
                        if near.any():
                            yield x, others[near], far[near]

        return found(key, rows, keys, candidates())

    return _meetings(open_rows, "level").groupBy("g", "i", "j").applyInArrow(compare, schema)


def nearest_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class of open_rows, if not of a bucket's largest label, with the class of another label that its sketch is nearest to, if any may be linked.

    At most one pair a class, whatever the size of its buckets.
    """

    def nearest(key, rows: pa.Table, keys, candidates) -> pa.Table:
        best, mate = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)
        for x, others, far in candidates:
            k = int(np.argmin(far))
            if far[k] < best[x]:
                best[x], mate[x] = far[k], others[k]
            closer = far < best[others]
            best[others[closer]], mate[others[closer]] = far[closer], x
        at = np.flatnonzero((mate >= 0) & rows.column("minor").to_numpy(zero_copy_only=False))
        cls = rows.column("cls").to_pylist()
        return pa.table({"cls": pa.array([cls[k] for k in at], pa.binary()), "mate": pa.array([cls[k] for k in mate[at]], pa.binary()), "far": pa.array(best[at], pa.int64())})

    found = _sketch_meetings(open_rows, percent, nearest, "cls binary, mate binary, far long")
    best = found.groupBy("cls").agg(F.min_by("mate", F.struct("far", "mate")).alias("mate"))
    return best.select(F.least("cls", "mate").alias("a"), F.greatest("cls", "mate").alias("b")).distinct()


def forest_links(open_rows: DataFrame, texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) links on full sets that join the labels of every bucket of open_rows as far as they can be joined.

    First the classes are marked whose sketches allow a link to another label, each two in the first bucket they share. Then the
    marked ones meet again with their texts, and a group returns only links that join two of its parts: fewer than it has rows.
    """

    def mark(key, rows: pa.Table, keys, candidates) -> pa.Table:
        bands = np.array(rows.column("bands").to_pylist(), np.int64).reshape(len(rows), -1)
        marked = np.zeros(len(rows), bool)
        for x, others, _ in candidates:
            same = bands[others] == bands[x]
            first = bands[x][np.argmax(same, 1)] == keys[x]
            marked[x] |= first.any()
            marked[others[first]] = True
        return rows.select(["key", "cls", "label", "minor", "n_shingles"]).filter(pa.array(marked))

    marked = materialise(_sketch_meetings(open_rows, percent, mark, "key long, cls binary, label binary, minor boolean, n_shingles long").distinct(), "marked")
    asked = materialise(_meetings(marked, "n_shingles").join(members, "cls"), "asked")
    small = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    met = texts.join(small, texts["id"].eqNullSafe(small["member"])).select("g", "i", "j", "key", "cls", "label", "block", "text")

    def join(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rows, _, buckets = _buckets_of(rows)
        block, cls, label = rows.column("block").to_numpy(), rows.column("cls").to_pylist(), rows.column("label").to_pylist()
        sets = []
        for lo in range(0, len(cls), GROUP):
            sets += shingle_sets(rows.column("text").slice(lo, GROUP).to_pylist(), width, _known)
        # Another text under the same id has another class: it takes no part.
        size = np.array([len(x) if set_digest(x) == own else 0 for x, own in zip(sets, cls, strict=True)])
        level = np.array([level_of(int(n)) for n in size])
        odd = np.array([odd_sketch(x, k) for x, k in zip(sets, level, strict=True)])
        more = np.array([odd_sketch(x, k + 1) for x, k in zip(sets, level, strict=True)])
        names = np.unique(np.array(label, object), return_inverse=True)[1]
        a, b = [], []
        for lo, hi in buckets:
            for x, others in _sides(block, lo, hi, i, j):
                others = _fitting(x, others[(names[others] != names[x]) & (size[others] > 0) & (size[x] > 0)], size, level, percent)
                if not len(others):
                    continue
                far = _sketch_distance(x, others, odd, more, level)
                near = far <= most_differing(size[others] + size[x], np.maximum(level[others], level[x]), percent)
                for y in others[near][np.argsort(far[near], kind="stable")]:
                    if names[x] != names[y] and linked(sets[x], sets[y], percent):
                        a.append(min(cls[x], cls[y]))
                        b.append(max(cls[x], cls[y]))
                        names[names == names[y]] = names[x]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return met.groupBy("g", "i", "j").applyInArrow(join, "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row.

    Words are lower-cased in A-Z only and split at ASCII white space. Rows whose shingle sets reach percent / 100 similarity are
    linked; component_id is the least id reachable. Rows without words (null, empty, blank) have no shingle and are their own
    component. Rows with a null id take part; a component of null ids only has a null component_id, and null ids are never kept
    there. Extra columns are not read; the id column may not have the name of a column that is made. Tables on the way are deleted.
    """
    no_clash([id_col], "n_shingles", "cls", "bands", "level", "odd", "more", "label", "member", "component_id", "kept")
    with temporary() as made:
        table, members, labels = _labelled(df, width, percent, id_col, text_col)
    discard_but(made, table, members, labels)
    classes = members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = classes.groupBy("label").agg(F.min("member").alias("component_id"))
    of_class = classes.join(least, "label").select("cls", "component_id")
    out = table.select(id_col, "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _labelled(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, members, labels of classes), written."""
    table = materialise(sketch_table(df, width, id_col, text_col), "sketches")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = materialise(table.where("cls IS NOT NULL").groupBy("cls").agg(F.min(id_col).alias("member")), "members")
    sketch = materialise(table.where("cls IS NOT NULL").select("cls", "bands", "n_shingles", "level", "odd", "more").dropDuplicates(["cls"]), "classes")
    rows = sketch.select("cls", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("hub")).where("n > 1")
    shared_rows = materialise(rows.join(buckets, "key"), "buckets")

    pairs = shared_rows.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    close = close_pairs(pairs, sketch, percent)
    links = materialise(confirm(close, texts, members, width, percent), "links")
    labels = components(links)

    for by_texts in (False, True):
        open_rows = _open_rows(shared_rows, labels, sketch)
        found = forest_links(open_rows, texts, members, width, percent) if by_texts else confirm(nearest_pairs(open_rows, percent), texts, members, width, percent)
        more = materialise(found, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return table, members, labels
