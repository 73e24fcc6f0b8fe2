"""Collocations, SimHash components and resampling against brute force, and their odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from marquee.llm import collocations, resample, simhash

SCHEMA = "doc_id long, text string, lang string, label string, score double, rank long, fp long, id long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "x", 0.5, 7, 3, 9) for i, t, g in rows], SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_texts(seed, n, words=12, length=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ünder", "日本", "ABC"]
    out = []
    for _ in range(n):
        picked = rng.choice(len(vocabulary), rng.integers(0, length), p=np.r_[0.3, np.full(len(vocabulary) - 1, 0.7 / (len(vocabulary) - 1))])
        out.append("".join(vocabulary[k] + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for k in picked))
    return out


def brute_phrases(rows, longest, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in often.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p, counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, _, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest,least,top", [(4, 3, 2000), (4, 2, 5), (3, 4, 2000), (5, 2, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, least, top):
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(some_texts(5, 160))]
    rows += [(900, None, "en"), (901, "", "en"), (902, " .,\n", None), (903, "only once here", "fr"), (1, rows[1][1], "de"), (None, "a b a b a b a b", "en")]
    got = collocations.collocations(frame(spark, rows), longest, least, 80, top)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, least, 80, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_long_texts_are_cut_between_words_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CUT_BYTES", 64)
    block = collocations.Block()
    text = "one two three four, five six\tseven. " * 40
    block.add(text)
    words, counts, at = block.row()
    positions = collocations._unpacked(at)
    spelled = " ".join("." if x == 0 else words[x - 1].decode() for x in positions)
    assert spelled.split() == (text.translate(str.maketrans({",": " . ", ".": " . ", "\t": " "}))).split() + ["."]
    assert counts.tolist() == [spelled.split().count(w.decode()) for w in words]
    unbroken = collocations.Block()
    unbroken.add("x" * 500)
    assert unbroken.row()[0] == [b"x" * 500]


def test_phrases_of_many_blocks_and_empty_tables(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(some_texts(8, 60))]
    want = brute_phrases(rows, 4, 3, 80, 2000)
    blocks = collocations.word_blocks(frame(spark, rows).repartition(7)).collect()
    assert len({b.block for b in blocks}) == len(blocks) > 1
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(7), 4, 3).collect()) == want
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None)])).count() == 0


@pytest.mark.parametrize("entries", [1, 17, 10**9])
def test_phrases_do_not_depend_on_the_buckets(spark, monkeypatch, entries):
    monkeypatch.setattr(collocations, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 1)
    rows = [(i, t, ["en", "de"][i % 2]) for i, t in enumerate(some_texts(21, 30))]
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(3), 4, 3).collect()) == brute_phrases(rows, 4, 3, 80, 2000)


def test_packed_numbers_come_back():
    for numbers in ([], [0], [255], [256, 3], [1 << 16], [1 << 32, 7], [(1 << 62) + 5]):
        assert collocations._unpacked(collocations._packed(np.array(numbers, np.int64))).tolist() == numbers
    rising = np.array([3, 4, 900, 70_000])
    assert np.cumsum(collocations._unpacked(collocations._rising(rising))).tolist() == rising.tolist()


def test_scores_do_not_overflow(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(9_000_000_000_000_000_000, 4_500_000_000_000_000_001)], "a long, t long")
    assert d.select(collocations._score(F.col("a"), F.col("t"))).first()[0] == 2000000 * 9_000_000_000_000_000_000 // 4_500_000_000_000_000_001


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, most):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                parent[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        base = [f"t{rng.integers(0, 3000)}" for _ in range(int(rng.integers(60, 400)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            other = list(base)
            other[int(rng.integers(0, len(other)))] = "changed"
            texts.append("\t".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    texts += [None, "", " \n", "one", "ONE", "one two", "one two three four", "é é é é", texts[0]]
    rows = [(None if i % 17 == 3 else i, t, "en") for i, t in enumerate(texts)]
    got = simhash.simhash_components(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_print(t) for t in texts]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints, 2), strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert len({p for p in prints}) < len(prints) and len({c for *_, c in want}) < len({p for p in prints}) + 1


@pytest.mark.parametrize("limit", [2, 9, 256])
def test_links_join_what_brute_force_joins(spark, limit):
    """A dense ball, chains and far prints; small limits send the ball through the single-bit pivots."""
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    prints = {centre ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for _ in range(120)} | {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    chain = int(rng.integers(0, 2**64, dtype=np.uint64))
    for b in range(0, 64, 2):
        chain ^= 3 << b
        prints.add(chain)
    prints |= {0, 1, 7, 2**64 - 1, 2**63}
    prints = sorted(prints)
    d = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(5)
    links = [tuple(np.array(r, np.int64).view(np.uint64).tolist()) for r in simhash.near_links(d, 2, limit).collect()]
    assert all(bin(a ^ b).count("1") in (1, 2) for a, b in links)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    want = brute_components(prints, prints, 2)
    assert len({root(p) for p in prints}) == len(set(want))
    assert all((root(p) == root(q)) == (x == y) for p, x in zip(prints, want, strict=True) for q, y in zip(prints, want, strict=True))


def test_pivot_table_bounds_and_prunes():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    assert np.abs(simhash.distance_table(fps) - simhash.distance_table(near)).max() <= 2
    assert (simhash.coarse_keys(fps, 2) == simhash.coarse_keys(near, 2)).any(1).all()
    assert (simhash.fine_keys(fps, 2) == simhash.fine_keys(near, 2)).any(1).all()
    table = simhash.distance_table(fps)
    passing = sum(int((np.abs(table[i] - table[i + 1 :]).max(1, initial=0) <= 2).sum()) for i in range(300))
    assert passing < 5  # of 44,850 pairs, none of which is a link
    keys = simhash.fine_keys(fps[:1], 2)[0]
    assert len(keys) == 120 and len(set(keys.tolist())) > 1


def test_simhash_of_empty_tables(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in simhash.simhash_components(frame(spark, [(None, None, None)])).collect()] == [(None, "0" * 16, None)]


def brute_draw(rows, aims, percent, least_words, longest, buckets):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    source, target = Counter(b for _, t, _ in rows for b in features(t)[1]), Counter(b for t in aims for b in features(t)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log(((target[b] + 1) * (s_all + buckets)) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc, text, _ in rows:
        w, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least_words])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): k for k, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("percent,least_words,longest,buckets", [(10, 20, 1, 10_000), (50, 5, 2, 97), (100, 0, 3, 1000), (0, 0, 1, 10)])
def test_draw_equals_brute_force(spark, percent, least_words, longest, buckets):
    rows = [(i, t, "en") for i, t in enumerate(some_texts(3, 250, 60, 80))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "...", None), (1003, "日本 " * 30, "ja"), (None, "w1 w2 " * 15, "en"), (7, rows[7][1], "en"), (1004, "word " * 50_000, "en")]
    aims = ["w1 w2 W3 und", "日本, ünder w5-w6", None, ""]
    target = spark.createDataFrame(list(enumerate(aims)), "item_id long, text string")
    got = resample.resample(frame(spark, rows).repartition(6), target, percent, least_words, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_draw(rows, aims, percent, least_words, longest, buckets)


def test_draw_from_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(frame(spark, []), none).count() == 0
    got = resample.resample(frame(spark, [(1, "a b c", "en")]), none, 100, 1).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in got] == [(1, 3, 1)]


def test_many_equal_scores_are_ranked_once(spark):
    rows = [(5, "same words here", "en")] * 40 + [(i, "same words here", "en") for i in range(40)]
    ranks = [r["rank"] for r in resample.resample(frame(spark, rows), spark.createDataFrame([(1, "same")], "item_id long, text string"), 50, 1).collect()]
    assert sorted(x for x in ranks if x is not None) == list(range(1, 41))


def test_collocations_hand_on_packed_blocks(spark):
    """Arrow batches hold many blocks, so a list of a block's words or pairs as an array of longs would take memory outside the heap that grows with the partition."""
    rows = [("x y z x y, x y " * 20, "a"), ("x y", "b")] * 3
    blocks = collocations.word_blocks(frame(spark, [(k, *r) for k, r in enumerate(rows)]))
    pairs = collocations.pair_blocks(blocks, collocations.named(blocks, False, 1, True, "words"))
    for table in (blocks, pairs):
        assert not [f.name for f in table.schema if f.dataType.typeName() == "array"]
    for row in pairs.collect():
        lefts, rights, counts = (collocations._unpacked(row[c]) for c in ("lefts", "rights", "counts"))
        assert len(lefts) == len(rights) == len(counts) == row["entries"] > 0
