"""Clashing names, nulls, long rows and empty tables of the operators; the whole pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import bpe, byte_cnn, langid, ogg, packing, queries, sharding, toxicity, weak_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_shards_keep_every_column(spark):
    d = spark.createDataFrame([(i, i * 2, "x", 1.0, "s") for i in range(50)], "doc_id long, _row long, _rows string, _own_at double, shard string")
    got = sharding.assign_shards(d, ["doc_id"], 3)
    assert got.columns == ["doc_id", "_row", "_rows", "_own_at", "shard", "slot"]
    assert {(r.doc_id, r._row, r._rows) for r in got.collect()} == {(i, i * 2, "x") for i in range(50)}


def test_shard_query_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op1_sharding(spark, SF).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 8
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_row_numbers_equal_brute_force(spark):
    d = spark.createDataFrame([(i % 37 if i % 5 else None, i) for i in range(200)], "k long, v long")
    got = sharding.global_row_numbers(d, ["k", "v"], buckets=7).withColumn("b", F.pmod(F.xxhash64("k", "v"), F.lit(7))).collect()
    ordered = sorted(got, key=lambda r: (r.b, r.k is not None, r.k or 0, r.v))
    assert [r._row for r in ordered] == list(range(200)) and {r._rows for r in got} == {200}


def test_null_and_damaged_media(spark):
    media = spark.createDataFrame([(1, 0, None), (2, 3, bytearray(ogg.encode_ogg(ogg.pad64(b"abc"))))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in ogg.read_media(media).collect()}
    assert got[1].payload_bytes is None and got[1].feature is None and got[2].payload_bytes == 64
    whole = ogg.encode_ogg(bytes(range(256)) * 800)
    starts = [*(i for i in range(len(whole)) if whole.startswith(b"OggS", i)), len(whole)]
    pages = [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    serial = [p[14:18] for p in pages]
    one = next(s for s in serial if serial.count(s) > 3)
    i, j = [k for k, s in enumerate(serial) if s == one][1:3]
    swapped = list(pages)
    swapped[i], swapped[j] = pages[j], pages[i]
    damaged = [b"".join(pages[:i] + pages[i + 1 :]), b"".join(swapped), whole[:-5], b"".join(pages[:-1]), b"", b"OggS"]
    for x in damaged:
        with pytest.raises(ogg.OggError):
            ogg.decode_ogg(x)
    with pytest.raises(ogg.OggError):
        ogg.packet_times([(b"ab", None)])


def test_language_columns_may_not_clash(spark):
    d = spark.createDataFrame([(1, "the cat sat", "en")], "doc_id long, text string, lang_pred string")
    with pytest.raises(ValueError, match="outputs"):
        langid.identify(d, {"languages": [], "log_p": np.zeros((1 << langid.BITS, 0))}, extra=[F.col("lang_pred")])


def test_mixture_equals_brute_force():
    """EM over word likelihoods, word by word and document by document."""
    rng = np.random.default_rng(3)
    offsets = np.array([0, 5, 5, 12])
    like, base = rng.random((12, 3)), rng.normal(size=12)
    doc = np.repeat([0, 1, 2], np.diff(offsets))
    allowed = np.array([[1.0, 1, 0], [1, 1, 1], [0, 1, 1]])
    pi, total = langid._em(like, base, offsets, doc, allowed, 4)
    for i in (0, 2):
        p = allowed[i] / allowed[i].sum()
        words = [w for w in range(12) if doc[w] == i]
        for _ in range(4):
            new = np.zeros(3)
            for w in words:
                joint = like[w] * p
                new += joint / joint.sum()
            p = new / len(words)
        assert np.allclose(pi[i], p) and total[i] == pytest.approx(sum(np.log((like[w] * p).sum()) + base[w] for w in words))


def test_decode_slices_by_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_IDS", 3)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["a b c d e f g h", "", None, "x", "y z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(d, ranks, public_tokenizers.PATTERN), ranks).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_long_training_texts_are_drawn_from_end_to_end():
    text = "".join(chr(97 + i // 1000 % 26) for i in range(26_000))
    assert byte_cnn.drawn_chunks(text, 50_000) == text.encode()
    got = byte_cnn.drawn_chunks(text, 2560)
    assert len(got) == 2560 and got.startswith(b"a") and got.endswith(b"z") and len(set(got)) > 8


def test_quality_through_spark(spark):
    rows = [(i, ("###" if i % 2 else "fine words here ") * 40, 1 - i % 2) for i in range(120)] + [(None, "no id " * 30, 1), (7, None, 1), (8, "long text " * 20_000, 1)]
    model = byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    odd = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (3, "fine words here " * 20, "k"), (3, "### " * 50, "k")], "doc_id long, text string, note string")
    got = byte_cnn.score(odd, model, extra=[F.col("note")]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.note == "k" for r in got) and byte_cnn.score(odd.limit(0), model).count() == 0
    empty = byte_cnn.fit(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert {round(r.score, 3) for r in byte_cnn.score(odd, empty).collect()} == {0.5}


def test_toxicity_without_labels_or_with_one_class(spark):
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "some words")], "doc_id long, text string")
    for rows, want in (([], 0), ([(i, f"words {i}", 0) for i in range(40)], 0), ([(i, f"words {i}", 1) for i in range(40)], 1)):
        got = toxicity.score(odd, toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))).collect()
        assert len(got) == 3 and {r.predicted for r in got} == {want}


def test_unigrams_equal_their_definition(spark):
    rows = [("a b a c", 1), ("a d", 0), ("b b e", 0)]
    model = toxicity.fit_counts(toxicity.bigram_counts(spark.createDataFrame(rows, "text string, toxic int")))
    known = toxicity.WordHash()
    words = {w: int(toxicity._tokens([w], known)[0][0]) for w in "abcde"}
    texts = [(t.split(), y) for t, y in rows]
    count = {y: Counter(w for t, k in texts if k == y for w in t) for y in (1, 0)}
    pairs = {(h, w) for t, _ in texts for h, w in zip(["<s>", *t], t, strict=False)}
    kinds = len({w for t, _ in texts for w in t}) + 1
    size = {y: sum(count[y].values()) for y in (1, 0)}

    def p(w, y):
        kept = sum(max(c - toxicity.DISCOUNT, 0) for c in count[y].values())
        part = toxicity.SHARED * size[y] / sum(size.values())
        cont = sum(x == w for _, x in pairs)
        return (max(count[y][w] - toxicity.DISCOUNT, 0) + (size[y] - kept) * (cont + 0.5) / (len(pairs) + 0.5 * kinds) + part) / (size[y] + part * kinds)

    key, value = model["local"]["ratio"]
    got = dict(zip(key.view(np.uint64).tolist(), value.tolist(), strict=True))
    for w, h in words.items():
        assert got[h] == pytest.approx(np.log(p(w, 1)) - np.log(p(w, 0)), abs=1e-5)


def test_measures_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    assert sorted(r.n_words for r in weak_rules.measure(d).collect()) == [0, 0, 1, 1] and weak_rules.measure(d.limit(0)).count() == 0


def test_whole_pipeline(spark):
    """Each stage against a plain reading of the one before: what it drops, and that what it keeps is unchanged."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    first = corpus_pipeline.language_id(spark, docs, sf)
    second = corpus_pipeline.quality(spark, first, sf)
    kept, before = {tuple(r) for r in second.collect()}, {tuple(r) for r in first.collect()}
    assert kept <= before <= {tuple(r) for r in docs.collect()} and second.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r[0] for r in before if labels.get(r[0]) == 1]
    bad = [r[0] for r in before if labels.get(r[0]) == 0]
    ids = {r[0] for r in kept}
    assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i in ids for i in bad) <= 0.5 * len(bad)
    packed = corpus_pipeline.run(spark, sf).collect()
    third = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, second, sf).collect()}
    assert {r.doc_id for r in packed} == third
    by = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.length for r in own) == own[0].doc_tokens for own in by.values())


def test_pipeline_stages_on_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "the words of a text that is here", "en", "s", 3), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, d, SF)
            assert got.columns == corpus_pipeline.COLUMNS and got.count() <= d.count()
        assert corpus_pipeline.pack(spark, d, SF).count() == d.count()
    assert packing.pack_histogram({5: 1}) == [((5,), 1)]


def test_outputs_may_not_be_carried_columns(spark):
    from marquee.llm import html_paths, near_dup, resample, simhash

    d = spark.createDataFrame([(1, "a b c", "<p>x</p>", 2)], "cls long, text string, html string, n_chars int")
    with pytest.raises(ValueError, match="outputs"):
        near_dup.near_duplicates(d, id_col="cls")
    with pytest.raises(ValueError, match="outputs"):
        html_paths.extract(d, "cls", "html", ("n_chars",))
    scored = d.withColumnRenamed("cls", "score")
    model = {"x": 1}
    for operator in (lambda: toxicity.score(scored, model, "score"), lambda: byte_cnn.score(scored, model, "score"), lambda: resample.resample(scored, d, id_col="score"), lambda: simhash.simhash_components(scored.withColumnRenamed("score", "fp"), id_col="fp")):
        with pytest.raises(ValueError, match="outputs"):
            operator()


def test_tables_on_the_way_are_deleted(spark):
    import os

    from marquee.llm import _common, collocations, near_dup, simhash

    folder = _common.shared_dir(spark).removeprefix("file:")
    d = spark.createDataFrame([(i, f"one two three four five six {i // 3} seven eight nine ten {i % 2}") for i in range(12)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    for operator, left in ((near_dup.near_duplicates, 3), (simhash.simhash_components, 3), (lambda x: collocations.collocations(x, 3, 2), 4)):
        before = set(os.listdir(folder))
        got = operator(d)
        assert got.count() > 0 and len(set(os.listdir(folder)) - before) == left
        assert got.count() > 0
    with _common.temporary() as made:
        kept, gone = _common.materialise(d, "kept"), _common.materialise(d, "gone")
    _common.discard_but(made, kept)
    assert os.path.exists(kept._written.removeprefix("file:")) and not os.path.exists(gone._written.removeprefix("file:")) and not _common._temporary


def test_components_of_long_texts_equal_brute_force(spark):
    """Texts of over 1,024 shingles, whose sketches sample, around the threshold."""
    from marquee.llm import near_dup

    rng = np.random.default_rng(12)
    texts = []
    for _ in range(8):
        base = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(1100, 3200)))]
        texts.append(base)
        for share in (0.02, 0.05, 0.0525, 0.056, 0.06, 0.1):
            other = list(base)
            for at in rng.choice(len(base), int(share * len(base)), replace=False):
                other[at] = f"x{rng.integers(0, 10**9)}"
            texts.append(other)
    sets = [{(a, b) for a, b in zip(t[:-1], t[1:], strict=True)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(d, width=2).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and links > 8 and len(set(got.values())) > 8
