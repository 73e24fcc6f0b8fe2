"""The ten operators against brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm._common import hash_share
from marquee.llm import bpe, byte_cnn, html_paths, langid, near_dup, ogg, packing, queries, sharding, tokens, toxicity, weak_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "A b", "<|endoftext|> x", "word " * 30_000, "x" * 50_000, "é" * 700, "a b c d", "a b c d"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(ODD)] + [(None, "null id", "s", 1), (3, "a", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, score int")


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        x = sharding.permute(np.arange(n), n, 5)
        assert sorted(x) == list(range(n))
        assert (sharding.invert(x, n, 5) == np.arange(n)).all()


def test_shards(spark, odd):
    got = sharding.assign_shards(odd, ["doc_id", "text"], 4).toPandas()
    assert len(got) == odd.count() and "score" in got
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    again = sharding.assign_shards(odd.repartition(5), ["doc_id", "text"], 4).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    assert got[key].sort_values(key).astype(str).values.tolist() == again[key].sort_values(key).astype(str).values.tolist()
    assert sharding.assign_shards(odd.limit(0), ["doc_id"], 4).count() == 0


def test_ogg_round_trip():
    rng = np.random.default_rng(0)
    for n in (64, 4096, 65024, 65536 * 3 + 64):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        media = ogg.encode_ogg(payload)
        back, times, cues = ogg.decode_ogg(media)
        assert back == payload and times[-1][1] == n and len(cues) == -(-n // ogg.CUE)
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode_ogg(bytes(broken))


def test_ogg_checksum_bit_by_bit():
    def slow(data):
        r = 0
        for byte in data:
            r ^= byte << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1 & 0xFFFFFFFF
        return r

    assert ogg.page_crc(b"OggS some bytes \x00\xff") == slow(b"OggS some bytes \x00\xff")


def test_ogg_query(spark, odd):
    for r in ogg.read_media(ogg.store_media(odd)).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    got = {r.doc_id: r for r in ogg.read_media(ogg.store_media(odd)).collect()}
    payload = ogg.pad64(ODD[4].encode())
    assert got[4].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[4].tail_crc32 == zlib.crc32(payload[-64:])


def test_language_accuracy_and_mixture(spark):
    got = queries.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_language_edge_rows(spark, odd):
    train = spark.createDataFrame([(1, "the cat and the dog " * 20, "en"), (2, "der hund und die katze " * 20, "de")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[3].lang_pred in ("en", "de")
    both = spark.createDataFrame([(1, "the cat and the dog " * 40 + "der hund und die katze " * 40)], "doc_id long, text string")
    assert sorted(langid.identify(both, model).first().languages) == ["de", "en"]
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(train.limit(0))).collect()} == {"und"}


def test_histogram_packing_uses_every_length():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(rng.randint(1, 200))}
        packed = packing.pack_histogram(histogram)
        used = {}
        for lengths, count in packed:
            assert sum(lengths) <= 1024 and count > 0
            for x in lengths:
                used[x] = used.get(x, 0) + count
        assert used == histogram
    assert packing.pack_histogram({}) == []


def test_packing_covers_every_token(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(odd.where("doc_id is not null and not (doc_id = 3 and text is null)"), path).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for i, own in got.groupby("doc_id"):
        ids = t.encode(ODD[int(i)] or "", add_special_tokens=False).ids + [0]
        own = own.drop_duplicates("start").sort_values("start")
        assert np.frombuffer(b"".join(map(bytes, own["ids"])), "<u2").tolist() == ids and (own["doc_tokens"] == len(ids)).all()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 1024
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))


def test_bpe_equals_the_library(spark, odd):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tokens.tiktoken_encoding(ranks, public_tokenizers.PATTERN)
    texts = [t or "" for t in ODD if not t or len(t) < 40_000] + ["a  b \n\n c\t d", "it's 12ab34 'll x  y  ", "　　a   b"]
    for text, raw in zip(texts, tokens.tiktoken_encoder(ranks, public_tokenizers.PATTERN).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode_ordinary(text)
    got = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks).toPandas()
    assert sorted(bytes(x).decode() for x in got["decoded"]) == sorted((t or "") for t in [*ODD, "null id", "a"])


def test_main_text():
    page = "<html><body><header>Site</header><nav><a href=x>m</a></nav><div class='content'><h1>A &amp; B</h1><p>First para, with words. And more.</p><p>Two</p></div><div class='comments'><p>Nice, very nice!</p></div><footer>f</footer></body></html>"
    assert html_paths.main_text(page) == "A & B\nFirst para, with words. And more.\nTwo"
    assert html_paths.main_text(None) == html_paths.main_text("") == html_paths.main_text("<script>x</script>") == ""
    assert html_paths.main_text("<article><p>a<p>b <b>c\n d</article>") == "a\nb c d"


def test_main_text_is_chosen_by_path_not_by_container():
    prose = ["One long sentence, with words in it, and then some more of them. " * n for n in (3, 5, 4)]
    text = [x.strip() for x in prose]
    body = "".join(f"<p>{x}</p>" for x in text)
    for item in ("<a href=x>Home</a>", "Home"):  # menus without a known tag or class
        menu = "<ul>" + f"<li>{item}</li>" * 6 + "</ul>"
        assert html_paths.main_text(f"<html><body>{menu}{body}{menu}</body></html>") == "\n".join(text)
    whole = "\n".join(["Title", "Lead", " ".join(text)])
    for inner in ("div", "article"):  # title and lead outside the container of the rest
        for outer in ("div", "main"):
            page = f"<body><{outer}><h1>Title</h1><p>Lead</p><{inner}>{' '.join(text)}</{inner}></{outer}></body>"
            assert html_paths.main_text(page) == whole
    halves = f"<body><div>{text[0]}</div><ul><li><a href=x>Home</a></li></ul><div>{text[1]}</div></body>"
    assert html_paths.main_text(halves) == f"{text[0]}\n{text[1]}"
    assert html_paths.main_text(f"<div>{body}<ul><li>Milk</li><li>Eggs</li></ul>{body}</div>") == "\n".join([*text, "Milk", "Eggs", *text])
    assert html_paths.main_text("<body><ul><li><a href=x>Home</a></li></ul></body>") == ""


def test_pages_are_their_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert html_paths.main_text(r.html) == "\n".join(x for x in want if x)


def brute_components(rows, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {rows[i][0]: (len(sets[i]), min(rows[k][0] for k in range(len(rows)) if group[k] == group[i])) for i in range(len(rows))}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    for k in range(120):  # one large group of edited copies, some beyond the limit
        words = list(base)
        for _ in range(rng.randint(0, 16)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        rows.append((100_000 + k, " ".join(words)))
    rows += [(200_000, None), (200_001, ""), (200_002, "one"), (200_003, "ONE"), (200_004, " one ")]
    want = brute_components(rows, width, 80)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_rows(spark, odd):
    assert near_dup.near_duplicates(odd).count() == odd.count()
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_toxic_words_are_found(spark):
    rng = random.Random(1)
    make = lambda bad: " ".join([f"w{rng.randint(0, 300)}" for _ in range(60)] + (["vile"] if bad else []))
    rows = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    fresh = spark.createDataFrame([(1, make(True)), (2, make(False)), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(fresh, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == got[4].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_words_seen_up_to_three_times_count(spark):
    rng = random.Random(3)
    rows = [(" ".join(f"w{rng.randint(0, 300)}" for _ in range(40)) + (f" scarce{3 - i % 3}" if i < 6 else ""), int(i < 60)) for i in range(300)]
    model = toxicity.fit_counts(toxicity.bigram_counts(spark.createDataFrame(rows, "text string, toxic int")))
    *seen, unseen = toxicity.features(["scarce1", "scarce2", "scarce3", "neverseen"], model, toxicity.WordHash())[:, 0]
    assert min(seen) > unseen + 0.1


def test_toxicity_tables_grow_and_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.all_labelled(docs, labels, "toxic")
    assert rows.count() == queries.all_labelled(docs, labels, "toxic", most_sent=0).count() == labels.where("toxic is not null").join(docs, "doc_id").count()
    sent, joined = toxicity.fit(rows), toxicity.fit(rows, local_rows=0)
    assert joined["local"] is None and sent["tables"]["ratio"].count() == toxicity.bigram_counts(rows.where(~(hash_share(F.col("doc_id")) < 0.25) & F.col("text").isNotNull())).select("w").distinct().count()
    more = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "no id")], "doc_id long, text string"), allowMissingColumns=True)
    want = {r.doc_id: r.score for r in toxicity.score(more, sent).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(more, joined).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_toxicity_counts_keep_every_word_apart(spark):
    words = [f"v{i}" for i in range(1 << 20)]
    rows = [(" ".join(words[i : i + 1024]), int(i % 4096 == 0)) for i in range(0, len(words), 1024)]
    model = toxicity.fit_counts(toxicity.bigram_counts(spark.createDataFrame(rows, "text string, toxic int")), local_rows=0)
    assert model["tables"]["ratio"].count() == len(words)


def test_base_measures_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += list(enumerate([None, "", "a b c d e f g h " * 3, "x\nx\n\n \ny\nx", "# $ é|<>"], 10**6))
    got = {r.doc_id: r for r in weak_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        inside = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want


def test_network_covers_every_byte_and_learns(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "mat"]) + ("###" if i % 2 else "") for _ in range(rng.randint(1, 300))) for i in range(300)]
    labels = np.array([1 - i % 2 for i in range(300)], float)
    model = byte_cnn.train(texts[:200], labels[:200])
    net = byte_cnn._Network(model)
    assert ((net.score(texts[200:]) >= 0.3) == labels[200:]).mean() > 0.95
    for text in ["", None, "ab", "q" * 255, "ab" * 700]:
        rows, windows = byte_cnn._matrix(byte_cnn._bytes(text))
        z = sum(model["conv"][k][rows[:, k : k + byte_cnn.STRIDE]] for k in range(byte_cnn.WIDTH))[:, :windows]
        act = np.maximum(z.max(1) + model["bias"], 0)
        want = np.concatenate([act.mean(0), act.max(0)])
        assert np.allclose(net.vectors([text])[0], want, atol=1e-4)
    assert np.allclose(net.score(texts), np.concatenate([net.score([t]) for t in texts]), atol=1e-5)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.01")
    assert first.columns == docs.columns and first.count() > 0.97 * docs.count()
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    groups = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == set(groups.values())


def test_many_labels_are_looked_up_without_a_shuffle_of_texts(spark, monkeypatch):
    """A label a second time gives a second row, as a join does; the driver holds few rows of the table at a time."""
    from marquee.llm import _common

    monkeypatch.setattr(_common, "SENT_ROWS", 100)
    docs = spark.createDataFrame([(i * 7 - 900, None if i % 50 == 0 else f"text {i}") for i in range(1000)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i - 900, i % 3 if i % 5 else None) for i in range(4000)] + [(-900, 1), (6, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    want = sorted(map(str, docs.join(labels.where("toxic IS NOT NULL"), "doc_id").collect()))
    got = queries.all_labelled(docs, labels, "toxic", most_sent=100)
    assert sorted(map(str, got.collect())) == want == sorted(map(str, queries.all_labelled(docs, labels, "toxic", most_sent=0, most_mapped=0).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert queries.all_labelled(docs, labels.where("doc_id > 10000"), "toxic", most_sent=-1).count() == 0


def test_toxicity_models_are_mapped(spark, monkeypatch):
    """Workers share the tables and the driver holds a part of one at a time, so that they may be large before texts are shuffled to their scores."""
    from marquee.llm import _common

    monkeypatch.setattr(_common, "SENT_ROWS", 500)
    words = [f"v{i}" for i in range(1 << 14)]
    rows = [(" ".join(words[i : i + 256]), int(i % 1024 == 0)) for i in range(0, len(words), 256)]
    model = toxicity.fit_counts(toxicity.bigram_counts(spark.createDataFrame(rows, "text string, toxic int")))
    keys, values = model["local"]["ratio"]
    assert len(keys) == len(values) == len(words) and (keys[1:] > keys[:-1]).all()
    assert not keys.flags.owndata and dict(zip(keys.tolist(), values.tolist())) == {r["key"]: r["value"] for r in model["tables"]["ratio"].collect()}
