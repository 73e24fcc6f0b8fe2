"""Packed sequences hold their tokens, and op4's digests come from them."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import packing, queries, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_ids_and_op4_digests_them(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = {(r.doc_id, r.start): r for r in corpus_pipeline.pack(spark, docs, SF).collect()}
    assert all(len(r.ids) == 2 * r.length for r in packed.values())
    got = {(r.doc_id, r.start): r for r in queries.op4_packing(spark, SF).collect()}
    assert got.keys() == packed.keys() and "ids" not in next(iter(got.values()))
    for k, r in got.items():
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(packed[k].ids, "<u2").astype("<u4")) and r.sequence_id == packed[k].sequence_id
    # Whatever happens to the ids on the way shows in the digests.
    whole = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: whole(*a, **k).withColumn("ids", F.substring("ids", 1, 2)))
    assert {r.ids_crc32 for r in queries.op4_packing(spark, SF).limit(50).collect()} <= {zlib.crc32(r.ids[:2] + bytes(2)) for r in packed.values()}


@pytest.mark.parametrize("long", [4096, 6])
def test_ids_are_the_library_s_for_odd_texts(monkeypatch, long):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "LONG", long)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, ours = Tokenizer.from_file(path), tokens.huggingface_encoder(path)
    rng = random.Random(long)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "a", "é", "12", "x1", "'s", "…", "\u3000", " foo", "bar ", "<|", "|>", "endoftext", " the", "\u0301", "\x00", "\x85", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for text, raw in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("units", [300_000, 50])
def test_columns_have_the_library_s_ids_at_every_kind_of_cut(monkeypatch, units):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "COLUMN_UNITS", units)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.huggingface_encoder.cache_clear()
    plain, ours = Tokenizer.from_file(path), tokens.huggingface_encoder(path)
    rng = random.Random(units)
    parts = [*".,;:!?'|×÷éßÀñ…", "\n", "\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "᠎", "​", "̀"]
    parts += [" ", " ", " ", "  ", "The", " er", "x", "Q", "7", "12", "'s", "'ll", "don't", "²", "ª", "中", "й", "🙂", "<|endoftext|>", "<|endoftext"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) if rng.random() < 0.95 else None for _ in range(250)]
        column = pa.array(["left out.\n", *texts, None], pa.string()).slice(1, len(texts))
        ids, ends = ours.encode_column(column)
        assert len(ends) == len(texts) + 1 and 4 * ends[-1] == len(ids)
        for text, lo, hi in zip(texts, ends, ends[1:], strict=False):
            assert np.frombuffer(ids, "<u4")[lo:hi].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
    for text in [".", " ", "\n", "é", "a.", "\né", "..", "é."]:
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    for empty in ([], [None, ""]):
        ids, ends = ours.encode_column(pa.array(empty, pa.string()))
        assert not len(ids) and ends.tolist() == [0] * (len(empty) + 1)


def test_words_are_encoded_once_whatever_marks_and_lines_follow(monkeypatch):
    tokens.huggingface_encoder.cache_clear()
    ours = tokens.huggingface_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    handed, encode_many = [], ours.encode_many
    monkeypatch.setattr(ours, "encode_many", lambda units: handed.extend(units) or encode_many(units))
    words = [f"wo{a}{b}é" for a in "abcde" for b in "fghij"]
    ours.encode([f"{x} {x}{mark}\n{y}" for x in words for mark in ".,;:!?" for y in words])
    # Each word with and without its blank, each mark, the line feed; before, each mark with each word behind it made a unit of its own.
    assert len(handed) == len(set(handed)) <= 2 * len(words) + 6 + 1


def test_a_tokenizer_with_other_cuts_is_refused(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    for split, normalizer in [(pre_tokenizers.Whitespace(), None), (pre_tokenizers.ByteLevel(add_prefix_space=True), None), (pre_tokenizers.ByteLevel(add_prefix_space=False), normalizers.NFC())]:
        other = Tokenizer(models.BPE(vocab={"a": 0}, merges=[]))
        other.pre_tokenizer = split
        if normalizer:
            other.normalizer = normalizer
        other.save(str(tmp_path / "other.json"))
        tokens.huggingface_encoder.cache_clear()
        with pytest.raises(ValueError, match="safe cuts"):
            tokens.huggingface_encoder(str(tmp_path / "other.json"))
    tokens.huggingface_encoder.cache_clear()
