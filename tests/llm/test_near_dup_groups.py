"""Near duplicates in groups whose similarities lie about the limit: results, growth and sketch estimates."""

import random

import numpy as np
import pytest
from test_operators import brute_components

from marquee.llm import near_dup


def straddling(n, seed=7, words=150, most=24):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(most // 2, most)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 9999)}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize(("block", "nearest"), [(4096, True), (16, True), (4096, False), (16, False)])
def test_straddling_group_equals_brute_force(spark, monkeypatch, block, nearest):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    if not nearest:  # all is left to the meetings with texts
        pairs = near_dup.nearest_pairs
        monkeypatch.setattr(near_dup, "nearest_pairs", lambda *a: pairs(*a).where("false"))
    rows = straddling(150)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2, 80)


def test_emitted_pairs_grow_with_the_group(spark, monkeypatch):
    made = {}

    def counting(df, name, _write=near_dup.materialise):
        out = _write(df, name)
        if name in ("pairs", "links"):
            made[size] = made.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "materialise", counting)
    for size in (200, 400):
        near_dup.near_duplicates(spark.createDataFrame(straddling(size), "doc_id long, text string"), 2).count()
    assert made[400] <= 2.4 * made[200] + 50


def test_sketch_estimates_keep_true_links():
    rng = np.random.default_rng(5)
    for n in (50, 400, 1024, 3000, 20_000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(len(x) / 9)  # what stays is just over 80 per cent of the union
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[gone:]], rng.integers(0, 2**63, gone - 1, dtype=np.uint64) * np.uint64(2)]))
            assert near_dup.linked(x, y, 80)
            level = max(near_dup.level_of(len(x)), near_dup.level_of(len(y)))
            far = int(np.bitwise_count(near_dup.odd_sketch(x, level) ^ near_dup.odd_sketch(y, level)).sum())
            assert far <= near_dup.most_differing(len(x) + len(y), level, 80)
            z = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            assert int(np.bitwise_count(near_dup.odd_sketch(x, level) ^ near_dup.odd_sketch(z, level)).sum()) > near_dup.most_differing(len(x) + len(z), level, 80)
