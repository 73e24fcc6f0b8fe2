"""The label model against its definition, and the verdict against the base rules and the quality labels."""

import math

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import queries, weak_rules

SF = "/root/testdata/sf0.01"


def planted(n=20_000):
    rng = np.random.default_rng(2)
    good = rng.random(n) < 0.7
    rates = {True: [[0.02, 0.08, 0.9], [0.05, 0.25, 0.7], [0.1, 0.1, 0.8], [0.01, 0.5, 0.49]], False: [[0.7, 0.2, 0.1], [0.6, 0.1, 0.3], [0.5, 0.3, 0.2], [0.4, 0.3, 0.3]]}
    votes = np.array([[rng.choice([-1, 0, 1], p=p) for p in rates[bool(g)]] for g in good])
    return good, votes, rates


def test_em_finds_planted_rates():
    good, votes, rates = planted(6000)
    model = weak_rules.fit_label_model(votes, np.ones(len(votes)))
    assert abs(model.balance - good.mean()) < 0.03
    assert np.abs(model.good - rates[True]).max() < 0.05 and np.abs(model.bad - rates[False]).max() < 0.07
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.9


def test_em_equals_brute_force():
    _, votes, _ = planted(300)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.fit_label_model(patterns, counts.astype(float), steps=7)
    p = [0.1 if -1 in v else 0.95 for v in votes.tolist()]
    for _ in range(7):
        balance = (sum(p) + weak_rules.BALANCE[0]) / (len(p) + sum(weak_rules.BALANCE))
        rate = {}
        for cls, prior in ((1, weak_rules.GOOD_VOTES), (0, weak_rules.BAD_VOTES)):
            for j in range(votes.shape[1]):
                mass = [sum((q if cls else 1 - q) for q, v in zip(p, votes[:, j], strict=True) if v == o) + w for o, w in zip((-1, 0, 1), prior, strict=True)]
                rate[cls, j] = [m / sum(mass) for m in mass]
        p = []
        for v in votes.tolist():
            odds = math.log(balance / (1 - balance)) + sum(math.log(rate[1, j][x + 1] / rate[0, j][x + 1]) for j, x in enumerate(v))
            p.append(1 / (1 + math.exp(-odds)))
    assert np.allclose(model.posterior(votes), p, atol=1e-9)


def test_verdict_decides_beyond_the_base_rules(spark):
    got = queries.op9_weak_rules(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    seen = got.join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in seen}
    assert kept[0] < 0.1 and kept[1] > 0.97
    assert got.where("NOT base_failed AND NOT kept").count() > 0 and got.where("base_failed AND kept").count() == 0


def test_judge_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (None, "x " * 40), (5, "# " * 200), (5, "# " * 200)]
    measures = weak_rules.measure(spark.createDataFrame(rows, "doc_id long, text string"))
    got = weak_rules.judge(measures).collect()
    assert len(got) == len(rows) and all(0 <= r.posterior <= 1 and r.verdict is not None for r in got)
    assert weak_rules.judge(measures.limit(0)).count() == 0
