"""Requests as a table: brute force for every request, promotion by cases, as many scans for fifty requests as for one."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.operators import endpoints as E
from marquee.operators import traits as R
from marquee.plans import requests as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Q.views_of(spark, SF)


@pytest.fixture(scope="module")
def data(spark, views):
    """The views as Python rows."""
    billed = E.billing(views["credits"]).collect()
    return {k: [r.asDict() for r in v.collect()] for k, v in views.items() if k != "credits"} | {"credits": [r.asDict() for r in billed]}


def sigmoid(x, k, c):
    return 1 / (1 + math.exp(-k * (x - c)))


def score_map(call, data):
    """movie -> score of one call over the whole catalogue, rule by rule."""
    cards, out = {c["movie_id"]: c for c in data["cards"]}, {}
    route, ids = call["route"], call.get("ids", [])
    if route == "entity":
        for r in data["credits"]:
            if r["term"] in ids and call["kind"] in ("unknown", r["role"]):
                out[r["movie_id"]] = max(out.get(r["movie_id"], 0), r[f"as_{call['mode']}"] if r["role"] == "actor" else 1.0)
    elif route == "keyword":
        asked = {("keyword", i) for i in ids} | {("source", i) for i in call["sources"]} | {("tag", i) for i in call["tags"]}
        for r in data["traits"]:
            if (r["kind"], r["trait_id"]) in asked:
                out[r["movie_id"]] = out.get(r["movie_id"], 0) + 1 / len(asked)
        if not call["every"]:
            out = dict.fromkeys(out, 1.0)
    elif route == "awards":
        for r in data["awards"]:
            if (r["ceremony"] in ids if ids else r["ceremony"] != 10) and call["kind"] in ("any", "won" if r["won"] else "nominated"):
                out[r["movie_id"]] = out.get(r["movie_id"], 0) + 1
        out = {m: 1.0 if n >= call["mark"] else 0.0 if call["every"] else n / call["mark"] for m, n in out.items()}
        out = {m: s for m, s in out.items() if s}
    elif route == "franchise_structure":
        hits = {}
        for r in data["entries"]:
            if r["entry"] in ids:
                hits[r["movie_id"]] = hits.get(r["movie_id"], False) or r["lineage"]
        out = {m: 1.0 if own or not call["every"] or not any(hits.values()) else 0.75 for m, own in hits.items()}
    elif route == "media_type":
        out = {m: 1.0 for m, c in cards.items() if c["release_format"] in ids}
    elif route == "trending":
        out = {r["movie_id"]: 0.5 + 0.5 * r["score"] for r in data["trend"] if r["movie_id"] in cards and r["score"] > 0}
    elif route == "semantic":
        head = next((v for v in data["vectors"] if v["space"] == call["mark"] and v["movie_id"] == ids[0]), None)
        for v in data["vectors"] if head else ():
            if v["space"] == call["mark"]:
                out[v["movie_id"]] = min(1, max(0, sum(a * b for a, b in zip(v["vector"], head["vector"], strict=True)) / v["norm"] / head["norm"]))
        out = {m: s for m, s in out.items() if m in cards}
    elif "low" in call:
        low, high, kind = call["low"], call["high"], call["kind"]
        grace = {"maturity": 1, "runtime": 30, "released": max(365, min(0.5 * (high - low) / 86400, 1825)) * 86400}[kind]
        for m, c in cards.items():
            value = c["maturity_rank" if kind == "maturity" else kind]
            if value is not None:
                gap = max(low - value, value - high, 0)
                out[m] = (1.0 if not gap else 0.5 if gap <= 1 else 0) if kind == "maturity" else max(0, 1 - gap / grace)
        out = {m: s for m, s in out.items() if s >= 0.01}
    else:
        rule = {"popular": lambda c: sigmoid(c["popularity"], 12, 0.7), "niche": lambda c: sigmoid(c["popularity"], -12, 0.4), "acclaimed": lambda c: sigmoid(c["reception"], 0.22, 70), "poor": lambda c: sigmoid(c["reception"], -0.22, 50)}
        out = {m: rule[call["kind"]](c) for m, c in cards.items()}
    return out


def brute(request, data):
    cards = {c["movie_id"]: c for c in data["cards"]}
    low, high = request["released"]
    active = low is not None or request["runtime_to"] is not None or bool(request["genres"])

    def fits(m):
        c = cards[m]
        return (low is None or low <= c["released"] <= high) and (request["runtime_to"] is None or c["runtime"] <= request["runtime_to"]) and (not request["genres"] or bool(set(request["genres"]) & set(c["genre_ids"])))

    calls = []
    for t, (_, _, positive, categories) in enumerate(request["traits"]):
        for place, (category, made) in enumerate(categories):
            for k, call in enumerate(made):
                generates = R.generates(category, call["route"])
                calls.append({"t": t, "positive": positive, "category": category, "place": place, "k": k, "call": call, "generator": positive and generates, "gate": R.CATEGORIES[category][3] and generates, "tier": R.promotion_tier(category, call["route"]) if positive else 8, "promoted": False})
    full = {id(c): score_map(c["call"], data) for c in calls}
    tops = {}
    for c in calls:
        scores = full[id(c)]
        if c["call"]["route"] == "semantic":
            scores = {m: s for m, s in scores.items() if s > 0}
        tops[id(c)] = {m: s for m, s in scores.items() if fits(m)}
    found = lambda c: {m for m in tops[id(c)] if cards[m]["release_format"] != 3}
    pool = set().union(*[found(c) for c in calls if c["generator"]], set())
    had = any(c["generator"] for c in calls)
    tiers = sorted({c["tier"] for c in calls if not c["generator"] and c["positive"] and c["tier"] < 8})
    taken = []
    for tier in tiers:
        if (had or taken) and not (active and len(pool) < 25):
            break
        taken.append(tier)
        for c in calls:
            if not c["generator"] and c["positive"] and c["tier"] == tier:
                c["promoted"] = True
                pool |= found(c)
    if not pool and (active or not had):
        neutral = lambda m: round(0.8 * min(1, max(0, cards[m]["popularity"])) + 0.2 * min(1, max(0, cards[m]["reception"] / 100)), 6)
        pool = set(sorted((m for m in cards if fits(m) and cards[m]["release_format"] != 3), key=lambda m: (-neutral(m), -m))[:2000])
    for c in calls:
        c["generating"] = c["generator"] or c["promoted"]
    result = []
    weights = {}
    for t, (_, commitment, positive, _) in enumerate(request["traits"]):
        own = [c for c in calls if c["t"] == t]
        weights[t] = R.COMMITMENTS[commitment]
        if positive and all(c["generating"] for c in own):
            matched = set().union(*[{m for m, s in tops[id(c)].items() if not c["promoted"] or s >= 1 - 1e-6} for c in own])
            x = len(matched) / len(cards)
            weights[t] *= 1.5 if x < 0.001 else 1.2 if x < 0.01 else 1.0 if x < 0.1 else 0.75 if x < 0.3 else 0.5
    for m in pool:
        score = lambda c: (tops if c["generating"] else full)[id(c)].get(m, 0.0)  # noqa: B023, E731
        up = down = 0.0
        for t, (mode, _, positive, _) in enumerate(request["traits"]):
            own = [c for c in calls if c["t"] == t]
            if positive:
                by = defaultdict(list)
                for c in own:
                    by[c["place"], c["category"]].append(score(c))
                folded = []
                for (place, category), s in sorted(by.items()):
                    kind = R.CATEGORIES[category][1]
                    folded.append(s[0] if kind == "SINGLE" else math.prod(s) if kind == "ADDITIVE" else max(s) if kind == "ALTERNATIVES" else math.prod(max(x, 0.1) for x in s) ** (1 / len(s)))
                value = folded[0] if mode == "SOLO" else max(folded) if mode == "FRAMINGS" else math.prod(max(x, 0.1) for x in folded) ** (1 / len(folded))
                up += weights[t] * value
            else:
                gates, fuzzies = [score(c) for c in own if c["gate"]], [score(c) for c in own if not c["gate"]]
                down += weights[t] * (math.prod(gates) * (1 - math.prod(1 - x for x in fuzzies) if fuzzies else 1.0))
        c = cards[m]
        lift = R.POPULARITY_CAPS[request["popularity"]] * sigmoid(c["popularity"], 12, 0.7) if request["popularity"] != "off" else R.QUALITY_CAPS[request["quality"]] * sigmoid(c["reception"], 0.22, 70)
        result.append((m, round(up, 6), round(-down, 6), round(up - down + (up if up > 0 else 1.0) * lift, 6)))
    return sorted(result, key=lambda r: (-r[3], r[0]))


def run(spark, views, requests, top=100):
    return Q.run_requests(*Q.spec_tables(spark, requests), R.category_rows(spark), views, top)


@pytest.fixture(scope="module")
def batch(spark, views):
    got = defaultdict(list)
    for r in run(spark, views, Q.REQUESTS, 10_000).collect():
        got[r.request].append((r["rank"], r.movie_id, r.positive, r.negative, r.score))
    return {k: [x[1:] for x in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("k", range(len(Q.REQUESTS)))
def test_each_request_equals_brute_force(batch, data, k):
    want = brute(Q.REQUESTS[k], data)
    got = batch.get(k, [])
    assert len(got) == len(want) and [r[0] for r in sorted(got)] == [r[0] for r in sorted(want)]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[1:] == pytest.approx(b[1:], abs=2e-6), a[0]


def test_a_request_alone_is_the_same(spark, views, batch):
    got = [tuple(r)[1:] for r in run(spark, views, [Q.REQUESTS[3]], 10_000).select("rank", "rank", "movie_id", "positive", "negative", "score").orderBy("rank").collect()]
    assert [g[1:] for g in got] == batch[3]


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_fifty_requests_scan_what_one_does(spark, views):
    one = Q.planned(Q.spec_tables(spark, Q.REQUESTS[:1])[0], R.category_rows(spark))
    fifty = Q.planned(Q.spec_tables(spark, Q.REQUESTS * 5)[0], R.category_rows(spark))
    assert scans(Q.generated(one, views)) == scans(Q.generated(fifty, views)) > 0
    got = run(spark, views, Q.REQUESTS * 5, 3)
    assert got.select("request").distinct().count() >= 40
    mine = lambda lo: sorted(tuple(r)[1:] for r in got.where((F.col("request") >= lo) & (F.col("request") < lo + 10)).select("request", (F.col("request") % 10).alias("k"), "rank", "movie_id", "score").collect())
    assert mine(0) == mine(40)


def taken(spark, calls, found, active):
    rows = [(i, 0, g, p, t) for i, (g, p, t) in enumerate(calls)]
    plan = spark.createDataFrame(rows, "call_id int, request int, generator boolean, positive boolean, tier int")
    hits = spark.createDataFrame([(0, t, m) for t, ms in found.items() for m in ms], "request int, tier int, movie_id long")
    return sorted(r.tier for r in Q.tiers_taken(plan, hits, spark.createDataFrame([(0, active)], "request int, active boolean")).collect())


def test_promotion_by_cases(spark):
    many = range(30)
    only = [(False, True, 4), (False, True, 1), (False, True, 1)]
    assert taken(spark, only, {1: [1], 4: [2]}, False) == [1]  # rerankers only: the lowest tier alone
    assert taken(spark, only, {1: [1], 4: [2]}, True) == [1, 4]  # under a filter the next ones, too
    assert taken(spark, only, {1: many, 4: [2]}, True) == [1]
    assert taken(spark, [(True, True, 8), (False, True, 2)], {0: [1]}, False) == [0]
    assert taken(spark, [(True, True, 8), (False, True, 2), (False, True, 5)], {0: [1], 2: many, 5: [3]}, True) == [0, 2]
    assert taken(spark, [(True, True, 8), (False, True, 2), (False, True, 5)], {0: [1], 2: range(24), 5: [3]}, True) == [0, 2, 5]
    assert taken(spark, [(False, False, 8), (False, True, 3)], {3: [1]}, False) == [3]  # a negative call is never promoted
    assert taken(spark, [(False, False, 8), (False, True, 8)], {}, True) == []


def test_requests_of_nothing(spark, views):
    none = Q.run_requests(spark.createDataFrame([], Q.CALL), spark.createDataFrame([], Q.TRAIT), spark.createDataFrame([], Q.REQUEST), R.category_rows(spark), views)
    assert none.count() == 0
