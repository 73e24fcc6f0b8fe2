"""Names to ids, substrings, and the trigram index against full scans."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.operators import names as N

SF = "/root/testdata/sf0.01"
NAMES = ["Zoë Saldaña", "Jean-Luc Picard", "Jean Luc Picard", "O'Hara", "Dr. No", "Spider-Man", "The Spider", "李小龍", "STRASSE", "Anne-Marie  d’Arc"]


def strings(spark, names=NAMES):
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "term long, name string")
    return d.select(F.lit("person").alias("kind"), "term", F.explode(T.hyphen_variants(T.normalize(F.col("name")))).alias("norm")).distinct()


def test_names_resolve_whatever_their_spelling(spark):
    asked = ["zoe saldana", "ZOË  SALDAÑA", "jean luc picard", "jeanluc picard", "Jean-Luc Picard", "ohara", "dr no", "Straße", "李小龍", "", "...", "Anne Marie d Arc", "unknown"]
    got = {}
    for r in N.resolve(N.phrase_table(spark, asked), strings(spark), "person").collect():
        got.setdefault(asked[r.place], set()).add(r.term)
    assert got == {"zoe saldana": {0}, "ZOË  SALDAÑA": {0}, "jean luc picard": {1, 2}, "jeanluc picard": {1}, "Jean-Luc Picard": {1, 2}, "ohara": {3}, "dr no": {4}, "Straße": {8}, "李小龍": {7}, "Anne Marie d Arc": {9}}
    assert N.resolve(N.phrase_table(spark, asked), strings(spark), "character").count() == 0


def test_division_wants_every_word(spark):
    asked = ["spider", "man spider", "picard jean", "zoe picard", ""]
    got = {(asked[r.place], r.term) for r in N.resolve_by_words(N.phrase_table(spark, asked), strings(spark), "person").collect()}
    assert got == {("spider", 5), ("spider", 6), ("man spider", 5), ("picard jean", 1), ("picard jean", 2)}


@pytest.mark.parametrize("limit", [1, 2, None])
def test_substrings_equal_a_scan(spark, limit):
    rng = random.Random(2)
    names = NAMES + ["".join(rng.choice("ab%_ ") for _ in range(rng.randint(1, 12))) + str(i) for i in range(60)]
    asked = ["a", "ab", "ab%", "a_b", "spider", "ean", "b a", "zz", "龍", ""]
    table = strings(spark, names)
    held = [(r.term, r.norm) for r in table.collect()]
    want = set()
    for i, phrase in enumerate(asked):
        part = T.fold_text(phrase)
        hits = sorted((len(n), n, t) for t, n in held if part and part in n)
        want |= {(i, t) for _, _, t in (hits if limit is None else hits[:limit])}
    assert {tuple(r) for r in N.resolve_by_substring(N.phrase_table(spark, asked), table, "person", limit).collect()} == want


def grams(text):
    return {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.45, 0.8, 1.0])
def test_the_index_finds_what_a_scan_finds(spark, least):
    rng = random.Random(7)
    words = ["bolt", "bolts", "large", "larger", "brass", "polished", "steel", "e", "ab", "économie", "anodised"]
    titles = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)})
    queries = ["bollt", "larg brass", "e", "polshed stel", "xyz", "economie"]
    d = spark.createDataFrame([(t,) for t in titles], "normal string")
    index = d.select(F.explode(F.array_distinct(F.flatten(F.transform(F.filter(F.split("normal", " "), lambda w: w != ""), T.trigrams)))).alias("gram"), "normal")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    asked = N.phrase_table(spark, queries).select("place", F.col("phrase").alias("normal"))
    got = {(r.place, r.normal, round(r.likeness, 9)) for r in N.similar_titles(asked, index, counts, least).collect()}
    want = {(i, t, round(len(grams(q) & grams(t)) / len(grams(q)), 9)) for i, q in enumerate(queries) for t in titles if len(grams(q) & grams(t)) >= least * len(grams(q)) - 1e-9 and grams(q) & grams(t)}
    assert got == want


def test_the_index_hands_on_few_titles(spark):
    queries = spark.createDataFrame([(0, "economy anodised nickel"), (1, "larg brss"), (2, "bollt")], "place int, normal string")
    found = N.candidate_counts(queries, N.title_trigrams(spark, SF), N.trigram_counts(spark, SF), 0.45).collect()
    print([(r.place, r.candidates, r.titles) for r in found])
    assert found and all(r.candidates < r.titles for r in found)


@pytest.mark.parametrize("query", ["bollt", "larg ring", "zzz", "bolt", "economy anodised"])
def test_the_title_flow_is_the_same_with_and_without_the_index(spark, query):
    from marquee.plans import search
    from marquee.sources import catalogue as C

    cards = C.cards(spark, SF)
    index = (N.title_trigrams(spark, SF), N.trigram_counts(spark, SF))
    assert search.title_search(cards, query, index=index).collect() == search.title_search(cards, query).collect()
