"""Names to ids: people and characters by name, a dictionary of strings with lasting ids, and a trigram index of titles.

All lookups take a table of phrases (place, phrase) and return ids by joins, so any number of phrases is resolved in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import catalogue as C
from ..sources import store
from ..sources.store import stored
from . import endpoints as E

# Fixed value: strings that a phrase may resolve to by its characters alone, the shortest first.
SUBSTRING_LIMIT = 20

#: First names by the key modulo their number, so that the tables hold accents, hyphens, apostrophes and other scripts.
GIVEN = ("Zoë", "Jean-Luc", "O'Hara", "ÅSA", "Mary Ann", "J. R.", "François-Xavier", "李 Wei")
STYLES = ("Dr.", "The Spider-", "Señor", "Lady", "Captain")


@stored("people", "supplier", "nation")
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, name, norm): every person with the lookup form of their name."""
    given = F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (F.col("s_suppkey") % len(GIVEN) + 1).cast("int"))
    nations = C.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    name = F.concat(given, F.lit(" "), F.initcap("n_name"), F.lit(" "), F.col("s_suppkey").cast("string"))
    d = C.table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("term"), name.alias("name"))
    return d.withColumn("norm", T.normalize(F.col("name")))


@stored("characters", "customer")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, name, norm): every character with the lookup form of its name."""
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.col("c_custkey") % len(STYLES) + 1).cast("int"))
    d = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("term"), F.concat(style, F.lit(" "), F.initcap("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("name"))
    return d.withColumn("norm", T.normalize(F.col("name")))


@stored("character_postings", "lineitem", "orders")
def character_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, movie_id, position, cast_size) of characters: who ordered an item plays in it."""
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("term"))
    rows = C.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("movie_id"), F.col("l_linenumber").alias("position")).join(orders, "l_orderkey")
    best = rows.groupBy("term", "movie_id").agg(F.min("position").alias("position"))
    return best.join(rows.groupBy("movie_id").agg(F.max("position").alias("cast_size")), "movie_id")


@stored("name_strings", "supplier", "nation", "customer", "part")
def name_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, term, norm): the lookup form of every person, character and company and its variants without hyphens."""
    companies = C.table(spark, sf_dir, "part").select("p_brand").distinct().select(F.lit("company").alias("kind"), F.xxhash64("p_brand").alias("term"), T.normalize(F.col("p_brand")).alias("norm"))
    named = [d.select(F.lit(k).alias("kind"), "term", "norm") for k, d in (("person", people(spark, sf_dir)), ("character", characters(spark, sf_dir)))]
    every = named[0].unionByName(named[1]).unionByName(companies)
    return every.select("kind", "term", F.explode(T.hyphen_variants(F.col("norm"))).alias("norm")).distinct()


def with_new_strings(old: DataFrame | None, norms: DataFrame) -> DataFrame:
    """A dictionary (string_id, norm) with the strings it lacks: known ones keep their ids, new ones go on from the greatest, in their order."""
    found = norms.select("norm").where("norm IS NOT NULL AND norm <> ''").distinct()
    if old is None:
        return store.numbered(found, "norm", "string_id").select("string_id", "norm")
    greatest = old.agg(F.coalesce(F.max("string_id"), F.lit(0)).alias("_last"))
    new = store.numbered(found.join(old, "norm", "left_anti"), "norm", "string_id").crossJoin(F.broadcast(greatest))
    return old.select("string_id", "norm").unionByName(new.select((F.col("string_id") + F.col("_last")).alias("string_id"), "norm"))


@stored("dictionary", "supplier", "nation", "customer", "part")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(string_id, norm): ids last over refreshes."""
    return with_new_strings(store.previous(spark, sf_dir, "dictionary"), name_strings(spark, sf_dir))


def lookup_forms(phrases: DataFrame) -> DataFrame:
    """(place, norm): the distinct lookup forms of phrases, hyphen variants included; empty ones are left out."""
    return phrases.select("place", F.explode(T.hyphen_variants(T.normalize(F.col("phrase")))).alias("norm")).distinct()


def resolve(phrases: DataFrame, strings: DataFrame, kind: str) -> DataFrame:
    """(place, term): entities of a kind one of whose forms equals a form of the phrase. Unknown phrases have no row."""
    return lookup_forms(phrases).join(strings.where(F.col("kind") == kind).select("norm", "term"), "norm").select("place", "term").distinct()


def resolve_by_words(phrases: DataFrame, strings: DataFrame, kind: str) -> DataFrame:
    """(place, term): entities whose name holds every word of the phrase (a division): words meet words, and all must be met."""
    wanted = phrases.select("place", F.explode(T.tokens(T.normalize(F.col("phrase")))).alias("word")).distinct()
    asked = wanted.groupBy("place").agg(F.count(F.lit(1)).alias("asked"))
    held = strings.where(F.col("kind") == kind).select("term", F.explode(T.tokens(F.col("norm"))).alias("word")).distinct()
    met = held.join(wanted, "word").groupBy("place", "term").agg(F.count(F.lit(1)).alias("met"))
    return met.join(asked, "place").where("met = asked").select("place", "term")


def resolve_by_substring(phrases: DataFrame, strings: DataFrame, kind: str, limit: int | None = SUBSTRING_LIMIT) -> DataFrame:
    """(place, term): names that hold the phrase anywhere, the shortest `limit` of each phrase (all for None).

    Phrases of three characters or more meet names by a trigram first; shorter ones meet names by their characters.
    """
    asked = phrases.select("place", T.normalize(F.col("phrase")).alias("part")).where("part <> ''")
    names = strings.where(F.col("kind") == kind).select("term", "norm").withColumn("size", F.char_length("norm"))
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))
    parts = []
    for n, fits in ((3, F.char_length("part") >= 3), (1, F.char_length("part") < 3)):
        own = asked.where(fits).withColumn("piece", F.substr(F.col("part"), F.lit(1), F.lit(n)))
        rows = names.withColumn("piece", F.explode(pieces(F.col("norm"), n)))
        parts.append(rows.join(own, "piece").where(F.contains("norm", F.col("part"))).select("place", "term", "norm", "size"))
    found = parts[0].unionByName(parts[1]).distinct()
    if limit is None:
        return found.select("place", "term").distinct()
    shortest = Window.partitionBy("place").orderBy("size", "norm", "term")
    return found.withColumn("_r", F.row_number().over(shortest)).where(F.col("_r") <= limit).select("place", "term").distinct()


def phrase_table(spark: SparkSession, phrases: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(phrases)), "place int, phrase string")


# Titles by their trigrams.


@stored("title_trigrams", "part", "lineitem", "supplier")
def title_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gram, normal): distinct trigrams of the words of every distinct title."""
    grams = F.array_distinct(F.flatten(F.transform(F.filter(F.split("normal", " "), lambda w: w != ""), T.trigrams)))
    return C.cards(spark, sf_dir).select("normal").distinct().select(F.explode(grams).alias("gram"), "normal")


@stored("trigram_counts", "part", "lineitem", "supplier")
def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gram, titles): how many titles hold a trigram."""
    return title_trigrams(spark, sf_dir).groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))


def query_grams(queries: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(place, gram, asked, needed, rare): the trigrams of normal queries (place, normal), rarest first.

    A title of likeness `least` holds `needed` of the `asked` trigrams, so it holds one of the asked - needed + 1 rarest, which are marked.
    """
    grams = F.array_distinct(F.flatten(F.transform(F.filter(F.split("normal", " "), lambda w: w != ""), T.trigrams)))
    rows = queries.select("place", F.size(grams).alias("asked"), F.explode(grams).alias("gram"))
    order = Window.partitionBy("place").orderBy(F.coalesce("titles", F.lit(0)), "gram")
    ranked = rows.join(counts, "gram", "left").withColumn("_r", F.row_number().over(order))
    needed = F.greatest(F.lit(1), F.ceil(F.col("asked") * least - 1e-9))
    return ranked.withColumn("needed", needed).withColumn("rare", F.col("_r") <= F.col("asked") - F.col("needed") + 1).select("place", "gram", "asked", "needed", "rare")


def similar_titles(queries: DataFrame, grams: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(place, normal, likeness) of the titles that share at least `least` of a query's trigrams; only candidates are counted."""
    asked = F.broadcast(query_grams(queries, counts, least))
    candidates = grams.join(asked.where("rare"), "gram").select("place", "normal").distinct()
    met = grams.join(asked, "gram").join(candidates, ["place", "normal"], "left_semi").groupBy("place", "normal", "asked", "needed").agg(F.count(F.lit(1)).alias("met"))
    return met.where("met >= needed").select("place", "normal", (F.col("met") / F.col("asked")).alias("likeness"))


def candidate_counts(queries: DataFrame, grams: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(place, candidates, titles): how many titles the index hands on for each query, of how many."""
    asked = query_grams(queries, counts, least).where("rare")
    total = grams.agg(F.countDistinct("normal").alias("titles"))
    return grams.join(F.broadcast(asked), "gram").groupBy("place").agg(F.countDistinct("normal").alias("candidates")).crossJoin(F.broadcast(total))


# Registered queries.

PEOPLE = ["zoe 8", "Jean Luc 1", "jean-luc 9", "o'hara  2", "Åsa 3", "françois xavier 14", "李 15", "nobody at all"]
CHARACTERS = ["dr. building 5", "Señor", "spider automobile", "the spider- building 1"]


def lexical_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir)


def resolve_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by names as users write them: accents, hyphens, case and apostrophes do not matter. All names of the table, each asked by its own form."""
    written_forms = people(spark, sf_dir).select(F.col("term").cast("int").alias("place"), F.upper("name").alias("phrase"))
    return resolve(written_forms, name_strings(spark, sf_dir), "person")


def resolve_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that hold all words of a phrase, and those that hold the phrase anywhere."""
    phrases, strings = phrase_table(spark, CHARACTERS), name_strings(spark, sf_dir)
    by_words = resolve_by_words(phrases, strings, "character").withColumn("way", F.lit("words"))
    return by_words.unionByName(resolve_by_substring(phrases, strings, "character").withColumn("way", F.lit("substring")))


def entity_named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of people given by name: the best prominence over the people that the phrases resolve to; other roles count 1."""
    phrases = phrase_table(spark, PEOPLE)
    terms = resolve(phrases, name_strings(spark, sf_dir), "person").unionByName(resolve_by_words(phrases, name_strings(spark, sf_dir), "person")).select("term").distinct()
    rows = E.billing(C.credits(spark, sf_dir).join(terms, "term"))
    return rows.groupBy("movie_id").agg(C.r6(F.max(F.when(F.col("role") == "actor", F.col("as_default")).otherwise(1.0))).alias("score"))


def entity_named_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of characters given by name, each with its best prominence of any of them."""
    terms = resolve_by_words(phrase_table(spark, CHARACTERS), name_strings(spark, sf_dir), "character").select("term").distinct()
    score = 1 - (F.col("position") - 1) / F.greatest(F.lit(1), F.col("cast_size") - 1)
    return character_postings(spark, sf_dir).join(terms, "term").groupBy("movie_id").agg(C.r6(F.max(score)).alias("score"))


FUZZY = ["bollt", "larg brss", "economy anodised nickel", "bras"]


def title_fuzzy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles alike to several misspelt queries, through the trigram index."""
    queries = phrase_table(spark, FUZZY).select("place", F.col("phrase").alias("normal"))
    found = similar_titles(queries, title_trigrams(spark, sf_dir), trigram_counts(spark, sf_dir), 0.45)
    return found.select("place", "normal", C.r6(F.col("likeness")).alias("likeness"))


TITLE_PATTERNS = [("contains", "bolt"), ("starts_with", "large"), ("contains", "100%"), ("starts_with", "")]


def title_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, movie_id) of titles that begin with or hold a pattern, taken literally; an empty pattern finds nothing."""
    asked = spark.createDataFrame([(i, how, T.fold_text(p)) for i, (how, p) in enumerate(TITLE_PATTERNS)], "place int, how string, part string").where("part <> ''")
    pieces = F.transform(F.sequence(F.lit(1), F.char_length("normal")), lambda i: F.substr(F.col("normal"), i, F.lit(1)))
    cards = C.cards(spark, sf_dir).where("normal <> ''").select("movie_id", "normal", F.explode(F.array_distinct(pieces)).alias("piece"))
    met = cards.join(F.broadcast(asked.withColumn("piece", F.substr(F.col("part"), F.lit(1), F.lit(1)))), "piece")
    return met.where(F.when(F.col("how") == "starts_with", F.startswith("normal", "part")).otherwise(F.contains("normal", "part"))).select("place", "movie_id")


def _pick(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


#: The lookup form in SQL: marks and case go, full stops and apostrophes vanish, other signs but hyphens become blanks.
_FOLD = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(nfc_normalize({c}))), '[''ʼ`.]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CAP = lambda c: f"(upper({c}[1]) || lower({c}[2:]))"
_NAMES = f"""
people AS (
  SELECT s_suppkey AS term, {_pick(GIVEN, "s_suppkey")} || ' ' || array_to_string([{_CAP("w")} FOR w IN string_split(n_name, ' ')], ' ') || ' ' || s_suppkey AS name
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
characters AS (SELECT c_custkey AS term, {_pick(STYLES, "c_custkey")} || ' ' || {_CAP("c_mktsegment")} || ' ' || c_custkey AS name FROM customer),
norms AS (
  SELECT 'person' AS kind, term, {_FOLD("name")} AS norm FROM people UNION ALL SELECT 'character', term, {_FOLD("name")} FROM characters
  UNION ALL SELECT DISTINCT 'company', NULL, {_FOLD("p_brand")} FROM part),
strings AS (SELECT DISTINCT kind, term, unnest([norm, trim(regexp_replace(replace(norm, '-', ' '), '\\s+', ' ', 'g')), replace(norm, '-', '')]) AS norm FROM norms)"""
_ASKED = lambda phrases: "asked(place, phrase) AS (VALUES " + ", ".join(f"({i}, '" + p.replace("'", "''") + "')" for i, p in enumerate(phrases)) + ")"
#: Words of a lookup form; a hyphenated word is there as it is and by its parts.
_WORDS = lambda c: f"list_filter(list_distinct(string_split({c}, ' ') || string_split(replace({c}, '-', ' '), ' ')), lambda x: x <> '')"
_DIVIDED = f"SELECT DISTINCT place, term FROM asked JOIN strings ON list_has_all({_WORDS('norm')}, {_WORDS(_FOLD('phrase'))})"
_CHARACTER_POSTINGS = """
character_postings AS (
  SELECT o_custkey AS term, l_partkey AS movie_id, min(l_linenumber) AS position, any_value(size) AS cast_size
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT l_partkey AS k, max(l_linenumber) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) ON k = l_partkey GROUP BY 1, 2)"""
_TRIGRAMS = lambda t: f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_filter(string_split({t}, ' '), lambda x: x <> '')]))"
_PERSON_TERMS = f"""
forms AS (SELECT DISTINCT place, unnest([f, trim(regexp_replace(replace(f, '-', ' '), '\\s+', ' ', 'g')), replace(f, '-', '')]) AS norm FROM (SELECT place, {_FOLD("phrase")} AS f FROM asked)),
terms AS (SELECT term FROM forms JOIN strings USING (norm) WHERE kind = 'person' UNION SELECT term FROM ({_DIVIDED} WHERE kind = 'person'))"""
QUERIES = {
    "lexical_dictionary": (lexical_dictionary, f"WITH{_NAMES} SELECT row_number() OVER (ORDER BY norm) AS string_id, norm FROM (SELECT DISTINCT norm FROM strings WHERE norm <> '')"),
    "resolve_people": (
        resolve_people,
        f"""WITH{_NAMES}, asked AS (SELECT term::INT AS place, {_FOLD("upper(name)")} AS f FROM people),
        forms AS (SELECT DISTINCT place, unnest([f, trim(regexp_replace(replace(f, '-', ' '), '\\s+', ' ', 'g')), replace(f, '-', '')]) AS norm FROM asked)
        SELECT DISTINCT place, term FROM forms JOIN strings USING (norm) WHERE kind = 'person'""",
    ),
    "resolve_characters": (
        resolve_characters,
        f"""WITH{_NAMES}, {_ASKED(CHARACTERS)}
        SELECT place, term, 'words' AS way FROM ({_DIVIDED} WHERE kind = 'character')
        UNION ALL SELECT DISTINCT place, term, 'substring' FROM (
          SELECT place, term FROM asked JOIN strings ON contains(norm, {_FOLD("phrase")}) WHERE kind = 'character'
          QUALIFY row_number() OVER (PARTITION BY place ORDER BY length(norm), norm, term) <= {SUBSTRING_LIMIT})""",
    ),
    "entity_named_people": (
        entity_named_people,
        f"""WITH{E._ZONES},{_NAMES}, {_ASKED(PEOPLE)},{_PERSON_TERMS},
        a AS (SELECT movie_id, {E._curve_sql("default")} AS score FROM zones JOIN terms USING (term) GROUP BY 1
          UNION ALL SELECT DISTINCT l_partkey, 1.0::DOUBLE FROM lineitem JOIN terms ON term = l_suppkey WHERE l_linenumber BETWEEN 1 AND 4)
        SELECT movie_id, round(max(score), 6) AS score FROM a GROUP BY 1""",
    ),
    "entity_named_characters": (
        entity_named_characters,
        f"""WITH{_NAMES}, {_ASKED(CHARACTERS)},{_CHARACTER_POSTINGS}, terms AS (SELECT DISTINCT term FROM ({_DIVIDED} WHERE kind = 'character'))
        SELECT movie_id, round(max(1 - (position - 1)::DOUBLE / greatest(1, cast_size - 1)), 6) AS score FROM character_postings JOIN terms USING (term) GROUP BY 1""",
    ),
    "title_fuzzy_all": (
        title_fuzzy_all,
        f"""WITH{C.CARDS}, {_ASKED(FUZZY)}, t AS (SELECT DISTINCT trim(lower(title)) AS normal FROM cards),
        l AS (SELECT place, normal, len(list_intersect({_TRIGRAMS("phrase")}, {_TRIGRAMS("normal")}))::DOUBLE / len({_TRIGRAMS("phrase")}) AS likeness FROM asked, t)
        SELECT place, normal, round(likeness, 6) AS likeness FROM l WHERE likeness >= 0.45""",
    ),
    "title_patterns": (
        title_patterns,
        f"""WITH{C.CARDS}, t AS (SELECT movie_id, trim(lower(title)) AS normal FROM cards)
        SELECT 0 AS place, movie_id FROM t WHERE contains(normal, 'bolt') UNION ALL SELECT 1, movie_id FROM t WHERE starts_with(normal, 'large') UNION ALL SELECT 2, movie_id FROM t WHERE contains(normal, '100')""",
    ),
}
