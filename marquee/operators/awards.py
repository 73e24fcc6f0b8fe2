"""Awards by category tags of three levels, prize names, ceremonies, outcomes and years: many searches in one job, with a fast path.

A search counts an item's award rows that pass all its filters. A search for any win alone (one is enough, no other filter) needs no
row: the wins on the card say it. Category tags form a closure: a leaf implies its middle tag and its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..sources import catalogue as C
from ..sources.store import stored
from . import endpoints as E

# Where the levels of tags begin, what a shared tag of each level weighs, and how far cohesion on that level counts.
MIDDLE_FROM, GROUP_FROM = 100, 10_000
TIER_WEIGHT = (1.00, 0.50, 0.20)
SPECIFICITY = (1.0, 0.6, 0.3)
#: Leaves of the test catalogue: twelve of all ceremonies but one, and three that only ceremony E.RAZZIE gives.
LEAVES, RAZZIE_LEAF, RAZZIE_LEAVES = 12, 60, 3
RAZZIE_MIDDLE, RAZZIE_GROUP = 150, 10_005

SEARCH = "search int, ceremonies array<int>, names array<string>, tags array<int>, outcome string, year_from int, year_to int, threshold boolean, mark int"


def tag_level(tag: Column) -> Column:
    return F.when(tag >= GROUP_FROM, 2).when(tag >= MIDDLE_FROM, 1).otherwise(0)


def tags_of(leaf: Column) -> Column:
    """A leaf and what it implies: its middle tag and its group."""
    middle = F.when(leaf >= RAZZIE_LEAF, RAZZIE_MIDDLE).otherwise(MIDDLE_FROM + F.floor((leaf - 1) / 2))
    group = F.when(leaf >= RAZZIE_LEAF, RAZZIE_GROUP).otherwise(GROUP_FROM + F.floor((leaf - 1) / 4))
    return F.array(leaf.cast("int"), middle.cast("int"), group.cast("int"))


@stored("award_rows", "lineitem", "supplier")
def award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (movie_id, ceremony, entry_id, leaf, tags, won, year): the prize, the category with what it implies, and the outcome."""
    ceremony = (F.col("x.entry_id") % 12 + 1).cast("int").alias("ceremony")
    return C.rows_of_lines(C.item_lines(spark, sf_dir), F.transform("lines", _award_row)).select("movie_id", ceremony, "x.entry_id", "x.leaf", "x.won", "x.year", tags_of(F.col("x.leaf")).alias("tags"))


def _award_row(x: Column) -> Column:
    return F.struct(x["term"].alias("entry_id"), _leaf(x).alias("leaf"), x["won_high"].alias("won"), F.year(x["day"]).alias("year"))


def _leaf(x: Column) -> Column:
    """The category of a line."""
    return F.when(x["term"] % 12 + 1 == E.RAZZIE, RAZZIE_LEAF + x["line"] % RAZZIE_LEAVES).otherwise((x["term"] + x["line"]) % LEAVES + 1).cast("int")


@stored("award_entries", "supplier")
def award_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, name, tokens): prizes by name; tokens as they are indexed, without any stop list."""
    d = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entry_id"), F.concat(F.lit("Best Film Award - "), "s_name").alias("name"))
    return d.withColumn("tokens", T.name_tokens(T.number_words(T.normalize(F.col("name")))))


@stored("award_tags", "lineitem", "supplier")
def award_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (movie_id, tag) over all levels."""
    tags = F.array_distinct(F.flatten(F.transform(C.of_lines(_leaf), tags_of)))
    return C.item_lines(spark, sf_dir).select("movie_id", F.explode(tags).alias("tag"))


def tag_idf(tags: DataFrame, items: DataFrame) -> DataFrame:
    """(tag, level, df, idf): ln(N / df) / ln N of every tag; a tag of a higher level counts the items of all below it once."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    counted = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("tag", tag_level(F.col("tag")).alias("level"), "df", (F.log(F.col("total") / F.col("df")) / F.log("total")).alias("idf"))


def entries_named(searches: DataFrame, entries: DataFrame) -> DataFrame:
    """(search, entries): prizes one of whose names in the search has all its words in theirs; no row for a search that names none or finds none."""
    names = searches.select("search", F.explode("names").alias("name")).distinct()
    words = names.withColumn("tokens", T.name_tokens(T.number_words(T.normalize(F.col("name"))), T.AWARD_QUERY_STOPLIST))
    wanted = words.select("search", "name", F.size("tokens").alias("wanted"), F.explode("tokens").alias("token"))
    held = entries.select("entry_id", F.explode("tokens").alias("token"))
    met = held.join(wanted, "token").groupBy("search", "name", "wanted", "entry_id").agg(F.count(F.lit(1)).alias("met")).where("met = wanted")
    return met.groupBy("search").agg(F.collect_set("entry_id").alias("entries"))


def is_fast() -> Column:
    """Whether a search asks for any win and nothing else."""
    unbound = (F.size("ceremonies") == 0) & (F.size("names") == 0) & (F.size("tags") == 0) & F.col("year_from").isNull() & F.col("year_to").isNull()
    return unbound & (F.col("outcome") == "won") & ~F.col("threshold") & (F.col("mark") == 1)


def counted_scores(searches: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(search, movie_id, score) by counting rows. Ceremony E.RAZZIE counts only if it or one of its tags is named; a search whose names find no prize finds nothing."""
    razzie = F.exists("tags", lambda t: t.between(RAZZIE_LEAF, RAZZIE_LEAF + RAZZIE_LEAVES - 1) | t.isin(RAZZIE_MIDDLE, RAZZIE_GROUP))
    every = F.sequence(F.lit(1), F.lit(12))
    allowed = F.when(F.size("ceremonies") > 0, F.array_distinct("ceremonies")).when(razzie, every).otherwise(F.filter(every, lambda c: c != E.RAZZIE))
    asked = searches.join(entries_named(searches, entries), "search", "left").where("size(names) = 0 OR entries IS NOT NULL")
    asked = asked.withColumn("ceremony", F.explode(allowed)).withColumnRenamed("tags", "asked_tags")
    met = rows.join(F.broadcast(asked), "ceremony")
    met = met.where(F.col("entries").isNull() | F.array_contains("entries", F.col("entry_id")))
    met = met.where((F.size("asked_tags") == 0) | F.arrays_overlap("tags", "asked_tags"))
    met = met.where((F.col("outcome") == "any") | (F.col("won") == (F.col("outcome") == "won")))
    met = met.where((F.col("year_from").isNull() | (F.col("year") >= F.col("year_from"))) & (F.col("year_to").isNull() | (F.col("year") <= F.col("year_to"))))
    n = met.groupBy("search", "movie_id", "threshold", "mark").agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("threshold"), F.least("n", "mark") / F.col("mark")).when(F.col("n") >= F.col("mark"), 1.0).otherwise(0.0)
    return n.select("search", "movie_id", score.alias("score")).where("score > 0")


def fast_scores(searches: DataFrame, cards: DataFrame) -> DataFrame:
    """(search, movie_id, score) from the wins on the cards, without award rows."""
    won = cards.where(F.exists("win_ids", lambda c: c != E.RAZZIE)).select("movie_id", F.lit(1.0).alias("score"), F.lit(True).alias("_won"))
    return won.join(F.broadcast(searches.select("search", F.lit(True).alias("_won"))), "_won").select("search", "movie_id", "score")


def search_awards(searches: DataFrame, rows: DataFrame, entries: DataFrame, cards: DataFrame) -> DataFrame:
    """(search, movie_id, score) of all searches, each by the path that it qualifies for."""
    return fast_scores(searches.where(is_fast()), cards).unionByName(counted_scores(searches.where(~is_fast()), rows, entries))


def combined(scores: DataFrame, searches: DataFrame, average: bool = False, restrict: DataFrame | None = None) -> DataFrame:
    """The best score of an item over the searches, or their mean, missing ones counting 0."""
    if not average:
        return E.restricted(E.max_merge([scores]), restrict)
    asked = searches.agg(F.count(F.lit(1)).alias("asked"))
    total = scores.groupBy("movie_id").agg(F.sum("score").alias("sum")).crossJoin(F.broadcast(asked))
    return E.restricted(total.select("movie_id", (F.col("sum") / F.col("asked")).alias("score")), restrict)


# Shared awards of several anchors, request by request.


def repeated_tags(anchors: DataFrame, tags: DataFrame) -> DataFrame:
    """(request, tag, level, m) of tags that two or more of a request's anchors have. anchors: (request, movie_id)."""
    counted = anchors.join(tags, "movie_id").groupBy("request", "tag").agg(F.countDistinct("movie_id").alias("m"))
    return counted.where("m >= 2").withColumn("level", tag_level(F.col("tag")))


def _of_level(values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("level") + 1)


def award_cohesion(repeated: DataFrame, sizes: DataFrame) -> DataFrame:
    """(request, cohesion): of the most specific level that is repeated, its best share of the anchors. sizes: (request, n)."""
    best = repeated.groupBy("request", "level").agg(F.max("m").alias("m")).groupBy("request").agg(F.min_by("m", "level").alias("m"), F.min("level").alias("level"))
    return best.join(sizes, "request").select("request", (_of_level(SPECIFICITY) * 2 * F.log1p(9 * F.col("m") / F.col("n")) / F.log(F.lit(10.0))).alias("cohesion"))


def award_lane(candidates: DataFrame, repeated: DataFrame, tags: DataFrame) -> DataFrame:
    """(request, movie_id, specific_award): weight of the repeated tags that a candidate has, of all of them. candidates: (request, movie_id)."""
    whole = repeated.groupBy("request").agg(F.sum(_of_level(TIER_WEIGHT)).alias("whole"))
    shared = candidates.join(tags, "movie_id").join(repeated, ["request", "tag"]).groupBy("request", "movie_id").agg(F.sum(_of_level(TIER_WEIGHT)).alias("shared"))
    return shared.join(whole, "request").select("request", "movie_id", S.clamp(F.col("shared") / F.col("whole")).alias("specific_award"))


# Registered queries.

SEARCHES = [
    (0, [], [], [], "won", None, None, False, 1),
    (1, [3, 10], [], [], "any", 1993, 1996, True, 4),
    (2, [], [], [103, 2], "won", None, None, False, 2),
    (3, [], [], [RAZZIE_GROUP], "any", None, 1995, True, 3),
    (4, [], ["the best film award supplier 000000027", "Supplier#000000012", "of the"], [], "any", None, None, False, 1),
    (5, [], ["no such prize"], [], "any", None, None, False, 1),
    (6, [1, 2, 4], [], [10_001], "nominated", 1994, None, True, 2),
]


def award_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven searches at once: by any win, ceremonies and years, category tags of each level, prize names."""
    searches = spark.createDataFrame(SEARCHES, SEARCH)
    found = search_awards(searches, award_rows(spark, sf_dir), award_entries(spark, sf_dir), C.cards(spark, sf_dir))
    return found.select("search", "movie_id", C.r6(F.col("score")).alias("score"))


def award_search_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the seven searches over a pool."""
    searches = spark.createDataFrame(SEARCHES, SEARCH)
    found = search_awards(searches, award_rows(spark, sf_dir), award_entries(spark, sf_dir), C.cards(spark, sf_dir))
    return E._rounded(combined(found, searches, average=True, restrict=E._pool(spark, sf_dir)))


def award_tag_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_idf(award_tags(spark, sf_dir), C.cards(spark, sf_dir)).withColumn("idf", C.r6(F.col("idf")))


def _listed(values: list, kind: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"]::{kind}[]"


AWARD_ROWS = f"""
award_rows AS (
  SELECT DISTINCT l_partkey AS movie_id, l_suppkey % 12 + 1 AS ceremony, l_suppkey AS entry_id,
    CASE WHEN l_suppkey % 12 + 1 = {E.RAZZIE} THEN {RAZZIE_LEAF} + l_linenumber % {RAZZIE_LEAVES} ELSE (l_suppkey + l_linenumber) % {LEAVES} + 1 END AS leaf, l_returnflag = 'A' AND l_quantity > 45 AS won, year(l_shipdate) AS year
  FROM lineitem),
tagged AS (
  SELECT *, [leaf, CASE WHEN leaf >= {RAZZIE_LEAF} THEN {RAZZIE_MIDDLE} ELSE {MIDDLE_FROM} + (leaf - 1) // 2 END, CASE WHEN leaf >= {RAZZIE_LEAF} THEN {RAZZIE_GROUP} ELSE {GROUP_FROM} + (leaf - 1) // 4 END] AS tags FROM award_rows)"""
_NUMBERED = "string_split(regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), '\\s+', ' ', 'g'), ' ')"
_STOPS = _listed(list(T.AWARD_QUERY_STOPLIST), "VARCHAR")
_SEARCHES = (
    "searches(search, ceremonies, names, asked, outcome, year_from, year_to, threshold, mark) AS (VALUES\n  "
    + ",\n  ".join(f"({s}, {_listed(c, 'INT')}, {_listed(n, 'VARCHAR')}, {_listed(t, 'INT')}, '{o}', {a or 'NULL'}, {b or 'NULL'}, {h}, {m})" for s, c, n, t, o, a, b, h, m in SEARCHES)
    + ")"
)
_FOUND = f"""WITH{C.CARDS},{AWARD_ROWS}, {_SEARCHES},
entries AS (SELECT s_suppkey AS entry_id, {_NUMBERED.format("'Best Film Award - ' || s_name")} AS held FROM supplier),
asked_names AS (
  SELECT search, list_filter({_NUMBERED.format("name")}, lambda w: w <> '' AND NOT list_contains({_STOPS}, w)) AS words FROM (SELECT search, unnest(names) AS name FROM searches)),
named AS (SELECT DISTINCT search, entry_id FROM asked_names JOIN entries ON len(words) > 0 AND list_has_all(held, words)),
counted AS (
  SELECT search, movie_id, threshold, mark, count(*) AS n FROM searches s JOIN tagged r
    ON CASE WHEN len(ceremonies) > 0 THEN list_contains(ceremonies, ceremony) ELSE ceremony <> {E.RAZZIE} OR list_has_any(asked, [60, 61, 62, {RAZZIE_MIDDLE}, {RAZZIE_GROUP}]) END
    AND (len(asked) = 0 OR list_has_any(tags, asked)) AND (outcome = 'any' OR won = (outcome = 'won')) AND (year_from IS NULL OR year >= year_from) AND (year_to IS NULL OR year <= year_to)
  WHERE search <> 0 AND (len(names) = 0 OR (s.search, r.entry_id) IN (SELECT (search, entry_id) FROM named)) GROUP BY 1, 2, 3, 4),
found AS (
  SELECT 0 AS search, movie_id, 1::DOUBLE AS score FROM cards WHERE len(list_filter(win_ids, lambda c: c <> {E.RAZZIE})) > 0
  UNION ALL SELECT search, movie_id, CASE WHEN threshold THEN least(n, mark)::DOUBLE / mark ELSE 1 END FROM counted WHERE threshold OR n >= mark)"""
QUERIES = {
    "award_search_table": (award_search_table, f"{_FOUND} SELECT search, movie_id, round(score, 6) AS score FROM found"),
    "award_search_mean": (award_search_mean, f"{_FOUND}, {E._POOL} " + E._fill(f"SELECT movie_id, sum(score) / {len(SEARCHES)} AS score FROM found GROUP BY 1", "x").replace(", 'x' AS kind", "")),
    "award_tag_idf": (
        award_tag_idf,
        f"""WITH{C.CARDS},{AWARD_ROWS}, t AS (SELECT DISTINCT movie_id, unnest(tags) AS tag FROM tagged), d AS (SELECT tag, count(*) AS df FROM t GROUP BY 1)
        SELECT tag, CASE WHEN tag >= 10000 THEN 2 WHEN tag >= 100 THEN 1 ELSE 0 END AS level, df, round(ln((SELECT count(*) FROM cards)::DOUBLE / df) / ln((SELECT count(*) FROM cards)), 6) AS idf FROM d""",
    ),
}
