"""Catalogue views over the driver tables: item cards, postings, credits, awards, vectors.

Each view has a Spark form, which the store writes once and all queries read, and, for the oracle, the same definition in SQL
over the base tables. Sums are of integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .store import stored

SPACES = 8
DIMS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@stored("item_lines", "lineitem", "supplier", "part")
def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, votes, lines, parts): an item's lines as one array, by term and then place, and its rows of part; all views of items are derived from it, row by row.

    Lines are dealt by item before they are collected, so that each crosses the network once and as it is: collected by task, they would cross as
    many small arrays. Parts meet them there, a partition at a time: joined to the cards, all of them would be broadcast to each task, or the arrays dealt again.
    """
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    won = F.col("l_returnflag") == "A"
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("movie_id"), "l_suppkey", F.col("l_linenumber").alias("line"), F.round(F.col("l_discount") * 100).cast("long").alias("cents"), F.col("l_shipdate").alias("day"), won.alias("won"), (won & (F.col("l_quantity") > 45)).alias("won_high")
    )
    line = F.struct(F.col("l_suppkey").alias("term"), F.col("line").isNull().alias("unplaced"), "line", "cents", "day", "won", "won_high", "nation")
    items = lines.join(nations, "l_suppkey", "left").repartition("movie_id").groupBy("movie_id").agg(F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_list(line)).alias("lines"))
    part = table(spark, sf_dir, "part")
    parts = part.select("p_partkey", F.struct(*[c for c in part.columns if c != "p_partkey"]).alias("part")).groupBy("p_partkey").agg(F.collect_list("part").alias("parts"))
    return items.join(parts.hint("shuffle_hash"), items["movie_id"] == parts["p_partkey"], "left").drop("p_partkey")


def of_lines(make: Callable[[Column], Column]) -> Column:
    """Distinct values of an item's lines."""
    return F.array_distinct(F.transform("lines", make))


def known(values: Column, kind: str) -> Column:
    """The distinct values that are not null, in their order."""
    return F.sort_array(F.array_except(values, F.array(F.lit(None).cast(kind))))


def rows_of_lines(items: DataFrame, values: Column) -> DataFrame:
    """(movie_id, x): the distinct structs of an array over each item's lines. They are sorted and compared with the one before, not each with each."""
    made = items.select("movie_id", F.sort_array(values).alias("made"))
    return made.select("movie_id", F.explode(F.filter("made", lambda x, i: (i == 0) | ~F.get("made", i - 1).eqNullSafe(x))).alias("x"))


def firsts() -> Column:
    """The first line of each term: lines are sorted by term and place."""
    return F.filter("lines", lambda x, i: (i == 0) | ~F.get("lines", i - 1)["term"].eqNullSafe(x["term"]))


@stored("cards", "part", "lineitem", "supplier")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item that has postings, with its countries in the order of billing, the percentile of its votes, its popularity and its title's lookup form."""
    placed = F.sort_array(F.transform(F.filter("lines", lambda x: x["nation"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["nation"].alias("nation"))))
    total = F.aggregate("lines.cents", F.lit(None).cast("long"), lambda a, x: F.coalesce(a + x, a, x))
    facts = item_lines(spark, sf_dir).where("movie_id IS NOT NULL").select(
        "movie_id",
        F.inline("parts"),
        "votes",
        F.round(100.0 - 10.0 * total / F.col("votes"), 4).alias("reception"),
        F.unix_seconds(F.array_min("lines.day").cast("timestamp")).alias("released"),
        known(F.col("lines.term"), "long").alias("keyword_ids"),
        known(F.col("lines.line"), "int").alias("genre_ids"),
        F.array_distinct(placed["nation"]).alias("country_ids"),
        known(F.transform("lines.term", lambda t: t % 6), "long").alias("language_ids"),
        known(F.transform("lines", lambda x: x["term"] % 9 * 16 + x["line"] % 3 + 1), "long").alias("offer_keys"),
        known(F.transform(F.filter("lines", lambda x: x["won_high"]), lambda x: x["term"] % 12 + 1), "long").alias("win_ids"),
    )
    none = F.array().cast("array<int>")
    part = facts.select(
        "movie_id",
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("format"),
        F.col("p_size").alias("runtime"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 5 + 1).alias("maturity_rank"),
        F.col("p_retailprice").alias("budget"),
        F.when(F.col("p_retailprice") < 1200, "small").when(F.col("p_retailprice") >= 1700, "large").alias("budget_bucket"),
        (F.col("p_size") % 5).alias("release_format"),
        F.when(F.col("movie_id") % 3 == 0, F.array(F.col("p_size") % 10)).otherwise(none).alias("lineage_ids"),
        F.when(F.col("movie_id") % 4 == 0, F.array(F.col("p_size") % 12)).otherwise(none).alias("universe_ids"),
        F.when(F.col("movie_id") % 2 == 0, F.array(F.col("p_size") % 3)).otherwise(none).alias("subgroup_ids"),
        F.when(F.col("movie_id") % 5 == 0, F.col("movie_id") % 15 == 0).alias("is_spinoff"),
        F.when(F.col("movie_id") % 2 == 1, F.array(F.col("p_size") % 6)).otherwise(none).alias("source_ids"),
        F.array(F.col("movie_id") % 8, 8 + F.col("movie_id") % 5).alias("tag_ids"),
        *facts.columns[facts.columns.index("votes") :],
    )
    ranked = percent_rank_of(part, "votes", "pct")
    return ranked.withColumn("popularity", popularity_of(F.col("pct"))).withColumn("normal", T.normalize(F.col("title")))


CARDS = """
facts AS (
  SELECT l_partkey AS movie_id, count(*) AS votes,
    round(100.0::DOUBLE - 10.0::DOUBLE * sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / count(*), 4) AS reception,
    CAST(floor(epoch(min(l_shipdate))) AS BIGINT) AS released,
    list_sort(list(DISTINCT l_suppkey)) AS keyword_ids, list_sort(list(DISTINCT l_linenumber)) AS genre_ids,
    list_sort(list(DISTINCT l_suppkey % 6)) AS language_ids, list_sort(list(DISTINCT l_suppkey % 9 * 16 + l_linenumber % 3 + 1)) AS offer_keys,
    coalesce(list_sort(list(DISTINCT l_suppkey % 12 + 1) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 45)), []) AS win_ids
  FROM lineitem GROUP BY 1),
countries AS (
  SELECT movie_id AS part, list(nation ORDER BY line, nation) AS country_ids FROM (
    SELECT l_partkey AS movie_id, s_nationkey AS nation, min(l_linenumber) AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) GROUP BY 1),
cards AS (
  SELECT p_partkey AS movie_id, p_name AS title, p_brand AS company, p_type AS format, p_size AS runtime,
    CASE WHEN p_size % 7 <> 0 THEN p_size % 5 + 1 END AS maturity_rank, p_retailprice AS budget,
    votes, reception, released, keyword_ids, genre_ids, language_ids, offer_keys, win_ids, coalesce(country_ids, []) AS country_ids,
    CASE WHEN p_retailprice < 1200 THEN 'small' WHEN p_retailprice >= 1700 THEN 'large' END AS budget_bucket, p_size % 5 AS release_format,
    CASE WHEN p_partkey % 3 = 0 THEN [p_size % 10] ELSE [] END AS lineage_ids, CASE WHEN p_partkey % 4 = 0 THEN [p_size % 12] ELSE [] END AS universe_ids,
    CASE WHEN p_partkey % 2 = 0 THEN [p_size % 3] ELSE [] END AS subgroup_ids, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 15 = 0 END AS is_spinoff,
    CASE WHEN p_partkey % 2 = 1 THEN [p_size % 6] ELSE [] END AS source_ids, [p_partkey % 8, 8 + p_partkey % 5] AS tag_ids
  FROM part JOIN facts ON p_partkey = movie_id LEFT JOIN countries ON p_partkey = countries.part)"""


@stored("postings", "lineitem", "supplier")
def person_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, movie_id, position, cast_size): a person's best billing in an item and the item's billing length."""
    rows = item_lines(spark, sf_dir).where("movie_id IS NOT NULL").select("movie_id", F.array_max(F.transform("lines", lambda x: x["line"])).alias("cast_size"), F.explode(firsts()).alias("x"))
    return rows.select("x.term", "movie_id", F.col("x.line").alias("position"), "cast_size")


#: The roles of people, each but the first at the line of its number.
ROLES = ("actor", "director", "writer", "producer", "composer")


@stored("credits", "lineitem", "supplier")
def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, term, movie_id, position, cast_size): every credit once; only actors have a place."""
    credited = F.transform(F.filter("lines", lambda x: x["line"].between(1, len(ROLES) - 1)), lambda x: F.struct(x["term"].alias("term"), x["line"].alias("line")))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES[1:]]), F.col("x.line"))
    others = rows_of_lines(item_lines(spark, sf_dir), credited).select(role.alias("role"), "x.term", "movie_id")
    actors = person_postings(spark, sf_dir).withColumn("role", F.lit(ROLES[0]))
    return actors.unionByName(others, allowMissingColumns=True).select("role", "term", "movie_id", "position", "cast_size")


POSTINGS = """
postings AS (
  SELECT l_suppkey AS term, l_partkey AS movie_id, min(l_linenumber) AS position, any_value(size) AS cast_size
  FROM lineitem JOIN (SELECT l_partkey AS k, max(l_linenumber) AS size FROM lineitem GROUP BY 1) ON k = l_partkey GROUP BY 1, 2)"""


@stored("awards", "lineitem", "supplier")
def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (movie_id, ceremony, won, year)."""
    award = lambda x: F.struct((x["term"] % 12 + 1).alias("ceremony"), x["won"].alias("won"), F.year(x["day"]).alias("year"))
    return rows_of_lines(item_lines(spark, sf_dir), F.transform("lines", award)).select("movie_id", "x.*")


AWARDS = """
awards AS (
  SELECT DISTINCT l_partkey AS movie_id, l_suppkey % 12 + 1 AS ceremony, l_returnflag = 'A' AS won, year(l_shipdate) AS year FROM lineitem)"""


@stored("vectors", "embeddings")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, space, vector, format, norm): each embedding cut into SPACES slices of DIMS numbers."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(SPACES - 1)), lambda s: F.struct(s.alias("space"), F.slice("embedding", s * DIMS + 1, DIMS).cast("array<double>").alias("vector")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie_id"), F.col("label").alias("format"), F.explode(cut).alias("x"))
    return rows.select("movie_id", "format", "x.space", "x.vector", S.norm(F.col("x.vector")).alias("norm"))


VECTORS = f"""
vectors AS (
  SELECT vec_id AS movie_id, label AS format, s AS space, CAST(embedding[s * {DIMS} + 1 : s * {DIMS} + {DIMS}] AS DOUBLE[]) AS vector
  FROM embeddings, range({SPACES}) r(s))"""


#: Arrays of the cards that hold traits, by kind.
TRAIT_COLUMNS = {"keyword": "keyword_ids", "genre": "genre_ids", "source": "source_ids", "tag": "tag_ids", "language": "language_ids"}


@stored("card_traits", "part", "lineitem", "supplier")
def card_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, kind, trait_id): the id arrays of the cards as rows, without repeats."""
    d = cards(spark, sf_dir)
    parts = [d.select("movie_id", F.lit(k).alias("kind"), F.explode(F.array_distinct(F.col(c).cast("array<long>"))).alias("trait_id")) for k, c in TRAIT_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts)


@stored("franchise_entries", "part", "lineitem", "supplier")
def franchise_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movie_id, entry, lineage): the entries of an item's lineage (true) or of its universe alone (false)."""
    d = cards(spark, sf_dir)
    parts = [d.select("movie_id", F.explode(F.col(c).cast("array<long>")).alias("entry"), F.lit(c == "lineage_ids").alias("lineage")) for c in ("lineage_ids", "universe_ids")]
    return parts[0].unionByName(parts[1]).groupBy("movie_id", "entry").agg(F.max("lineage").alias("lineage"))


def percent_rank_of(df: DataFrame, value: str, out: str) -> DataFrame:
    """PERCENT_RANK over a column by its value histogram: one small window over distinct values, never over all rows."""
    histogram = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    ranks = histogram.select(F.col(value).alias("_value"), F.when(total > 1, below / (total - 1)).otherwise(0.0).alias(out))
    return df.join(F.broadcast(ranks), df[value].eqNullSafe(ranks["_value"])).drop("_value")


def popularity_of(pct: Column) -> Column:
    """A sigmoid of the vote percentile."""
    return 1 / (1 + F.exp(-15.0 * (pct - 0.70)))


POPULAR = """
popular AS (SELECT *, 1 / (1 + exp(-15.0 * (percent_rank() OVER (ORDER BY votes) - 0.70))) AS popularity FROM cards)"""


#: Ranges of ids within which rows of one event count are ranked, so that a count held by most rows is not one group.
ID_RANGES = 4096


@stored("trend", "events")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - sqrt(rank / n) by event count, ties by id. Ranks come from the histogram of counts by id range plus a rank within each of its cells."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("movie_id")).agg(F.count(F.lit(1)).alias("events"))
    ends = table(spark, sf_dir, "events").agg(F.min("user_id").alias("_low"), F.max("user_id").alias("_high"))
    cell = F.floor((F.col("movie_id") - F.col("_low")) * ID_RANGES / (F.col("_high") - F.col("_low") + 1))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_cell", cell).drop("_low", "_high")
    cells = counts.groupBy("events", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    levels = cells.groupBy("events").agg(F.sum("_n").alias("_level"))
    above = F.coalesce(F.sum("_level").over(Window.orderBy(F.desc("events")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("events", above.alias("_above"), F.sum("_level").over(Window.partitionBy(F.lit(1))).alias("_total"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("events").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.withColumn("_before", earlier).drop("_n").join(levels, "events")
    within = F.row_number().over(Window.partitionBy("events", "_cell").orderBy("movie_id")) - 1
    ranked = counts.join(offsets, ["events", "_cell"]).withColumn("rank", F.col("_above") + F.col("_before") + within)
    return ranked.select("movie_id", "events", "rank", (1 - F.sqrt(F.col("rank") / F.col("_total"))).alias("score"))


def r6(c: Column) -> Column:
    return F.round(c, 6)
