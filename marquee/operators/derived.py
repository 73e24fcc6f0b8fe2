"""Derived tables and lookups: token frequencies, strengths by percentile, inverse frequencies of four kinds of traits, recall, votes of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..sources import catalogue as C
from ..sources.store import stored
from . import preferences as P

# Kinds of traits by their column; idf limits of recall; rows a phrase may match.
TRAIT_KINDS = {1: "keyword_ids", 2: "genre_ids", 3: "source_ids", 4: "tag_ids"}
SINGLE_IDF, COMBO_IDF, COMBO_SUM = 0.55, 0.30, 0.50
PHRASE_LIMIT = 500


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, entry_id, name) of the dictionaries: companies, franchises and awards, here brands, nations and customers' segments."""
    company = C.table(spark, sf_dir, "part").select("p_brand").distinct().select(F.lit("company").alias("kind"), F.xxhash64("p_brand").alias("entry_id"), F.col("p_brand").alias("name"))
    franchise = C.table(spark, sf_dir, "nation").select(F.lit("franchise").alias("kind"), F.col("n_nationkey").cast("long").alias("entry_id"), F.concat(F.lit("The "), "n_name", F.lit(" of the 3rd "), F.col("n_regionkey")).alias("name"))
    award = C.table(spark, sf_dir, "supplier").select(F.lit("award").alias("kind"), F.col("s_suppkey").alias("entry_id"), F.concat(F.lit("Best Film Award - "), "s_name").alias("name"))
    return reduce(DataFrame.unionByName, [company, franchise, award])


def name_tokens(entries: DataFrame) -> DataFrame:
    """(kind, entry_id, token): normalised tokens with number words; franchises without their stoplist."""
    clean = T.number_words(T.normalize(T.straight_quotes(F.col("name"))))
    found = F.when(F.col("kind") == "franchise", T.name_tokens(clean, T.FRANCHISE_STOPLIST)).otherwise(T.name_tokens(clean))
    return entries.select("kind", "entry_id", F.explode(found).alias("token"))


def entries_of(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, kind, entry_id): entries that hold all tokens of a phrase. phrases: (phrase, kind, token, wanted)."""
    hits = tokens.join(F.broadcast(phrases), ["kind", "token"]).groupBy("phrase", "kind", "wanted", "entry_id").agg(F.countDistinct("token").alias("held"))
    return hits.where("held = wanted").select("phrase", "kind", "entry_id")


def derived_name_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, its hyphen variants, tokens and query tokens of every dictionary name."""
    clean = T.number_words(T.normalize(T.straight_quotes(F.col("name"))))
    d = names(spark, sf_dir).where("kind <> 'company'").withColumn("normal", clean)
    joined = lambda c: F.array_join(c, "|")
    return d.select("kind", "entry_id", "normal", joined(T.hyphen_variants(F.col("normal"))).alias("variants"), joined(T.name_tokens(F.col("normal"), T.AWARD_QUERY_STOPLIST)).alias("query_tokens"))


def derived_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every token, by dictionary."""
    return name_tokens(names(spark, sf_dir)).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("df"))


PHRASES = (("franchise", "nation 3"), ("franchise", "third 1"), ("award", "supplier one"), ("company", "nothing such"))


def derived_phrase_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of stated phrases: every token of the phrase must be in the name."""
    rows = spark.createDataFrame([(p, k) for k, p in PHRASES], "phrase string, kind string").withColumn("tokens", T.name_tokens(T.number_words(T.normalize_ascii(F.col("phrase"))), T.FRANCHISE_STOPLIST))
    wanted = rows.select("phrase", "kind", F.explode("tokens").alias("token"), F.size("tokens").alias("wanted"))
    return entries_of(name_tokens(names(spark, sf_dir)), wanted)


def derived_like_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words that begin with a query's text, at most PHRASE_LIMIT a query, the shortest first."""
    words = name_tokens(names(spark, sf_dir)).select("token").distinct()
    queries = spark.createDataFrame([(0, "s"), (1, "su"), (2, "twenty%"), (3, "t")], "query int, start string").withColumn("pattern", F.concat(T.escape_like(F.col("start")), F.lit("%")))
    found = words.join(F.broadcast(queries), F.expr("token LIKE pattern"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.char_length("token"), "token"))
    return found.select("query", "token", rank.alias("rank")).where(F.col("rank") <= PHRASE_LIMIT)


def derived_director_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead people with two items or more: strength and its percentile among them, from the histogram of strengths."""
    lead = C.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("term"), F.col("l_partkey").alias("movie_id")).distinct()
    cards = C.cards(spark, sf_dir).select("movie_id", C.r6(F.col("popularity")).cast("decimal(12,6)").alias("p"), "reception")
    raw = lead.join(cards, "movie_id").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(0.8 * F.avg("p").cast("double") + 0.2 * F.avg(S.clamp(F.col("reception") / 100)), 6).alias("strength")).where("n >= 2")
    ranked = C.percent_rank_of(raw, "strength", "percentile")
    return ranked.select("term", "n", "strength", C.r6(F.col("percentile")).alias("percentile"))


def _kind_traits() -> list[Column]:
    """One array of (kind, trait_id) for each kind of trait."""

    def of(kind: int):
        return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("trait_id"))

    return [F.transform(F.col(c).cast("array<long>"), of(k)) for k, c in TRAIT_KINDS.items()]


def kinds_idf(cards: DataFrame) -> DataFrame:
    """(kind, trait_id, df, idf): ln(N / df) / ln N over four kinds of traits, in one pass over the cards."""
    rows = cards.select(F.explode(F.array_distinct(F.concat(*_kind_traits()))).alias("x")).select("x.*")
    total = cards.agg(F.count(F.lit(1)).alias("total"))
    counted = rows.groupBy("kind", "trait_id").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("kind", "trait_id", "df", (F.log(F.col("total") / F.col("df")) / F.log("total")).alias("idf"))


def derived_trait_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds_idf(C.cards(spark, sf_dir)).withColumn("idf", C.r6(F.col("idf")))


def trait_rows(cards: DataFrame) -> DataFrame:
    """(movie_id, kind, trait_id) of all four kinds."""
    return cards.select("movie_id", F.explode(F.array_distinct(F.concat(*_kind_traits()))).alias("x")).select("movie_id", "x.*")


def recall_by_traits(rows: DataFrame, wanted: DataFrame, single: float = SINGLE_IDF, from_idf: float = COMBO_IDF, combined: float = COMBO_SUM) -> DataFrame:
    """Items with one rare wanted trait, or several of middling rarity that add up. wanted: (kind, trait_id, idf)."""
    met = rows.join(F.broadcast(wanted), ["kind", "trait_id"]).groupBy("movie_id").agg(F.sum(F.when(F.col("idf") >= from_idf, F.col("idf")).otherwise(0.0)).alias("combined"), F.max("idf").alias("rarest"))
    return met.where((F.round("combined", 9) >= combined) | (F.round("rarest", 9) >= single))


def derived_themes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by the traits of item 12, with limits for a catalogue whose traits are all common."""
    cards = C.cards(spark, sf_dir)
    rows = trait_rows(cards)
    own = rows.where("movie_id = 12").select("kind", "trait_id")
    wanted = kinds_idf(cards).join(F.broadcast(own), ["kind", "trait_id"]).select("kind", "trait_id", "idf")
    return recall_by_traits(rows, wanted, 0.32, 0.15, 1.0).select("movie_id", C.r6(F.col("combined")).alias("combined"), C.r6(F.col("rarest")).alias("rarest"))


def majority(votes: DataFrame, runs: int) -> DataFrame:
    """(movie_id, tag): tags that more than half of the runs give. votes: (movie_id, run, tag)."""
    return votes.groupBy("movie_id", "tag").agg(F.countDistinct("run").alias("n")).where(F.col("n") >= runs // 2 + 1).select("movie_id", "tag")


def modal_vote(votes: DataFrame, first_run: int = 0) -> DataFrame:
    """(movie_id, tag): the most frequent of single votes; a tie goes to the first run's vote if it is among the tied, else to the earliest run's."""
    counted = votes.groupBy("movie_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first"))
    best = counted.groupBy("movie_id").agg(F.max_by("tag", F.struct("n", (F.col("first") == first_run), -F.col("first"))).alias("tag"))
    return best


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of tags an item: its tags, shifted by the run for some items."""
    cards = C.cards(spark, sf_dir).select("movie_id", "tag_ids").crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("run"))))
    return cards.select("movie_id", "run", F.explode(F.transform("tag_ids", lambda t: t + F.when(F.col("movie_id") % (F.col("run") + 2) == 0, F.col("run")).otherwise(0))).alias("tag"))


def derived_majority_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority(_runs(spark, sf_dir), 3).select("movie_id", F.col("tag").cast("long").alias("tag"))


def derived_modal_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = C.cards(spark, sf_dir).select("movie_id").crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("run"))))
    return modal_vote(ends.select("movie_id", "run", ((F.col("movie_id") * (F.col("run") + 3)) % 4).alias("tag")))


def award_signals(awards: DataFrame) -> DataFrame:
    """Per item: wins and nominations that are not of ceremony 10, its razzies, and the two tiers 1, .75 and 0."""
    razzie, won = F.col("ceremony") == 10, F.col("won")
    flags = awards.groupBy("movie_id").agg(*[F.bool_or(c).alias(n) for n, c in (("win", ~razzie & won), ("nomination", ~razzie & ~won), ("razzie_win", razzie & won), ("razzie_nomination", razzie & ~won), ("picture", ~razzie & (F.col("ceremony") == 1)))])
    tier = lambda a, b: F.when(F.col(a), 1.0).when(F.col(b), 0.75).otherwise(0.0)
    return flags.select("movie_id", tier("win", "nomination").alias("non_razzie"), tier("razzie_win", "razzie_nomination").alias("razzie"), "picture", F.col("razzie_win").alias("bad_razzie"))


def derived_award_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return award_signals(C.awards(spark, sf_dir))


def derived_item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the three best billed people, the directors, the distinct award ceremonies, each as a sorted list."""
    lines = C.table(spark, sf_dir, "lineitem")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    best = C.person_postings(spark, sf_dir)
    cast = best.groupBy("movie_id").agg(listed(F.when(F.col("position") <= 3, F.col("term"))).alias("top_cast"))
    rest = lines.groupBy(F.col("l_partkey").alias("movie_id")).agg(listed(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("directors"), listed(F.col("l_suppkey") % 12 + 1).alias("ceremonies"))
    return cast.join(rest, "movie_id")


# Bounds of the quality lists and the ranges over which their orders rise.
CULT_RECEPTION, CULT_PERCENTILE, PRESTIGE_RECEPTION, QUALITY_LIMIT = 50.0, 0.75, 75.0, 500


def quality_recall(cards: DataFrame, limit: int = QUALITY_LIMIT, poor: float = CULT_RECEPTION, known: float = CULT_PERCENTILE, acclaimed: float = PRESTIGE_RECEPTION) -> DataFrame:
    """(movie_id, bucket): the best `limit` of badly received, well-known items, and of items with acclaim or an award, each by a blend of both."""
    r, pct = F.col("reception"), F.coalesce("pct", F.lit(0.0))
    won = F.exists("win_ids", lambda x: x != 10)
    cult = 0.5 * S.clamp((poor - r) / 30) + 0.5 * S.clamp((pct - known) / 0.20)
    prestige = 0.75 * S.clamp((F.coalesce(r, F.lit(0.0)) - acclaimed) / 20) + 0.25 * F.greatest(S.clamp((pct - 0.50) / 0.30), won.cast("double"))
    both = [cards.where((r <= poor) & (F.col("pct") >= known)).select("movie_id", F.lit("cult").alias("bucket"), F.round(cult, 9).alias("worth")), cards.where((r >= acclaimed) | won).select("movie_id", F.lit("prestige").alias("bucket"), F.round(prestige, 9).alias("worth"))]
    best = Window.partitionBy("bucket").orderBy(F.desc("worth"), "movie_id")
    return both[0].unionByName(both[1]).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).select("movie_id", "bucket")


@stored("quality_lists", "part", "lineitem", "supplier")
def quality_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_recall(C.cards(spark, sf_dir))


def derived_quality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by quality: acclaimed ones by percentile with or without an award, and poorly received well-known ones; the best 500 of each."""
    return quality_lists(spark, sf_dir)


def derived_card_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as shown: release day, rating label, reception tier, decade, budget bucket, first language and the rest."""
    c = F.col
    label = F.element_at(F.array(*map(F.lit, ("G", "PG", "PG-13", "R", "NC-17"))), c("maturity_rank").cast("int"))
    tier = F.when(c("reception") >= 81, "universally acclaimed").when(c("reception") >= 61, "generally favorable").when(c("reception") >= 41, "mixed or average").when(c("reception") >= 21, "generally unfavorable").when(c("reception").isNotNull(), "overwhelming dislike")
    year = F.year(F.timestamp_seconds("released"))
    era = F.when(year < 1930, "silent era").when(year < 1950, "golden age").otherwise(F.concat(F.lpad((F.floor(year / 10) * 10 % 100).cast("string"), 2, "0"), F.lit("s")))
    return C.cards(spark, sf_dir).select(
        "movie_id",
        "title",
        F.date_format(F.timestamp_seconds("released"), "yyyy-MM-dd").alias("released_on"),
        F.when(c("maturity_rank").isNull(), "UNRATED").otherwise(label).alias("rating"),
        tier.alias("tier"),
        era.alias("era"),
        F.coalesce("budget_bucket", F.lit("mid")).alias("budget"),
        F.element_at("language_ids", 1).alias("language"),
        F.array_join(F.slice("language_ids", 2, 20), ",").alias("other_languages"),
        F.when(c("runtime") <= 40, 3).otherwise(c("release_format")).cast("int").alias("format"),
    )


def derived_restricted_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose company, source or franchise ids overlap the wanted ones, one flag each; franchise ids are looked for in both columns."""
    c = F.col
    d = C.cards(spark, sf_dir).select(
        "movie_id",
        P._any_of(c("source_ids"), [1, 4]).alias("by_source"),
        (P._any_of(c("lineage_ids"), [2, 3]) | P._any_of(c("universe_ids"), [2, 3]) | P._any_of(c("subgroup_ids"), [0])).alias("by_franchise"),
        c("title").like("%bolt%").alias("by_title"),
        P._any_of(c("win_ids"), [x for x in range(1, 13) if x != 10]).alias("won_any"),
    )
    return d.where("by_source OR by_franchise OR by_title OR won_any")


_NAMES = """names AS (SELECT 'franchise' AS kind, CAST(n_nationkey AS BIGINT) AS entry_id, 'the ' || lower(n_name) || ' of the third ' || CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE 'four' END AS raw FROM nation
  UNION ALL SELECT 'award', s_suppkey, 'best film award - ' || lower(s_name) FROM supplier)"""


def _number_sql(n: str) -> str:
    ones, tens = str(T.ONES), str(T.TENS)
    return f"CASE WHEN {n} > 99 THEN NULL WHEN {n} < 20 THEN {ones}[{n} + 1] WHEN {n} % 10 = 0 THEN {tens}[{n} // 10 - 1] ELSE {tens}[{n} // 10 - 1] || '-' || {ones}[{n} % 10 + 1] END"


# Names are ASCII words; what is left to do is to drop marks and to spell the numbers between hyphens and blanks.
_PART = "CASE WHEN regexp_full_match(p, '[0-9]+') THEN coalesce(" + _number_sql("CAST(p AS BIGINT)") + ", p) ELSE p END"
_NORMAL = f"""{_NAMES}, spaced AS (SELECT kind, entry_id, trim(regexp_replace(regexp_replace(raw, '[^a-z0-9_ -]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM names),
normal AS (SELECT kind, entry_id, array_to_string([array_to_string([{_PART} FOR p IN string_split(w, '-')], '-') FOR w IN string_split(t, ' ')], ' ') AS normal FROM spaced)"""
_TOK = "list_distinct(list_filter(flatten([CASE WHEN contains(w, '-') THEN [w] || string_split(w, '-') ELSE [w] END FOR w IN string_split(normal, ' ')]), lambda x: replace(x, '-', '') <> ''))"
_TOKENS = f"""{_NORMAL}, company AS (SELECT DISTINCT 'company' AS kind, p_brand AS name, trim(regexp_replace(lower(p_brand), '[^a-z0-9_-]+', ' ', 'g')) AS t FROM part),
ctok AS (SELECT DISTINCT kind, name, unnest(string_split(array_to_string([array_to_string([{_PART} FOR p IN string_split(w, '-')], '-') FOR w IN string_split(t, ' ')], ' '), ' ')) AS w FROM company),
ctokens AS (SELECT DISTINCT kind, name, unnest(CASE WHEN contains(w, '-') THEN [w] || string_split(w, '-') ELSE [w] END) AS token FROM ctok),
tokens AS (SELECT kind, entry_id, token FROM (SELECT kind, entry_id, unnest({_TOK}) AS token FROM normal) WHERE kind <> 'franchise' OR token NOT IN {T.FRANCHISE_STOPLIST})"""
_DF = f"WITH {_TOKENS} SELECT kind, token, count(*) AS df FROM tokens GROUP BY 1, 2 UNION ALL SELECT kind, token, count(*) AS df FROM ctokens WHERE token <> '' GROUP BY 1, 2"
_QUERY_TOK = f"list_filter({_TOK}, lambda x: x NOT IN {T.AWARD_QUERY_STOPLIST})"
_ORDERED = lambda expr: f"array_to_string(list_filter([CASE WHEN list_position(l, x) = i THEN x END FOR x, i IN l], lambda x: x IS NOT NULL), '|') FROM (SELECT {expr} AS l)"
_WORDS = "SELECT DISTINCT token FROM tokens UNION SELECT token FROM ctokens WHERE token <> ''"
_KINDS = " UNION ALL ".join(f"SELECT DISTINCT movie_id, {k} AS kind, CAST(unnest({c}) AS BIGINT) AS trait_id FROM cards" for k, c in TRAIT_KINDS.items())
_IDF = f"WITH{C.CARDS}, tr AS ({_KINDS}), idf AS (SELECT kind, trait_id, count(*) AS df, ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)) AS idf FROM tr GROUP BY 1, 2)"
_STRENGTH = f"""WITH{C.CARDS},{C.POPULAR}, lead AS (SELECT DISTINCT l_suppkey AS term, l_partkey AS movie_id FROM lineitem WHERE l_linenumber = 1),
raw AS (SELECT term, count(*) AS n, round(0.8::DOUBLE * avg(CAST(round(popularity, 6) AS DECIMAL(12, 6))) + 0.2::DOUBLE * avg(least(greatest(reception / 100, 0), 1)), 6) AS strength FROM lead JOIN popular USING (movie_id) GROUP BY 1 HAVING count(*) >= 2)
SELECT term, n, strength, round(percent_rank() OVER (ORDER BY strength), 6) AS percentile FROM raw"""
_RUNS_SQL = f"WITH{C.CARDS}, v AS (SELECT movie_id, run, CAST(unnest(tag_ids) AS BIGINT) + CASE WHEN movie_id % (run + 2) = 0 THEN run ELSE 0 END AS tag FROM cards, range(3) r(run))"
_SUMMARY = f"""WITH{C.CARDS}, d AS (SELECT *, make_timestamp(released * 1000000) AS day FROM cards)
SELECT movie_id, title, strftime(day, '%Y-%m-%d') AS released_on, coalesce(['G', 'PG', 'PG-13', 'R', 'NC-17'][maturity_rank], 'UNRATED') AS rating,
  CASE WHEN reception >= 81 THEN 'universally acclaimed' WHEN reception >= 61 THEN 'generally favorable' WHEN reception >= 41 THEN 'mixed or average' WHEN reception >= 21 THEN 'generally unfavorable' WHEN reception IS NOT NULL THEN 'overwhelming dislike' END AS tier,
  CASE WHEN year(day) < 1930 THEN 'silent era' WHEN year(day) < 1950 THEN 'golden age' ELSE lpad(CAST(year(day) // 10 * 10 % 100 AS VARCHAR), 2, '0') || 's' END AS era,
  coalesce(budget_bucket, 'mid') AS budget, language_ids[1] AS language, array_to_string(language_ids[2:], ',') AS other_languages, CASE WHEN runtime <= 40 THEN 3 ELSE release_format END AS format FROM d"""
_PHRASE_ROWS = "(VALUES ('nation 3', 'franchise', ['nation', 'three']), ('third 1', 'franchise', ['third', 'one']), ('supplier one', 'award', ['supplier', 'one']))"
QUERIES = {
    "derived_name_normal": (derived_name_normal, f"WITH {_NORMAL} SELECT kind, entry_id, normal, array_to_string([v FOR v, i IN [normal, trim(regexp_replace(replace(normal, '-', ' '), ' +', ' ', 'g')), replace(normal, '-', '')] IF list_position([normal, trim(regexp_replace(replace(normal, '-', ' '), ' +', ' ', 'g')), replace(normal, '-', '')], v) = i], '|') AS variants, (SELECT {_ORDERED(_QUERY_TOK.replace('list_distinct', ''))}) AS query_tokens FROM normal"),
    "derived_token_frequency": (derived_token_frequency, _DF),
    "derived_phrase_entries": (derived_phrase_entries, f"WITH {_TOKENS}, held AS (SELECT kind, entry_id, list(token) AS l FROM tokens GROUP BY 1, 2) SELECT phrase, held.kind, entry_id FROM held JOIN {_PHRASE_ROWS} p(phrase, kind, wanted) ON held.kind = p.kind AND list_has_all(l, wanted)"),
    "derived_like_terms": (derived_like_terms, f"WITH {_TOKENS}, words AS ({_WORDS}), q AS (SELECT * FROM (VALUES (0, 's'), (1, 'su'), (2, 'twenty%'), (3, 't')) v(query, start)) SELECT query, token, row_number() OVER (PARTITION BY query ORDER BY length(token), token) AS rank FROM words JOIN q ON starts_with(token, start) QUALIFY rank <= 500"),
    "derived_director_strength": (derived_director_strength, _STRENGTH),
    "derived_trait_idf": (derived_trait_idf, f"{_IDF} SELECT kind, trait_id, df, round(idf, 6) AS idf FROM idf"),
    "derived_themes_recall": (derived_themes_recall, f"{_IDF}, w AS (SELECT kind, trait_id, idf FROM tr JOIN idf USING (kind, trait_id) WHERE movie_id = 12), m AS (SELECT movie_id, sum(CASE WHEN idf >= 0.15 THEN idf ELSE 0 END) AS combined, max(idf) AS rarest FROM tr JOIN w USING (kind, trait_id) GROUP BY 1) SELECT movie_id, round(combined, 6) AS combined, round(rarest, 6) AS rarest FROM m WHERE round(combined, 9) >= 1.0 OR round(rarest, 9) >= 0.32"),
    "derived_majority_tags": (derived_majority_tags, f"{_RUNS_SQL} SELECT movie_id, tag FROM v GROUP BY 1, 2 HAVING count(DISTINCT run) >= 2"),
    "derived_modal_ending": (derived_modal_ending, f"WITH{C.CARDS}, v AS (SELECT movie_id, run, movie_id * (run + 3) % 4 AS tag FROM cards, range(3) r(run)), c AS (SELECT movie_id, tag, count(*) AS n, min(run) AS f FROM v GROUP BY 1, 2) SELECT movie_id, arg_max(tag, n * 10 - f) AS tag FROM c GROUP BY 1"),
    "derived_award_signals": (derived_award_signals, f"WITH{C.AWARDS}, f AS (SELECT movie_id, bool_or(ceremony <> 10 AND won) AS w, bool_or(ceremony <> 10 AND NOT won) AS n, bool_or(ceremony = 10 AND won) AS rw, bool_or(ceremony = 10 AND NOT won) AS rn, bool_or(ceremony = 1) AS picture FROM awards GROUP BY 1) SELECT movie_id, CASE WHEN w THEN 1::DOUBLE WHEN n THEN 0.75 ELSE 0 END AS non_razzie, CASE WHEN rw THEN 1::DOUBLE WHEN rn THEN 0.75 ELSE 0 END AS razzie, picture, rw AS bad_razzie FROM f"),
    "derived_item_sets": (derived_item_sets, f"WITH{C.POSTINGS}, c AS (SELECT movie_id, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (WHERE position <= 3)), ','), '') AS top_cast FROM postings GROUP BY 1), r AS (SELECT l_partkey AS movie_id, coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber = 1)), ','), '') AS directors, array_to_string(list_sort(list(DISTINCT l_suppkey % 12 + 1)), ',') AS ceremonies FROM lineitem GROUP BY 1) SELECT * FROM c JOIN r USING (movie_id)"),
    "derived_quality_candidates": (
        derived_quality_candidates,
        f"""WITH{C.CARDS}, p AS (SELECT *, percent_rank() OVER (ORDER BY votes) AS pct, len(list_filter(win_ids, lambda x: x <> 10)) > 0 AS won FROM cards),
        w AS (
          SELECT movie_id, 'cult' AS bucket, round(0.5::DOUBLE * least(1, greatest(0, (50 - reception) / 30::DOUBLE)) + 0.5::DOUBLE * least(1, greatest(0, (pct - 0.75) / 0.20::DOUBLE)), 9) AS worth FROM p WHERE reception <= 50 AND pct >= 0.75
          UNION ALL
          SELECT movie_id, 'prestige', round(0.75::DOUBLE * least(1, greatest(0, (reception - 75) / 20::DOUBLE)) + 0.25::DOUBLE * greatest(least(1, greatest(0, (pct - 0.50) / 0.30::DOUBLE)), won::INT), 9) FROM p WHERE reception >= 75 OR won)
        SELECT movie_id, bucket FROM w QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY worth DESC, movie_id) <= 500""",
    ),
    "derived_card_summaries": (derived_card_summaries, _SUMMARY),
    "derived_restricted_lookups": (derived_restricted_lookups, f"WITH{C.CARDS}, d AS (SELECT movie_id, list_has_any(source_ids, [1, 4]) AS by_source, list_has_any(lineage_ids, [2, 3]) OR list_has_any(universe_ids, [2, 3]) OR list_contains(subgroup_ids, 0) AS by_franchise, title LIKE '%bolt%' AS by_title, len(list_filter(win_ids, lambda x: x <> 10)) > 0 AS won_any FROM cards) SELECT * FROM d WHERE by_source OR by_franchise OR by_title OR won_any"),
}
