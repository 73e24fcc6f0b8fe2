"""Texts of the vector spaces, routed keywords, and fields of source documents in JSON, as expressions.

A space's text is lines of a label and its terms; empty sections have no line, and an item without any line has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import catalogue as C

# Labels of the spaces in their order, and names of the ceremonies in the order of their weight.
PLOT_TERMS = ("genre_signatures", "conflict", "themes", "character_arcs")
NARRATIVE = ("narrative_archetype", "narrative_delivery", "pov_perspective", "characterization_methods", "character_arcs", "audience_character_perception", "information_control", "conflict_stakes_design", "additional_narrative_devices")
EXPERIENCE = ("emotional_palette", "tension_adrenaline", "tone_self_seriousness", "cognitive_complexity", "disturbance_profile", "sensory_load", "emotional_volatility", "ending_aftertaste")
WATCHING = ("self_experience_motivations", "external_motivations", "key_movie_feature_draws", "watch_scenarios")
CEREMONIES = {1: "academy awards", 2: "golden globes", 3: "bafta", 4: "cannes", 5: "venice", 6: "berlin", 7: "sag", 8: "critics choice", 9: "sundance", 11: "spirit awards", 12: "gotham awards"}

EDGES = "array<struct<node:struct<award:struct<event:struct<text:string>,text:string,year:string>,isWinner:boolean,category:struct<text:string>>>>"
RELEASES = "struct<release_dates:struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>>"
REVIEWS = "struct<reviews:struct<results:array<struct<content:string>>>>"


def terms_line(label: str, terms: Column, clean=T.normalize_ascii) -> Column:
    """`label: a, b`, or null without terms. clean: the lookup form of a term; T.normalize for texts beyond ASCII."""
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(terms, clean), ", ")))


def prose_line(label: str, text: Column) -> Column:
    """Prose is lower-cased and keeps its punctuation."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.lower(text)))


def lines(*parts: Column) -> Column:
    whole = F.concat_ws("\n", *parts)
    return F.when(whole != "", whole)


def plot_analysis_text(pitch: Column, overview: Column, terms: dict[str, Column]) -> Column:
    return lines(prose_line("elevator_pitch", pitch), prose_line("plot_overview", overview), *[terms_line(c, terms[c]) for c in PLOT_TERMS if c in terms])


def sections_text(order: tuple[str, ...], terms: dict[str, Column], negations: dict[str, Column] | None = None) -> Column:
    """Lines of sections in their order, each followed by what it rules out."""
    parts = []
    for label in order:
        parts += [terms_line(label, terms[label])] if label in terms else []
        parts += [terms_line(f"{label}_negations", negations[label])] if negations and label in negations else []
    return lines(*parts)


def award_wins_line(won: Column) -> Column:
    """Ceremonies of which an item has won something, by their weight; others and ceremony 10 are left out."""
    names = F.filter(F.array(*[F.when(F.array_contains(won, c), F.lit(n)) for c, n in CEREMONIES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.concat(F.lit("major_award_wins: "), F.array_join(names, ", ")))


def reception_text(summary: Column, praised: Column, criticized: Column, won: Column) -> Column:
    """Null without a summary, whatever else is known."""
    return F.when(summary.isNotNull(), F.concat_ws("\n", F.concat(F.lit("reception_summary: "), F.lower(summary)), terms_line("praised", praised), terms_line("criticized", criticized), award_wins_line(won)))


def routed_keywords(plot: Column, overall: Column) -> tuple[Column, Column, Column]:
    """Distinct lower-cased, trimmed keywords of the plot, of the whole, and of both, in their order."""
    clean = lambda k: F.array_distinct(F.transform(k, lambda x: F.trim(F.lower(x))))
    return clean(plot), clean(overall), F.array_distinct(F.concat(clean(plot), clean(overall)))


def us_certificate(document: Column) -> Column:
    """The first certificate that is not blank, of the US entries of a JSON document; null if there is none or the document is broken."""
    entries = F.filter(F.from_json(document, RELEASES)["release_dates"]["results"], lambda e: e["iso_3166_1"] == "US")
    marks = F.flatten(F.transform(entries, lambda e: F.transform(e["release_dates"], lambda d: F.trim(d["certification"]))))
    return F.get(F.filter(marks, lambda m: F.coalesce(m, F.lit("")) != ""), 0)


def review_contents(document: Column) -> Column:
    """Bodies of the reviews of a JSON document, without empty ones; null if there are none."""
    bodies = F.filter(F.transform(F.from_json(document, REVIEWS)["reviews"]["results"], lambda r: r["content"]), lambda b: F.coalesce(b, F.lit("")) != "")
    return F.when(F.size(bodies) > 0, bodies)


def award_edges(d: DataFrame, document: str, ceremonies: list[str]) -> DataFrame:
    """(movie_id, ceremony, award_name, category, won, year) of the JSON array of award edges in a column.

    Rows of other ceremonies, without a prize's name or without a whole year are left out; a blank category is null.
    """
    edges = d.select("movie_id", F.explode(F.from_json(document, EDGES)).alias("e")).select("movie_id", "e.node.*")
    name, year = F.trim("award.text"), F.expr("try_cast(award.year AS int)")
    rows = edges.select("movie_id", F.trim("award.event.text").alias("ceremony"), name.alias("award_name"), F.nullif(F.trim("category.text"), F.lit("")).alias("category"), F.coalesce("isWinner", F.lit(False)).alias("won"), year.alias("year"))
    return rows.where(F.col("ceremony").isin(ceremonies) & (F.coalesce("award_name", F.lit("")) != "") & F.col("year").isNotNull())


# Registered queries: records are made from the columns of parts and cards.


def space_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the five other spaces of every card."""
    d = C.cards(spark, sf_dir).join(C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), "p_type"), "movie_id")
    words, kinds = F.split("title", " "), F.split("p_type", " ")
    some = lambda on, c: F.when(on, c)
    few, many = F.size("keyword_ids") < 12, F.size("genre_ids") > 4
    plot = plot_analysis_text(some(few, F.col("title")), F.col("p_type"), {"genre_signatures": kinds, "conflict": some(many, F.slice(words, 1, 1)), "themes": words})
    narrative = sections_text(NARRATIVE, {"narrative_archetype": some(few, kinds), "pov_perspective": some(many, words), "information_control": F.array(F.col("company"))})
    experience = sections_text(EXPERIENCE, {"emotional_palette": words, "sensory_load": some(few, kinds)}, {"emotional_palette": some(many, kinds), "ending_aftertaste": F.slice(words, 2, 1)})
    watching = sections_text(WATCHING, {"external_motivations": some(few, words), "watch_scenarios": some(many, kinds)})
    reception = reception_text(some(F.col("reception") < 60, F.col("title")), some(few, words), some(many, kinds), F.col("win_ids"))
    return d.select("movie_id", plot.alias("plot_analysis"), narrative.alias("narrative"), experience.alias("experience"), watching.alias("watching"), reception.alias("reception"))


def keyword_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of titles and types as the two lists of keywords, with repeats, case and blanks."""
    d = C.table(spark, sf_dir, "part")
    plot, overall, both = routed_keywords(F.concat(F.split("p_name", " "), F.array(F.upper("p_type"))), F.concat(F.array(F.concat(F.lit(" "), "p_type", F.lit(" "))), F.split("p_name", " "), F.split("p_brand", "#")))
    return d.select(F.col("p_partkey").alias("movie_id"), *[F.array_join(c, "|").alias(n) for c, n in ((plot, "plot"), (overall, "overall"), (both, "both"))])


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates and reviews out of JSON documents, some without a US entry, with blanks, or broken."""
    m, s = F.col("p_partkey"), F.col("p_size")
    entry = lambda land, mark: F.struct(F.lit(land).alias("iso_3166_1"), F.array(F.struct(F.lit(" ").alias("certification")), F.struct(mark.alias("certification"))).alias("release_dates"))
    mark = F.when(s % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" PG-"), (s % 9).cast("string"), F.lit(" ")))
    land = F.when(m % 5 == 0, F.array(entry("GB", F.lit("15")))).otherwise(F.array(entry("GB", F.lit("15")), entry("US", mark)))
    body = F.array(F.struct(F.when(m % 3 != 0, F.col("p_name")).alias("content")), F.struct(F.when(m % 4 == 0, F.lit("")).otherwise(F.col("p_type")).alias("content")))
    whole = F.to_json(F.struct(F.struct(land.alias("results")).alias("release_dates"), F.struct(body.alias("results")).alias("reviews")))
    document = F.when(m % 13 == 0, F.lit('{"release_dates": [')).otherwise(whole)
    return C.table(spark, sf_dir, "part").select(m.alias("movie_id"), us_certificate(document).alias("certificate"), F.array_join(review_contents(document), "|").alias("reviews"))


AWARDS_KNOWN = ["Event 1", "Event 2", "Event 3", "Event 4", "Event 5"]


def award_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards out of JSON edges made of the lines of each item."""
    line = C.table(spark, sf_dir, "lineitem")
    year = F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.year("l_shipdate").cast("string"))
    award = F.struct(F.struct(F.concat(F.lit(" Event "), (F.col("l_suppkey") % 8).cast("string")).alias("text")).alias("event"), F.when(F.col("l_linenumber") != 2, F.concat(F.lit("Prize "), F.col("l_linenumber").cast("string"))).alias("text"), year.alias("year"))
    category = F.struct(F.when(F.col("l_quantity") > 25, F.lit(" Best ")).otherwise(" ").alias("text"))
    edge = F.struct(F.struct(award.alias("award"), (F.col("l_returnflag") == "A").alias("isWinner"), category.alias("category")).alias("node"))
    documents = line.groupBy(F.col("l_partkey").alias("movie_id")).agg(F.to_json(F.collect_list(edge)).alias("edges"))
    rows = award_edges(documents, "edges", AWARDS_KNOWN)
    return rows.groupBy("ceremony", "award_name", "category", "won", "year").agg(F.count(F.lit(1)).alias("n"))


_N = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''ʼ`.]', '', 'g'), '[^\\w\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_L = lambda label, terms: f"CASE WHEN len({terms}) > 0 THEN '{label}: ' || array_to_string([{_N('x')} FOR x IN {terms}], ', ') END"
_SPACES = f"""WITH{C.CARDS}, d AS (SELECT cards.*, string_split(title, ' ') AS w, string_split(p_type, ' ') AS k, p_type, len(keyword_ids) < 12 AS few, len(genre_ids) > 4 AS many FROM cards JOIN part ON p_partkey = movie_id)
SELECT movie_id,
  nullif(concat_ws(chr(10), CASE WHEN few THEN 'elevator_pitch: ' || lower(title) END, 'plot_overview: ' || lower(p_type), {_L("genre_signatures", "k")}, CASE WHEN many THEN {_L("conflict", "w[1:1]")} END, {_L("themes", "w")}), '') AS plot_analysis,
  nullif(concat_ws(chr(10), CASE WHEN few THEN {_L("narrative_archetype", "k")} END, CASE WHEN many THEN {_L("pov_perspective", "w")} END, {_L("information_control", "[company]")}), '') AS narrative,
  nullif(concat_ws(chr(10), {_L("emotional_palette", "w")}, CASE WHEN many THEN {_L("emotional_palette_negations", "k")} END, CASE WHEN few THEN {_L("sensory_load", "k")} END, {_L("ending_aftertaste_negations", "w[2:2]")}), '') AS experience,
  nullif(concat_ws(chr(10), CASE WHEN few THEN {_L("external_motivations", "w")} END, CASE WHEN many THEN {_L("watch_scenarios", "k")} END), '') AS watching,
  CASE WHEN reception < 60 THEN concat_ws(chr(10), 'reception_summary: ' || lower(title), CASE WHEN few THEN {_L("praised", "w")} END, CASE WHEN many THEN {_L("criticized", "k")} END,
    'major_award_wins: ' || nullif(array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(win_ids, {c}) THEN '{n}' END" for c, n in CEREMONIES.items())}], lambda x: x IS NOT NULL), ', '), '')) END AS reception FROM d"""
_FIRST = lambda c: f"[x FOR x, i IN {c} IF list_position({c}, x) = i]"
_ROUTES = f"""WITH d AS (
  SELECT p_partkey AS movie_id, [lower(trim(x)) FOR x IN string_split(p_name, ' ') || [upper(p_type)]] AS a, [lower(trim(x)) FOR x IN [p_type] || string_split(p_name, ' ') || string_split(p_brand, '#')] AS b FROM part),
e AS (SELECT movie_id, {_FIRST("a")} AS a, {_FIRST("b")} AS b, a || b AS c FROM d)
SELECT movie_id, array_to_string(a, '|') AS plot, array_to_string(b, '|') AS overall, array_to_string({_FIRST("c")}, '|') AS both FROM e"""
QUERIES = {
    "space_texts": (space_texts, _SPACES),
    "keyword_routes": (keyword_routes, _ROUTES),
    "source_documents": (
        source_documents,
        """SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 5 <> 0 AND p_size % 4 <> 0 THEN 'PG-' || p_size % 9 END AS certificate,
        CASE WHEN p_partkey % 13 <> 0 THEN nullif(concat_ws('|', CASE WHEN p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 4 <> 0 THEN p_type END), '') END AS reviews FROM part""",
    ),
    "award_documents": (
        award_documents,
        """SELECT 'Event ' || l_suppkey % 8 AS ceremony, 'Prize ' || l_linenumber AS award_name, CASE WHEN l_quantity > 25 THEN 'Best' END AS category, l_returnflag = 'A' AS won, year(l_shipdate) AS year, count(*) AS n
        FROM lineitem WHERE l_suppkey % 8 BETWEEN 1 AND 5 AND l_linenumber NOT IN (2, 3) GROUP BY 1, 2, 3, 4, 5""",
    ),
}
