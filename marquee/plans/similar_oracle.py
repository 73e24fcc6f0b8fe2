"""SQL of the similar-item plans, for the oracle."""

from __future__ import annotations

from ..operators import awards as A
from ..operators import derived as D
from ..operators import media as M
from ..operators import similar as L
from ..operators import studios as B
from ..operators.endpoints import RAZZIE
from ..sources import catalogue as C

QUALITY_LISTS = D.QUERIES["derived_quality_candidates"][1].split("w AS (", 1)[1].rsplit("SELECT movie_id, bucket FROM w", 1)[0].rstrip().rstrip(")")


def _values(rows: list[tuple]) -> str:
    return ", ".join(map(str, rows))


def _array(weights: tuple[float, ...]) -> str:
    return "[" + ", ".join(f"{w / sum(weights)}::DOUBLE" for w in weights) + "]"


def _lifts() -> str:
    rows = [(a, b, s, 1.0 if a == b else L.CROSS.get((a, b), L.CROSS.get((b, a), 0.0))) for a in L.STRENGTHS for b, s in L.STRENGTHS.items()]
    return "lifts(class, other, strength, cross_s) AS (VALUES " + ", ".join(f"('{a}', '{b}', {s}::DOUBLE, {c}::DOUBLE)" for a, b, s, c in rows) + ")"


CULT = "least(1, 0.40::DOUBLE * least(1, greatest(0, (50 - reception) / 30)) + 0.50::DOUBLE * least(1, greatest(0, (pct - 0.75) / 0.20::DOUBLE)) + 0.10::DOUBLE * razzie)"
PRESTIGE = "least(1, 0.80::DOUBLE * least(1, greatest(0, (reception - 75) / 20)) + 0.20::DOUBLE * greatest(least(1, greatest(0, (pct - 0.50) / 0.30::DOUBLE)), non_razzie) + 0.20::DOUBLE * non_razzie)"
MIDDLE = "least(1, 0.80::DOUBLE * pct + 0.20::DOUBLE * reception / 100)"


def _base(anchors: list[tuple[int, int]]) -> str:
    return f"""WITH{C.CARDS},{A.AWARD_ROWS},{B.ENTRIES},{C.VECTORS},{C.POSTINGS}, {_lifts()},
anchors(request, movie_id) AS (VALUES {_values(anchors)}),
flags AS (
  SELECT movie_id, bool_or(ceremony <> {RAZZIE} AND won) AS win, bool_or(ceremony <> {RAZZIE} AND NOT won) AS nom, bool_or(ceremony = {RAZZIE} AND won) AS bad, bool_or(ceremony = {RAZZIE} AND NOT won) AS bad_nom,
    bool_or(ceremony <> {RAZZIE} AND list_has_any(tags, [103, 9])) AS picture, bool_or(ceremony = {RAZZIE} AND won AND leaf IN (60, 61)) AS bad_razzie FROM tagged GROUP BY 1),
sig0 AS (
  SELECT cards.*, percent_rank() OVER (ORDER BY votes) AS pct, year(make_timestamp(released * 1000000)) AS year, CASE WHEN win THEN 1::DOUBLE WHEN nom THEN 0.75 ELSE 0 END AS non_razzie,
    CASE WHEN bad THEN 1::DOUBLE WHEN bad_nom THEN 0.75 ELSE 0 END AS razzie, coalesce(picture, false) AS picture, coalesce(bad_razzie, false) AS bad_razzie, release_format = 3 AS short FROM cards LEFT JOIN flags USING (movie_id)),
sig AS (
  SELECT *, CASE WHEN reception <= 45 AND pct >= 0.89 THEN 'cult' WHEN reception >= 85 AND pct >= 0.75 THEN 'prestige' END AS qb,
    CASE WHEN reception <= CASE WHEN bad_razzie THEN 60 ELSE 50 END THEN CASE WHEN votes < 25 THEN 'dogshit' ELSE 'cult_garbage' END
      WHEN reception >= CASE WHEN picture THEN 65 ELSE 80 END THEN CASE WHEN votes < 25 THEN 'hidden_gem' ELSE 'prestige' END WHEN votes >= 45 THEN 'mainstream_blockbuster' END AS class FROM sig0),
lt AS (
  SELECT DISTINCT l_partkey AS movie_id, 'director' AS lane, l_suppkey::VARCHAR AS trait FROM lineitem WHERE l_linenumber = 1
  UNION SELECT movie_id, 'franchise', unnest(lineage_ids || universe_ids || subgroup_ids)::VARCHAR FROM cards
  UNION SELECT movie_id, 'studio', company FROM entries
  UNION SELECT movie_id, 'source', unnest(source_ids)::VARCHAR FROM cards
  UNION SELECT movie_id, 'themes', 'keyword:' || unnest(keyword_ids) FROM cards UNION SELECT movie_id, 'themes', 'genre:' || unnest(genre_ids) FROM cards UNION SELECT movie_id, 'themes', 'tag:' || unnest(tag_ids) FROM cards
  UNION SELECT movie_id, 'country', unnest(language_ids)::VARCHAR FROM cards
  UNION SELECT movie_id, 'quality', qb FROM sig WHERE qb IS NOT NULL
  UNION SELECT movie_id, 'format', release_format::VARCHAR FROM cards
  UNION SELECT movie_id, 'cast', term::VARCHAR FROM postings WHERE position <= 3),
idf AS (SELECT lane, trait, ln((SELECT count(*) FROM cards)::DOUBLE / count(*)) / ln((SELECT count(*) FROM cards)) AS idf FROM lt WHERE lane IN ('themes', 'source') GROUP BY 1, 2),
p AS (SELECT *, len(list_filter(win_ids, lambda x: x <> 10)) > 0 AS won FROM sig),
w AS ({QUALITY_LISTS}),
listed AS (SELECT movie_id, bucket FROM w QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY worth DESC, movie_id) <= 500),
sizes AS (SELECT request, count(DISTINCT movie_id) AS n FROM anchors GROUP BY 1),
shared AS (SELECT request, lane, trait, count(DISTINCT movie_id) AS m FROM anchors JOIN lt USING (movie_id) GROUP BY 1, 2, 3)"""


_SHAPE = """
scored AS (
  SELECT h.request, v.space, v.movie_id, h.w, least(1, list_cosine_similarity(v.vector, h.head)) AS score FROM vectors v JOIN heads h USING (space)
  WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.request = h.request AND a.movie_id = v.movie_id)),
ends AS (
  SELECT *, max(score) OVER (PARTITION BY request, space) AS hi, min(score) OVER (PARTITION BY request, space) AS lo
  FROM (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY request, space ORDER BY score DESC, movie_id) <= 2000)),
raw_shape AS (SELECT request, movie_id, sum(w * CASE WHEN hi = lo THEN 1 ELSE exp(-3 * (hi - score) / (hi - lo)) END) AS x FROM ends GROUP BY 1, 2),
shapes AS (SELECT request, movie_id, least(1, x / max(x) OVER (PARTITION BY request)) AS shape FROM raw_shape)"""
_MET = """
met_themes AS (SELECT request, movie_id, max(idf) AS rarest, sum(idf) FILTER (WHERE idf >= 0.3) AS s FROM recall JOIN lt USING (trait) WHERE lane = 'themes' GROUP BY 1, 2),
recalled AS (SELECT request, movie_id FROM met_themes WHERE round(rarest, 9) >= 0.55 OR round(coalesce(s, 0), 9) >= 0.5)"""
_WORTH = """
worths AS (
  SELECT pairs.request, pairs.movie_id, max(CASE WHEN list_has_any(c.lineage_ids, a.lineage_ids) AND list_has_any(c.subgroup_ids, a.subgroup_ids) THEN 1 WHEN list_has_any(c.lineage_ids, a.lineage_ids) THEN 0.70
      WHEN list_has_any(c.subgroup_ids, a.subgroup_ids) AND list_has_any(c.universe_ids, a.universe_ids) THEN 0.55 WHEN list_has_any(c.universe_ids, a.universe_ids) THEN 0.30 ELSE 0 END::DOUBLE) AS worth,
    bool_or(list_has_any(c.lineage_ids || c.universe_ids, a.lineage_ids || a.universe_ids)) AS kin
  FROM pairs JOIN cards c USING (movie_id) JOIN anchors x ON x.request = pairs.request JOIN cards a ON a.movie_id = x.movie_id GROUP BY 1, 2)"""


def one_sql(anchors: list[tuple[int, int]]) -> str:
    kind = lambda lane: " + ".join(
        [f"{L.LANES[lane]}::DOUBLE" if lane != "quality" else f"CASE WHEN a.qb IS NULL THEN {L.MIDDLE_QUALITY} ELSE {L.LANES['quality']} END::DOUBLE"]
        + [f"CASE WHEN {on} THEN {L.ADJUSTMENTS[k].get(lane, 0.0)}::DOUBLE ELSE 0 END" for k, on in (("cult", "coalesce(a.qb = 'cult', false)"), ("prestige", "coalesce(a.qb = 'prestige', false)"), ("franchise", "len(a.lineage_ids) > 0"), ("source", "len(a.source_ids) > 0"))]
    )
    raw = {lane: f"greatest({kind(lane)}, 0)" for lane in L.SINGLE_LANES}
    total = "(" + " + ".join(raw.values()) + ")"
    summed = " + ".join(f"{w} * {lane}" for lane, w in raw.items())
    return f"""{_base(anchors)},
heads AS (SELECT request, space, vector AS head, {_array(L.SPACE_WEIGHTS)}[space + 1] AS w FROM anchors JOIN vectors USING (movie_id)),{_SHAPE},
wanted AS (SELECT request, trait, idf FROM shared JOIN idf USING (lane, trait) WHERE lane = 'themes'), recall AS (SELECT * FROM wanted),{_MET},
directed AS (SELECT DISTINCT request, lt.movie_id FROM shared JOIN lt USING (lane, trait) WHERE lane = 'director' AND trait::BIGINT % 5 = 0),
sources AS (SELECT request, movie_id, max(idf) AS source FROM shared JOIN lt USING (lane, trait) JOIN idf USING (lane, trait) WHERE lane = 'source' GROUP BY 1, 2),
studios AS (
  SELECT a.request, e.movie_id, max(least(e.worth, o.worth) * CASE WHEN e.era_bound OR o.era_bound THEN 0.6::DOUBLE + 0.4::DOUBLE * exp(-abs(e.year - o.year) / 18::DOUBLE) ELSE 1 END) AS studio
  FROM anchors a JOIN entries o USING (movie_id) JOIN entries e ON e.company = o.company GROUP BY 1, 2),
pairs AS (
  SELECT * FROM (
    SELECT request, movie_id FROM shapes UNION SELECT request, movie_id FROM directed UNION SELECT request, movie_id FROM sources UNION SELECT request, lt.movie_id FROM shared JOIN lt USING (lane, trait) WHERE lane = 'franchise'
    UNION SELECT request, l.movie_id FROM anchors JOIN sig USING (movie_id) JOIN listed l ON bucket = qb UNION SELECT request, movie_id FROM studios UNION SELECT request, movie_id FROM recalled) u
  WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.request = u.request AND a.movie_id = u.movie_id)),{_WORTH},
themed AS (SELECT request, movie_id, sum(idf) AS s, coalesce(sum(idf) FILTER (WHERE idf >= 0.3), 0) AS rarer, bool_or(idf >= 0.55) AS rare FROM wanted JOIN lt USING (trait) WHERE lane = 'themes' GROUP BY 1, 2),
mass AS (SELECT request, greatest(1, sum(idf)) AS mass FROM wanted GROUP BY 1),
agreed AS (SELECT DISTINCT request, lt.movie_id FROM shared JOIN lt USING (lane, trait) WHERE lane = 'country'),
lanes AS (
  SELECT pr.request, s.movie_id, coalesce(shape, 0) AS shape, worth AS franchise, coalesce(source, 0) AS source, CASE a.qb WHEN 'cult' THEN {CULT.replace("reception", "s.reception").replace("pct", "s.pct").replace("razzie", "s.razzie").replace("non_s.razzie", "s.non_razzie")}
      WHEN 'prestige' THEN {PRESTIGE.replace("reception", "s.reception").replace("pct", "s.pct").replace("non_razzie", "s.non_razzie")} ELSE {MIDDLE.replace("reception", "s.reception").replace("pct", "s.pct")} END AS quality,
    (s.release_format = a.release_format)::INT::DOUBLE AS format, coalesce(CASE WHEN t.s > 0 THEN least(1, t.s / mass * (1 + 0.5::DOUBLE * greatest(0, rarer - 0.3))) END, 0) AS themes, coalesce(studio, 0) AS studio,
    d.movie_id IS NOT NULL AS director, CASE WHEN g.movie_id IS NOT NULL THEN 1.05 WHEN EXISTS (SELECT 1 FROM shared c WHERE c.request = pr.request AND c.lane = 'country') THEN 0.75 ELSE 1 END::DOUBLE AS country,
    {M.sql_factor("a.keyword_ids", "s.keyword_ids")} AS medium, s.short, a.short AS a_short, kin, coalesce(t.rare, false) AS rare, s.class, a.class AS a_class, a.qb, a.lineage_ids AS a_lineage, a.source_ids AS a_source
  FROM pairs pr JOIN sig s USING (movie_id) JOIN anchors x ON x.request = pr.request JOIN sig a ON a.movie_id = x.movie_id LEFT JOIN worths wo ON wo.request = pr.request AND wo.movie_id = s.movie_id
    LEFT JOIN shapes sh ON sh.request = pr.request AND sh.movie_id = s.movie_id LEFT JOIN sources so ON so.request = pr.request AND so.movie_id = s.movie_id LEFT JOIN themed t ON t.request = pr.request AND t.movie_id = s.movie_id
    LEFT JOIN mass ON mass.request = pr.request LEFT JOIN studios st ON st.request = pr.request AND st.movie_id = s.movie_id LEFT JOIN directed d ON d.request = pr.request AND d.movie_id = s.movie_id
    LEFT JOIN agreed g ON g.request = pr.request AND g.movie_id = s.movie_id),
final AS (
  SELECT lanes.*, greatest(({summed.replace("a.lineage_ids", "a_lineage").replace("a.source_ids", "a_source").replace("a.qb", "qb")}) / {total.replace("a.lineage_ids", "a_lineage").replace("a.source_ids", "a_source").replace("a.qb", "qb")}
    * CASE WHEN shape >= 0.6 THEN 1 + 0.1::DOUBLE * studio ELSE 1 END * CASE WHEN shape >= 0.3 AND director THEN 1.3::DOUBLE ELSE 1 END * country * medium * CASE WHEN format = 1 OR short THEN 1 ELSE 0.35::DOUBLE END
    * CASE WHEN short AND NOT a_short THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN cross_s >= 0.5 THEN 1 + strength * cross_s ELSE 1 END, CASE WHEN director AND shape >= 0.2 THEN 0.35::DOUBLE ELSE 0 END) AS score
  FROM lanes LEFT JOIN lifts ON lifts.class = a_class AND lifts.other = lanes.class)
SELECT request, movie_id, {", ".join(f"round({c}, 6) AS {c}" for c in L.SINGLE_LANES)}, round(score, 6) AS score, kin, director,
  array_to_string(list_filter([CASE WHEN director THEN 'auteur' END, CASE WHEN franchise >= 0.55 THEN 'franchise' END, CASE WHEN rare THEN 'rare_keyword' END], lambda x: x IS NOT NULL), ',') AS buckets FROM final"""


def many_sql(anchors: list[tuple[int, int]], last: str) -> str:
    names = ("director", "franchise", "studio", "source", "quality", "themes", "format", "cast")
    tied = ", ".join(f"coalesce((SELECT CASE WHEN max(m) >= 2 THEN 2 * ln(1 + 9 * max(m)::DOUBLE / sizes.n) / ln(10) ELSE 0 END FROM shared s WHERE s.request = sizes.request AND s.lane = '{c}'), 0) AS c_{c}" for c in names)
    raw = {
        "shape": "0.6::DOUBLE * (1 + least(1, greatest(-0.4, (cosine - 0.55) / 0.30::DOUBLE)))",
        "franchise": "0.12::DOUBLE * c_franchise",
        "source": "0.04::DOUBLE * c_source",
        "quality": "CASE WHEN a_quality IS NULL THEN 0.03::DOUBLE ELSE 0.06 END * c_quality",
        "format": "0.04::DOUBLE * c_format",
        "themes": "0.12::DOUBLE * c_themes",
        "cast": "CASE WHEN lead_ratio IS NULL THEN 0 ELSE 0.05::DOUBLE + 0.10::DOUBLE * lead_ratio END",
        "specific_award": "0.04::DOUBLE * c_specific_award",
    }
    total = " + ".join(raw.values())
    on = lambda lane, x: f"CASE WHEN c_{lane} > 0 THEN coalesce({x}, 0) ELSE 0 END"
    sharing = lambda lane, x: f"""
share_{lane} AS (
  SELECT request, movie_id, sum(x) / any_value(n) AS {lane} FROM (
    SELECT a.request, c.movie_id, a.movie_id AS anchor, {x} AS x FROM anchors a JOIN lt l ON l.movie_id = a.movie_id AND l.lane = '{lane}' JOIN lt c ON c.lane = l.lane AND c.trait = l.trait
      LEFT JOIN idf ON idf.lane = l.lane AND idf.trait = l.trait GROUP BY 1, 2, 3) JOIN sizes USING (request) GROUP BY 1, 2)"""  # noqa: E731
    return f"""{_base(anchors)},
u AS (SELECT request, space, movie_id, [x / sqrt(list_sum([y * y FOR y IN vector])) FOR x IN vector] AS u FROM anchors JOIN vectors USING (movie_id)),
h AS (SELECT * FROM u WHERE (request, space) IN (SELECT (request, space) FROM u JOIN sizes USING (request) GROUP BY request, space, n HAVING count(*) = n)),
mean AS (SELECT request, space, list(x ORDER BY i) AS head FROM (SELECT request, space, i, avg(u[i]) AS x FROM h, range(1, {C.DIMS + 1}) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
close AS (SELECT a.request, a.space, avg(list_dot_product(a.u, b.u)) AS c FROM h a JOIN h b ON a.request = b.request AND a.space = b.space AND a.movie_id < b.movie_id GROUP BY 1, 2),
tied AS (SELECT request, space, c, 0.75 * least(greatest((c - 0.55) / 0.30, 0.10), 1) + 0.25 * {_array(L.SPACE_WEIGHTS_MULTI)}[space + 1] AS w FROM close),
heads AS (SELECT request, space, head, w / sum(w) OVER (PARTITION BY request) AS w FROM mean JOIN tied USING (request, space)),{_SHAPE},
had AS (SELECT DISTINCT movie_id, unnest(tags) AS tag FROM tagged),
rep AS (SELECT request, tag, count(DISTINCT movie_id) AS m, CASE WHEN tag >= 10000 THEN 2 WHEN tag >= 100 THEN 1 ELSE 0 END AS level FROM anchors JOIN had USING (movie_id) GROUP BY 1, 2 HAVING m >= 2),
spec AS (SELECT request, (CASE level WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6 ELSE 0.3 END) * 2 * ln(1 + 9 * max(m)::DOUBLE / n) / ln(10) AS c FROM rep JOIN sizes USING (request) WHERE level = (SELECT min(level) FROM rep r WHERE r.request = rep.request) GROUP BY request, level, n),
tier AS (SELECT request, tag, (CASE level WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.2 END) AS t FROM rep),
award AS (SELECT request, movie_id, least(1, sum(t) / (SELECT sum(t) FROM tier x WHERE x.request = tier.request)) AS specific_award FROM tier JOIN had USING (tag) GROUP BY 1, 2),
leads AS (SELECT request, trait, m, n FROM shared JOIN sizes USING (request) WHERE lane = 'cast' AND m >= 2),
asked AS (
  SELECT request, n, coalesce((SELECT avg(c) FROM close x WHERE x.request = sizes.request), 0) AS cosine, {tied}, coalesce((SELECT c FROM spec x WHERE x.request = sizes.request), 0) AS c_specific_award,
    (SELECT trait FROM shared s WHERE s.request = sizes.request AND lane = 'quality' AND m >= 2 ORDER BY m DESC, trait DESC LIMIT 1) AS a_quality, (SELECT max(m) FROM shared s WHERE s.request = sizes.request AND lane = 'quality') AS most_quality,
    (SELECT trait FROM shared s WHERE s.request = sizes.request AND lane = 'format' AND m >= 2 ORDER BY m DESC, trait DESC LIMIT 1) AS a_format,
    (SELECT count(*) FROM leads x WHERE x.request = sizes.request) AS lead_n, (SELECT max(m)::DOUBLE / max(n) FROM leads x WHERE x.request = sizes.request) AS lead_ratio,
    coalesce((SELECT m FROM shared s WHERE s.request = sizes.request AND lane = 'format' AND trait = '3'), 0)::DOUBLE / n >= 0.5 AS shorts FROM sizes),
weighted AS (SELECT *, {", ".join(f"({x}) / ({total}) AS w_{lane}" for lane, x in raw.items())} FROM asked),
drawn AS (SELECT DISTINCT request FROM shared WHERE lane = 'director' AND trait::BIGINT % 5 = 0),
gates AS (SELECT request, lane FROM weighted, (SELECT unnest(['director', 'franchise', 'studio', 'source']) AS lane)
  WHERE CASE lane WHEN 'director' THEN c_director > 0 OR request IN (SELECT request FROM drawn) WHEN 'franchise' THEN c_franchise > 0 WHEN 'studio' THEN c_studio > 0 ELSE c_source > 0 END),
rarity AS (SELECT request, trait, m, n, idf FROM shared JOIN idf USING (lane, trait) JOIN sizes USING (request) WHERE lane = 'themes'),
recall AS (SELECT request, trait, idf FROM rarity WHERE m::DOUBLE / n >= CASE WHEN idf < 0.3 THEN 1 WHEN idf < 0.55 THEN 0.67 ELSE 0.5 END),{_MET},
quality_of AS (SELECT request, movie_id FROM weighted JOIN listed ON bucket = a_quality),
pairs AS (
  SELECT * FROM (
    SELECT request, movie_id FROM shapes UNION SELECT s.request, lt.movie_id FROM shared s JOIN gates g ON g.request = s.request AND g.lane = s.lane JOIN lt ON lt.lane = s.lane AND lt.trait = s.trait
    UNION SELECT request, movie_id FROM quality_of UNION SELECT request, movie_id FROM recalled) x
  WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.request = x.request AND a.movie_id = x.movie_id)),{_WORTH},{sharing("franchise", "1")},{sharing("studio", "1")},{sharing("source", "max(idf)")},
repeated AS (SELECT request, trait, idf FROM rarity WHERE m >= 2),
themed AS (SELECT request, movie_id, sum(idf) AS s, coalesce(sum(idf) FILTER (WHERE idf >= 0.3), 0) AS rarer, bool_or(idf >= 0.55) AS rare FROM repeated JOIN lt USING (trait) WHERE lane = 'themes' GROUP BY 1, 2),
mass AS (SELECT request, sum(idf) AS mass FROM repeated GROUP BY 1),
dirs AS (
  SELECT s.request, lt.movie_id, max(CASE WHEN trait::BIGINT % 5 = 0 THEN 0.67::DOUBLE + 0.33::DOUBLE * m / n WHEN m >= 2 THEN 0.33::DOUBLE * m / n ELSE 0 END) AS directed,
    max(CASE WHEN m >= 2 OR trait::BIGINT % 5 = 0 THEN m::DOUBLE / n END) AS ratio, bool_or(trait::BIGINT % 5 = 0) AS auteur
  FROM shared s JOIN sizes USING (request) JOIN gates g ON g.request = s.request AND g.lane = 'director' JOIN lt USING (trait) WHERE s.lane = 'director' AND lt.lane = 'director' GROUP BY 1, 2),
starred AS (SELECT request, movie_id, count(DISTINCT trait) AS hits, bool_or(m = (SELECT max(m) FROM leads x WHERE x.request = leads.request)) AS top_lead FROM leads JOIN lt USING (trait) WHERE lane = 'cast' GROUP BY 1, 2),
agreed AS (SELECT DISTINCT request, lt.movie_id FROM shared JOIN lt USING (lane, trait) WHERE lane = 'country' AND m >= 2),
shares AS (SELECT request, class, count(DISTINCT movie_id)::DOUBLE / n AS share FROM anchors JOIN sig USING (movie_id) JOIN sizes USING (request) WHERE class IS NOT NULL GROUP BY request, class, n),
lifted AS (SELECT request, other, 1 + strength * sum(share * cross_s) AS lift FROM shares JOIN lifts USING (class) GROUP BY request, other, strength HAVING sum(share * cross_s) >= 0.5),
lanes AS (
  SELECT a.*, s.movie_id, s.pct, coalesce(shape, 0) AS shape, {on("franchise", "sf.franchise")} AS franchise, {on("studio", "ss.studio")} AS studio, {on("source", "so.source")} AS source,
    CASE WHEN q.movie_id IS NULL THEN 0 ELSE {on("quality", "most_quality::DOUBLE / n")} * CASE WHEN s.qb IS NOT DISTINCT FROM a_quality THEN 1 WHEN a_quality = 'cult' THEN {CULT} ELSE {PRESTIGE} END END AS quality,
    coalesce((s.release_format::VARCHAR = a_format)::INT, 0)::DOUBLE AS format, coalesce(CASE WHEN t.s > 0 THEN least(1, t.s / mass * (1 + 0.5::DOUBLE * greatest(0, rarer - 0.3))) END, 0) AS themes,
    coalesce(hits::DOUBLE / lead_n, 0) AS "cast", coalesce(specific_award, 0) AS specific_award, coalesce(directed, 0) AS directed, coalesce(ratio, 0) AS ratio, coalesce(auteur, false) AS auteur,
    CASE WHEN g.movie_id IS NOT NULL THEN 1.05 WHEN EXISTS (SELECT 1 FROM shared c WHERE c.request = pr.request AND c.lane = 'country' AND c.m >= 2) THEN 0.75 ELSE 1 END::DOUBLE AS country, coalesce(lift, 1) AS lift,
    s.short, coalesce(hits, 0) AS hits, coalesce(top_lead, false) AS top_lead, coalesce(t.rare, false) AS rare, worth
  FROM pairs pr JOIN sig s USING (movie_id) JOIN weighted a ON a.request = pr.request LEFT JOIN worths wo ON wo.request = pr.request AND wo.movie_id = s.movie_id LEFT JOIN shapes sh ON sh.request = pr.request AND sh.movie_id = s.movie_id
    LEFT JOIN share_franchise sf ON sf.request = pr.request AND sf.movie_id = s.movie_id LEFT JOIN share_studio ss ON ss.request = pr.request AND ss.movie_id = s.movie_id LEFT JOIN share_source so ON so.request = pr.request AND so.movie_id = s.movie_id
    LEFT JOIN themed t ON t.request = pr.request AND t.movie_id = s.movie_id LEFT JOIN mass ON mass.request = pr.request LEFT JOIN dirs d ON d.request = pr.request AND d.movie_id = s.movie_id
    LEFT JOIN starred st ON st.request = pr.request AND st.movie_id = s.movie_id LEFT JOIN award aw ON aw.request = pr.request AND aw.movie_id = s.movie_id LEFT JOIN agreed g ON g.request = pr.request AND g.movie_id = s.movie_id
    LEFT JOIN lifted li ON li.request = pr.request AND li.other = s.class LEFT JOIN quality_of q ON q.request = pr.request AND q.movie_id = s.movie_id),
final AS (
  SELECT *, worth >= 0.55 AND c_franchise > 0 AS member, greatest(({" + ".join(f'w_{lane} * "{lane}"' for lane in raw)}) * CASE WHEN shape >= 0.6 THEN 1 + 0.1::DOUBLE * studio ELSE 1 END * CASE WHEN shape >= 0.3 THEN 1 + 0.3::DOUBLE * directed ELSE 1 END
    * country * CASE WHEN a_format IS NULL OR format = 1 OR short THEN 1 ELSE 0.35::DOUBLE END * CASE WHEN NOT short THEN 1 WHEN shorts THEN 1.1::DOUBLE ELSE 0.3 END * lift,
    CASE WHEN hits > 0 AND lead_ratio >= 0.5 AND shape >= 0.2 THEN 0.25::DOUBLE + 0.2::DOUBLE * lead_ratio ELSE 0 END, CASE WHEN ratio >= 0.75 AND shape >= 0.3 THEN 0.35::DOUBLE ELSE 0 END) AS score FROM lanes)
{last}"""


MANY_SCORES = """SELECT request, movie_id, round(shape, 6) AS shape, round(franchise, 6) AS franchise, round(source, 6) AS source, round(quality, 6) AS quality, round(format, 6) AS format, round(themes, 6) AS themes, round("cast", 6) AS "cast",
  round(specific_award, 6) AS specific_award, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN auteur THEN 'auteur' END, CASE WHEN member THEN 'franchise' END,
    CASE WHEN lead_ratio >= 0.5 AND top_lead THEN 'lead_actor' END, CASE WHEN rare THEN 'rare_keyword' END], lambda x: x IS NOT NULL), ',') AS buckets FROM final"""
MANY_SIGNALS = """SELECT request, 'auteur' AS bucket, round(count(DISTINCT movie_id)::DOUBLE / n, 6) AS signal FROM anchors JOIN lt USING (movie_id) JOIN sizes USING (request) WHERE lane = 'director' AND trait::BIGINT % 5 = 0 GROUP BY request, n
UNION ALL SELECT request, 'franchise', round(least(1, count(*) / 5::DOUBLE) * max(pct) * any_value(s), 6) FROM final JOIN (SELECT request, count(DISTINCT movie_id)::DOUBLE / n AS s FROM anchors JOIN cards USING (movie_id) JOIN sizes USING (request) WHERE len(lineage_ids) > 0 GROUP BY request, n) USING (request) WHERE member GROUP BY request
UNION ALL SELECT request, 'rare_keyword', round(least(1, sum(idf * (m - 1) / greatest(1, n - 1))), 6) FROM rarity WHERE idf >= 0.55 AND m > 1 GROUP BY request
UNION ALL SELECT request, 'lead_actor', round(lead_ratio, 6) FROM weighted WHERE lead_ratio >= 0.5"""
