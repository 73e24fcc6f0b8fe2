"""Texts of the spaces and fields of JSON documents by example: blanks, nulls, broken and partial documents."""

from pyspark.sql import functions as F

from marquee.operators import spaces as S


def test_sections_without_terms_have_no_line(spark):
    d = spark.createDataFrame([(1, ["Slow-Burn!", "L.A. Noir"], []), (2, [], None), (3, None, ["Gore"])], "id int, a array<string>, b array<string>")
    got = {r.id: r.t for r in d.select("id", S.sections_text(S.EXPERIENCE, {"emotional_palette": F.col("a")}, {"emotional_palette": F.col("b")}).alias("t")).collect()}
    assert got == {1: "emotional_palette: slow-burn, la noir", 2: None, 3: "emotional_palette_negations: gore"}
    prose = d.select(S.plot_analysis_text(F.lit("A Man. A Plan!"), F.lit(""), {"themes": F.col("a"), "conflict": F.col("b")}).alias("t")).collect()
    assert [r.t for r in prose] == ["elevator_pitch: a man. a plan!\nthemes: slow-burn, la noir", "elevator_pitch: a man. a plan!", "elevator_pitch: a man. a plan!\nconflict: gore"]


def test_award_wins_go_by_weight_and_leave_out_the_razzie(spark):
    d = spark.createDataFrame([(1, [12, 10, 3, 1]), (2, [10]), (3, []), (4, None)], "id int, won array<int>")
    got = {r.id: r.t for r in d.select("id", S.award_wins_line(F.col("won")).alias("t")).collect()}
    assert got == {1: "major_award_wins: academy awards, bafta, gotham awards", 2: None, 3: None, 4: None}
    whole = d.select("id", S.reception_text(F.when(F.col("id") < 3, F.lit("Loved.")), F.array(F.lit("Wit")), F.array().cast("array<string>"), F.col("won")).alias("t")).collect()
    assert [r.t for r in whole] == ["reception_summary: loved.\npraised: wit\nmajor_award_wins: academy awards, bafta, gotham awards", "reception_summary: loved.\npraised: wit", None, None]


def test_keywords_are_routed_once(spark):
    d = spark.createDataFrame([([" War", "war", "Ship "], ["SHIP", "sea", ""])], "p array<string>, o array<string>")
    assert tuple(d.select(*[c.alias(n) for c, n in zip(S.routed_keywords(F.col("p"), F.col("o")), "abc", strict=True)]).first()) == (["war", "ship"], ["ship", "sea", ""], ["war", "ship", "sea", ""])


def test_fields_of_documents(spark):
    documents = [
        ('{"release_dates":{"results":[{"iso_3166_1":"GB","release_dates":[{"certification":"15"}]},{"iso_3166_1":"US","release_dates":[{"certification":" "},{"certification":null},{"certification":" R "}]}]}}', "R"),
        ('{"release_dates":{"results":[{"iso_3166_1":"US","release_dates":[]},{"iso_3166_1":"US","release_dates":[{"certification":"PG"}]}]}}', "PG"),
        ('{"release_dates":{"results":[{"iso_3166_1":"US"}]}}', None),
        ('{"release_dates":null}', None),
        ("{}", None),
        ("{broken", None),
        (None, None),
        ("", None),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(documents)], "id int, t string")
    assert [r.c for r in d.select("id", S.us_certificate(F.col("t")).alias("c")).orderBy("id").collect()] == [c for _, c in documents]
    reviews = ['{"reviews":{"results":[{"content":"Good."},{"content":""},{"author":"x"},{"content":"Bad."}]}}', '{"reviews":{"results":[]}}', '{"reviews":null}', "{", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(reviews)], "id int, t string")
    assert [r.c for r in d.select("id", S.review_contents(F.col("t")).alias("c")).orderBy("id").collect()] == [["Good.", "Bad."], None, None, None, None]


def test_edges_of_awards(spark):
    edge = '{"node":{"award":{"event":{"text":"%s"},"text":%s,"year":%s},"isWinner":%s,"category":%s}}'
    edges = [
        edge % (" Known ", '"Prize"', "1999", "true", '{"text":" Best "}'),
        edge % ("Known", '"Prize"', '"2001"', "null", "null"),
        edge % ("Other", '"Prize"', "1999", "true", "null"),
        edge % ("Known", "null", "1999", "true", "null"),
        edge % ("Known", '" "', "1999", "true", "null"),
        edge % ("Known", '"Prize"', '"soon"', "true", "null"),
        edge % ("Known", '"Prize"', "null", "true", "null"),
        '{"node":null}',
        "{}",
    ]
    d = spark.createDataFrame([(1, "[" + ",".join(edges) + "]"), (2, "[]"), (3, None), (4, "[broken")], "movie_id long, t string")
    got = {tuple(r) for r in S.award_edges(d, "t", ["Known"]).collect()}
    assert got == {(1, "Known", "Prize", "Best", True, 1999), (1, "Known", "Prize", None, False, 2001)}
