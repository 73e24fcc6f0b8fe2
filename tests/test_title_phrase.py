"""Titles by phrase at a size where every token lies above the studio ceiling."""

import duckdb

from marquee import registry
from marquee.operators.retrieval import PHRASES

SF = "/root/testdata/sf0.1"


def test_phrase_has_no_frequency_ceiling(spark):
    got = {(r.phrase, r.movie_id) for r in registry.queries()["join_title_phrase"](spark, SF).collect()}
    titles = duckdb.sql(f"SELECT p_partkey, lower(p_name) FROM '{SF}/part.parquet'").fetchall()
    assert got == {(p, i) for i, title in titles for p in PHRASES if set(p.split()) <= set(title.split(" "))}
    assert {p for p, _ in got} == set(PHRASES[:3])
