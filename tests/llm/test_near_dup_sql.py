"""Near duplicates against their SQL form."""

import duckdb

from marquee.llm import queries

SF = "/root/testdata/sf0.01"


def test_components_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({queries.oracle_sql()['op7_near_dup']})").fetchall()}
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op7_near_dup(spark, SF).collect()}
    assert got == want and sum(not r[3] for r in want) > 50
