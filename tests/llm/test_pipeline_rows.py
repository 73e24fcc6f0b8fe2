"""The pipeline's near-duplicate stage on rows that their ids do not tell apart."""

from collections import Counter

import corpus_pipeline


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"}
    rows = [(None, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["c"]), (2, text["d"]), (3, text["d"] + " more"), (0, text["c"])]
    rows += [(None, text["e"]), (None, text["e"]), (None, text["f"]), (9, text["f"]), (4, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    want = [(None, text["a"]), (1, text["b"]), (0, text["c"]), (2, text["d"]), (None, text["e"]), (9, text["f"]), (4, None), (5, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)
