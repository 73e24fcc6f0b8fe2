"""Language sets as large as the learned languages."""

import string

from marquee.llm import langid


def test_a_document_may_have_all_learned_languages(spark):
    own = {f"l{k}": " ".join(a + b + a for a in string.ascii_lowercase[4 * k : 4 * k + 4] for b in string.ascii_lowercase[4 * k : 4 * k + 4]) + " " for k in range(6)}
    model = langid.fit(spark.createDataFrame([(i, own[x] * 20, x) for i, x in enumerate(own)], "doc_id long, text string, lang string"))
    for n in (1, 2, 5, 6):
        names = sorted(own)[:n]
        _, score, sets = langid.infer(["".join(own[x] * 40 for x in names)], model)
        assert sets == [names] and abs(score[0] - 1 / n) < 0.02
