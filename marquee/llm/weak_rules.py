"""Quality by weak supervision: rules vote or abstain, EM estimates how far each is right, a posterior decides.

Each rule compares one integer ratio of a document with the quartiles of that ratio over all documents: inside the usual range it votes
good, far outside bad, between it abstains. Label model: a hidden class (good, bad) and, for each rule, the probabilities of
its three outcomes in either class; EM fits them and the class balance to the counts of vote patterns. Only the ratios' histograms (at
most LARGEST + 1 numbers a rule) and the counts of vote patterns (at most 3 ** rules) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, count_space, map_text, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"
#: Ratios are whole numbers from 0 to this.
LARGEST = 10_000
#: Quartile distances beyond the quartiles at which a vote turns to abstention, then to bad.
MILD, FAR = 1.5, 3.0
#: Words that a text needs before its share of distinct words says something.
VARIETY_WORDS = 50
OUTCOMES = (-1, 0, 1)
#: Dirichlet weights of a rule's bad, abstaining and good votes before any document is seen, by class; and of the two classes.
GOOD_VOTES, BAD_VOTES, BALANCE = (0.1, 0.4, 1.5), (1.0, 0.5, 0.5), (9.0, 1.0)


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more (first find included)."""
    if len(words) <= width:
        return 0
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[j : len(words) - width + 1 + j] ^ (words[j : len(words) - width + 1 + j] >> np.uint64(31)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def _measure(text: str | None, words: np.ndarray) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    letters = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) + (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) // 2
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words),
        len(text) - count_space(raw),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        upper,
        raw.count(b".") + raw.count(b"!") + raw.count(b"?"),
        raw.count(b"!"),
        len(np.unique(words)),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stops", "n_bangs", "n_distinct"]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES...) longs per row; null and blank texts have zeros. n_letters is of ASCII letters plus half the non-ASCII bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, known):
        texts = batch.column(1).to_pylist()
        words, offsets = word_hashes(texts, known)
        rows = [_measure(t, words[offsets[i] : offsets[i + 1]]) for i, t in enumerate(texts)]
        return [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, " + ", ".join(f"{m} long" for m in MEASURES), WordHash)


def _ratio(part: Column, whole: Column, scale: int = 1000) -> Column:
    return F.least(F.floor(scale * part / F.greatest(whole, F.lit(1))), F.lit(LARGEST)).cast("int")


def ratios() -> dict[str, tuple[Column, int, bool, bool]]:
    """By rule: the integer ratio, the least quartile distance it is measured by, and whether low and high values speak against a text."""
    c = {m: F.col(m) for m in MEASURES}
    return {
        "word_length": (_ratio(c["word_chars"], c["n_words"], 100), 50, True, True),
        "symbols": (_ratio(c["n_symbols"], c["n_words"]), 20, False, True),
        "letters": (_ratio(c["n_letters"], c["word_chars"]), 20, True, False),
        "capitals": (_ratio(c["n_upper"], c["n_letters"]), 20, False, True),
        "exclaims": (_ratio(c["n_bangs"], c["n_words"]), 20, False, True),
        "sentences": (_ratio(c["n_words"], c["n_stops"], 10), 50, True, True),
        "variety": (F.when(c["n_words"] >= VARIETY_WORDS, _ratio(c["n_distinct"], c["n_words"])), 50, True, False),
        "copied_lines": (_ratio(c["n_dup_lines"], c["n_lines"]), 50, False, True),
        "copied_words": (_ratio(c["n_repeat_words"], c["n_words"]), 50, False, True),
    }


def quartiles(measures: DataFrame) -> dict[str, tuple[int, int]]:
    """Lower and upper quartile of each rule's ratio over all documents, from exact histograms; (0, 0) where there is none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), ratio.alias("value")) for name, (ratio, *_) in ratios().items()])).alias("x")
    seen = measures.select(pairs).select("x.*").where("value IS NOT NULL").groupBy("rule", "value").count().toPandas()
    out = dict.fromkeys(ratios(), (0, 0))
    for name, own in seen.groupby("rule"):
        own = own.sort_values("value")
        share = own["count"].cumsum().to_numpy() / own["count"].sum()
        values = own["value"].to_numpy()
        out[name] = (int(values[np.searchsorted(share, 0.25)]), int(values[np.searchsorted(share, 0.75)]))
    return out


def rules(usual: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains, also where there is no ratio."""
    out = {}
    for name, (ratio, floor, low, high) in ratios().items():
        q1, q3 = usual[name]
        reach = max(q3 - q1, floor)
        beyond = lambda times: (F.lit(low) & (ratio < q1 - times * reach)) | (F.lit(high) & (ratio > q3 + times * reach))  # noqa: B023, E731
        out[name] = F.when(ratio.isNull(), 0).when(beyond(FAR), -1).when(beyond(MILD), 0).otherwise(1)
    return out


class LabelModel:
    """Class balance and, per rule, the log-odds of good that each outcome adds."""

    def __init__(self, balance: float, good: np.ndarray, bad: np.ndarray):
        self.balance, self.good, self.bad = balance, good, bad

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        each = np.log(self.good / self.bad)
        return np.log(self.balance / (1 - self.balance)) + sum((each[j][votes[:, j].astype(int) + 1] for j in range(votes.shape[1])), np.zeros(len(votes)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -700, 700)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, steps: int = 500) -> LabelModel:
    """EM over distinct vote patterns (n x rules of -1, 0, 1) and their counts, from documents without any bad vote as the good ones.

    Dirichlet weights keep every probability off 0 and 1 and fix which class is the good one; without patterns the model is these weights' own.
    """
    p = np.where((votes == -1).any(1), 0.1, 0.95)
    hit = np.stack([votes == v for v in OUTCOMES], 2).astype(float)
    for _ in range(steps):
        balance = (counts @ p + BALANCE[0]) / (counts.sum() + sum(BALANCE))
        good = np.einsum("n,njv->jv", counts * p, hit) + GOOD_VOTES
        bad = np.einsum("n,njv->jv", counts * (1 - p), hit) + BAD_VOTES
        model = LabelModel(balance, good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True))
        now = model.posterior(votes)
        done, p = not len(p) or np.abs(now - p).max() < 1e-9, now
        if done:
            break
    return model


def judge(measures: DataFrame, least_posterior: float = 0.5) -> DataFrame:
    """Adds posterior and verdict (posterior >= least_posterior) to rows of measures, replacing columns of these names.

    measures is read three times, so hand in a written table. An empty table gives an empty result.
    """
    named = rules(quartiles(measures))
    patterns = measures.groupBy(*[v.alias(k) for k, v in named.items()]).count().toPandas()
    model = fit_label_model(patterns[list(named)].to_numpy(int), patterns["count"].to_numpy(float))
    odds = F.lit(float(np.log(model.balance / (1 - model.balance))))
    for vote, each in zip(named.values(), np.log(model.good / model.bad), strict=True):
        odds = odds + F.when(vote == -1, float(each[0])).when(vote == 0, float(each[1])).otherwise(float(each[2]))
    return measures.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("verdict", F.col("posterior") >= least_posterior)
