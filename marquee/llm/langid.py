"""Language identification by multilingual mixture inference.

Model: smoothed letter bigram and trigram probabilities of each learned language, hashed to a fixed
number of buckets. A document's words are drawn from its languages; expectation-maximisation over
word likelihoods estimates the proportions, and the language set is the nested set with the best penalised likelihood.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold_of, hash_share, map_text

BITS = 16
#: Bound of the labelled sample per language that the model is fitted on (expected number of documents).
MAX_DOCS_PER_LANGUAGE = 4000
UNDETERMINED = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    if not _tables:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def word_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams (letters x 2), the word of each letter, and the offset of each text's first word (n + 1).

    Every letter gives the bigram that ends in it and the trigram around it; word edges are marked.
    """
    joined = "\n".join(t or "" for t in texts) + "\n"
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    is_letter = codes > 0
    before = np.concatenate([[np.uint32(0)], codes[:-1]])
    after = np.concatenate([codes[1:], [np.uint32(0)]])
    at = np.flatnonzero(is_letter)
    starts = is_letter & (before == 0)
    words_before = np.concatenate([[0], np.cumsum(starts)])
    offsets = words_before[np.concatenate([[0], np.cumsum(lengths)])]
    word = words_before[at + 1] - 1
    b, c, a = before[at].astype(np.uint64), codes[at].astype(np.uint64), after[at].astype(np.uint64)
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    two = ((b << np.uint64(21)) | c | np.uint64(1 << 63)) * mult >> shift
    three = ((b << np.uint64(42)) | (c << np.uint64(21)) | a) * mult >> shift
    return np.stack([two, three]).astype(np.int64), word, offsets


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS_PER_LANGUAGE) -> dict:
    """A model from rows with text and language: {languages, log_p (bits x languages)}.

    At most max_docs documents per language in expectation are used, drawn by a hash of the id. What the driver collects is bounded by
    languages x 2 ** BITS counts. With no labelled row, every prediction is `und`.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return {"languages": [], "log_p": np.zeros((1 << BITS, 0), np.float32)}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])
    drawn = rows.where(hash_share(F.col(id_col)) < share[F.col(lang_col)])

    def make():
        return {}

    def fn(batch: pa.RecordBatch, state):
        langs = batch.column(0).to_pylist()
        grams, word, offsets = word_grams(batch.column(1).to_pylist())
        doc = np.searchsorted(offsets, word, side="right") - 1
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])[doc] if len(word) else word
        counts = sum(np.bincount(code * (1 << BITS) + g, minlength=len(names) << BITS) for g in grams)
        for k, name in enumerate(names):
            own = counts[k << BITS : (k + 1) << BITS]
            state[name] = state[name] + own if name in state else own

    def finish(state):
        if not state:
            return None
        names = sorted(state)
        at = [np.flatnonzero(state[x]) for x in names]
        return [pa.array([x for x, i in zip(names, at, strict=True) for _ in i], pa.string()), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([state[x][i] for x, i in zip(names, at, strict=True)]).astype(np.int64))]

    parts = map_text(drawn, [F.col(lang_col).alias("lang"), F.col(text_col).alias("text")], fn, "lang string, gram int, n long", make, finish, slice_bytes=1 << 20)
    got = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((1 << BITS, len(languages)))
    counts[got["gram"].to_numpy(int), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = got["n"]
    p = (counts + 0.2) / (counts + 0.2).sum(0)
    return {"languages": languages, "log_p": np.log(p).astype(np.float32)}


def _by_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Column sums of each document's word rows (zero where it has none)."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def _em(like: np.ndarray, base: np.ndarray, offsets: np.ndarray, doc: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document over its allowed languages."""
    n_words = np.maximum(np.diff(offsets), 1)[:, None]
    pi = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    for _ in range(steps):
        joint = like * pi[doc]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        pi = _by_doc(joint, offsets) / n_words
    total = np.log(np.maximum((like * pi[doc]).sum(1), 1e-300)) + base
    return pi, _by_doc(total[:, None], offsets)[:, 0]


def infer(texts: list[str | None], model: dict, penalty: float = 3.0, steps: int = 12) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """(language, its proportion, the selected set) of each text.

    The set grows from the likeliest single language by the largest mixture proportions, up to all learned ones, while each
    language added raises the log-likelihood by more than penalty * log(words + 1).
    """
    languages, log_p = model["languages"], model["log_p"]
    n, k = len(texts), len(languages)
    grams, word, offsets = word_grams(texts)
    n_words = np.diff(offsets)
    if not k:
        return [UNDETERMINED] * n, np.zeros(n), [[] for _ in texts]
    if not len(word):
        return [UNDETERMINED] * n, np.zeros(n), [[] for _ in texts]
    edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    # Bigram and trigram evidence overlap, so each counts half.
    letters = 0.5 * (log_p[grams[0]] + log_p[grams[1]])
    ll = np.add.reduceat(letters, edges, axis=0).astype(np.float64)
    del letters
    base = ll.max(1)
    like = np.exp(ll - base[:, None])
    doc = np.repeat(np.arange(n), n_words)
    single = _by_doc(ll, offsets)
    best = single.argmax(1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    score_ll, pi_best = single.max(1), chosen.astype(float)
    cost = penalty * np.log(n_words + 1)
    # A document whose likelihood under free choice for each word gains too little stays with one language.
    free = _by_doc(base[:, None], offsets)[:, 0]
    live = np.flatnonzero((free - score_ll > cost) & (n_words > 0))
    if k > 1 and len(live):
        pick = np.isin(doc, live)
        sub_off = np.concatenate([[0], np.cumsum(n_words[live])])
        sub_doc = np.repeat(np.arange(len(live)), n_words[live])
        sub_like, sub_base = like[pick], base[pick]
        full, full_ll = _em(sub_like, sub_base, sub_off, sub_doc, np.ones((len(live), k)), steps)
        go = full_ll - score_ll[live] > cost[live]
        ranked = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, k + 1):
            if not go.any():
                break
            on = np.flatnonzero(go)
            keep = np.isin(sub_doc, on)
            own = sub_off[on + 1] - sub_off[on]
            off = np.concatenate([[0], np.cumsum(own)])
            allowed = np.zeros((len(on), k))
            np.put_along_axis(allowed, ranked[on, :size], 1.0, axis=1)
            pi, total = _em(sub_like[keep], sub_base[keep], off, np.repeat(np.arange(len(on)), own), allowed, steps)
            better = total - score_ll[live[on]] > cost[live[on]]
            won = live[on[better]]
            chosen[won], pi_best[won], score_ll[won] = allowed[better] > 0, pi[better], total[better]
            go[on[~better]] = False
    top = pi_best.argmax(1)
    preds = [languages[j] if m else UNDETERMINED for j, m in zip(top, n_words, strict=True)]
    score = np.where(n_words > 0, np.clip(pi_best.max(1), 0, 1), 0.0)
    return preds, score, [[languages[j] for j in np.flatnonzero(chosen[i])] if n_words[i] else [] for i in range(n)]


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", extra: list | None = None) -> DataFrame:
    """(id, extra columns, lang_pred, score, languages) per row.

    Of the input only the named columns are kept, none of which may be called like an output. Null, empty and letterless texts get `und` with score 0. Texts are read whole; the language column, if any, is not read.
    """
    extra = extra or []
    if clash := {"lang_pred", "score", "languages"} & set(df.select(F.col(id_col), *extra).columns):
        raise ValueError(f"columns {sorted(clash)} are outputs")
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(id_col), *extra, F.col(text_col)]
    head = df.select(*columns[:-1]).schema

    def fn(batch: pa.RecordBatch, _):
        preds, score, sets = infer(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
        return [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", lang_pred string, score double, languages array<string>"
    return map_text(df, columns, fn, schema, slice_bytes=1 << 20)


def held_out(id_col: str = "doc_id"):
    return fold_of(F.col(id_col), 4) == 2
