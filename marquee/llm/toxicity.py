"""Toxicity by class-conditional Kneser-Ney word bigram models.

Counts come from all labelled training documents, in tables that grow with their words. Per class, P(w | h) discounts the bigram count and backs off
to the class's discounted unigrams, which back off to continuation counts shared by both classes, so
rare expressions have the same smoothing mass in either. A text's score compares the length-normalised toxic
and ordinary log-likelihoods, over the whole text and over its most toxic window of words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, discard, fit_logistic, fold_of, hash_share, map_text, mapped_table, materialise, mix64, no_clash, send_table, sigmoid, word_hashes

#: Absolute discounts of word and of bigram counts. Toxic text is a tenth of the labelled words, so a bigram seen a few times in it says little: such counts go to the backoff whole.
DISCOUNT, BIGRAM_DISCOUNT = 0.75, 4.0
#: Backoff counts of every word type, shared by the classes in proportion to their sizes; rare words then look alike in both.
SHARED = 12.0
WINDOW = 4
#: Most rows of the models' tables that are sent to every executor as files (12 bytes each) and mapped there, instead of joined; the scores are the same.
LOCAL_ROWS = 50_000_000
#: Texts whose keys are asked for together where the tables are joined.
CHUNK = 256
#: Bound of the labelled sample that the calibration weights are fitted on (expected number of documents).
MAX_CALIBRATION_DOCS = 4000
_NOT_WORD = re.compile(r"[\W_]+")
_START = np.uint64(0x5157A127)
_known = WordHash()


def _tokens(texts: list[str | None], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased letter and digit words of each text, and the offsets."""
    return word_hashes([_NOT_WORD.sub(" ", t.lower()) if t else None for t in texts], known)


def _contexts(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.concatenate([[_START], words[:-1]]) if len(words) else words
    first = offsets[:-1][np.diff(offsets) > 0]
    out[first] = _START
    return out


def _pair(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) ^ words)


def bigram_counts(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(h, w, toxic, ordinary): exact counts of every word bigram of the labelled texts, by word hash.

    Tasks sum their own bigrams in blocks before the shuffle.
    """

    def drain(state):
        keys, n = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (state["h"], state["w"])], [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (state["t"], state["o"])]
        state |= {"h": [], "w": [], "t": [], "o": [], "held": 0}
        if not len(keys[0]):
            return None
        order = np.lexsort(keys)
        h, w = keys[0][order], keys[1][order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        t, o = (np.add.reduceat(x[order], at).astype(np.int32) for x in n)
        return [pa.array(h[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(t), pa.array(o)]

    def make():
        return {"h": [], "w": [], "t": [], "o": [], "held": 0, "known": WordHash()}

    def fn(batch: pa.RecordBatch, state):
        words, offsets = _tokens(batch.column(1).to_pylist(), state["known"])
        toxic = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) == 1, np.diff(offsets)).astype(np.int32)
        for k, x in (("h", _contexts(words, offsets)), ("w", words), ("t", toxic), ("o", 1 - toxic)):
            state[k].append(x)
        state["held"] += len(words)
        return drain(state) if state["held"] > 1_500_000 else None

    parts = map_text(labelled, [F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")], fn, "h long, w long, t int, o int", make, drain)
    return parts.groupBy("h", "w").agg(F.sum("t").cast("int").alias("toxic"), F.sum("o").cast("int").alias("ordinary"))


def fit_counts(bigrams: DataFrame, local_rows: int = LOCAL_ROWS) -> dict:
    """The two models as written tables keyed by full hash, with `local` sorted arrays of them, maps of the `files` that every executor has, if they have at most local_rows rows together.

    A word's ratio of log-likelihoods is `head` of the context plus `ratio` of the word, and `extra` of the pair where the pair's count
    exceeds the discount. Words that no labelled text has have `unseen`.
    """
    seen = materialise(bigrams, "bigrams")
    totals = seen.agg(F.count(F.lit(1)).alias("types"), F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no")).first()
    per_word = materialise(seen.groupBy("w").agg(F.count(F.lit(1)).alias("cont"), F.sum("toxic").alias("ct"), F.sum("ordinary").alias("co")), "word_counts")
    kept = per_word.agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(c) for c in ("ct", "co")]).first()
    kinds, types = kept["kinds"] + 1, totals["types"] or 0
    sizes = [float(totals[x] or 0) for x in ("nt", "no")]

    def low(count, cont, side: int):
        n, part = sizes[side], SHARED * max(sizes[side], 1) / max(sum(sizes), 1)
        own = F.greatest(count - DISCOUNT, F.lit(0.0))
        return (own + (n - float(kept[("ct", "co")[side]] or 0)) * (cont + 0.5) / (types + 0.5 * kinds) + part) / (n + part * kinds)

    words = per_word.select("w", low(F.col("ct"), F.col("cont"), 0).alias("lt"), low(F.col("co"), F.col("cont"), 1).alias("lo"))
    per_context = seen.groupBy("h").agg(*[F.sum(c).alias(f"x{c[0]}") for c in ("toxic", "ordinary")], *[F.sum(F.least(F.col(c), F.lit(BIGRAM_DISCOUNT))).alias(f"d{c[0]}") for c in ("toxic", "ordinary")], F.max(F.greatest("toxic", "ordinary")).alias("top"))
    # A context none of whose counts exceeds the discount gives its words their backoff, as an unseen one does.
    contexts = materialise(per_context.where(F.col("top") > BIGRAM_DISCOUNT).drop("top"), "contexts")
    share = {c: F.when(F.col(f"x{c}") > 0, F.col(f"d{c}") / F.col(f"x{c}")).otherwise(1.0) for c in "to"}
    heads = contexts.select(F.col("h").alias("key"), (F.log(share["t"]) - F.log(share["o"])).alias("head"))
    ratios = words.select(F.col("w").alias("key"), (F.log("lt") - F.log("lo")).alias("ratio"))

    @F.pandas_udf("long")
    def pair(h, w):
        import pandas as pd

        return pd.Series(_pair(h.to_numpy(np.int64).view(np.uint64), w.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    full = seen.where(F.greatest("toxic", "ordinary") > BIGRAM_DISCOUNT).join(contexts, "h").join(words, "w")
    over = {c: F.when(F.col(f"x{c}") > 0, (F.greatest(F.col(n) - BIGRAM_DISCOUNT, F.lit(0.0)) / F.col(f"x{c}") + share[c] * F.col(f"l{c}")) / (share[c] * F.col(f"l{c}"))).otherwise(1.0) for c, n in (("t", "toxic"), ("o", "ordinary"))}
    extras = full.select(pair(F.col("h"), F.col("w")).alias("key"), (F.log(over["t"]) - F.log(over["o"])).alias("extra"))
    tables = {name: materialise(df.select("key", F.col(name).cast("float").alias("value")), name) for name, df in (("head", heads), ("ratio", ratios), ("extra", extras))}
    rates = [((n - float(kept[c] or 0)) * 0.5 / (types + 0.5 * kinds) + part) / (n + part * kinds) for n, c in zip(sizes, ("ct", "co"), strict=True) for part in [SHARED * max(n, 1) / max(sum(sizes), 1)]]
    discard(seen, per_word, contexts)
    model = {"tables": tables, "unseen": float(np.log(rates[0]) - np.log(rates[1])), "local": None}
    rows = {name: df.count() for name, df in tables.items()}
    if sum(rows.values()) <= local_rows:
        model["files"] = {name: send_table(df, rows[name], "float32") for name, df in tables.items()}
        model["local"] = _local(model["files"])
    return model


def _local(files: dict) -> dict:
    return {name: mapped_table(sent) for name, sent in files.items()}


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, value = table.column("key").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(key)
    return key[order], value[order].astype(np.float32)


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, value = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys.view(np.int64)), len(known) - 1)
    return np.where(known[at] == keys.view(np.int64), value[at], missing).astype(float)


def features(texts: list[str | None], model: dict, known: WordHash) -> np.ndarray:
    """Per text: mean log-likelihood ratio, the greatest mean over WINDOW words, the sum of what exceeds 1 in a word's ratio, log word count. Zeros without words."""
    words, offsets = _tokens(texts, known)
    out = np.zeros((len(texts), 4))
    if not len(words):
        return out
    context = _contexts(words, offsets)
    local = model["local"]
    (kinds, at_word), (heads, at_head) = (np.unique(x, return_inverse=True) for x in (words, context))
    ratio = _look_up(local["ratio"], kinds, model["unseen"])[at_word] + _look_up(local["head"], heads, 0.0)[at_head] + _look_up(local["extra"], _pair(context, words), 0.0)
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    starts = offsets[full]
    out[full, 0] = np.add.reduceat(ratio, starts) / n[full]
    run = np.concatenate([[0], np.cumsum(ratio)])
    at = np.arange(len(words))
    first = np.repeat(offsets[:-1], n)
    begin = np.maximum(at + 1 - WINDOW, first)
    out[full, 1] = np.maximum.reduceat((run[at + 1] - run[begin]) / WINDOW, starts)
    out[full, 2] = np.log1p(np.add.reduceat(np.maximum(ratio - 1, 0), starts))
    out[full, 3] = np.log(n[full] + 1)
    return out


def measured(df: DataFrame, columns: list, model: dict, fn, schema: str) -> DataFrame:
    """fn(features of a batch, its columns) over the selected columns, the last of which is the text.

    Local tables are mapped by the workers. Otherwise the distinct keys of every CHUNK rows are joined with the written tables,
    and what is found meets the chunk's texts again.
    """
    own = {k: v for k, v in model.items() if k not in ("tables", "local")}
    if model["local"] is not None:
        return map_text(df, columns, lambda batch, known: fn(features(batch.column(batch.num_columns - 1).to_pylist(), own | {"local": _local(own["files"])}, known), batch.columns), schema, WordHash)
    names = [f"_c{i}" for i in range(len(columns))]
    numbered = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]).withColumn("_chunk", F.floor(F.monotonically_increasing_id() / CHUNK))
    rows = materialise(numbered, "toxicity_rows")

    def ask(batch: pa.RecordBatch, known):
        words, offsets = _tokens(batch.column(1).to_pylist(), known)
        context = _contexts(words, offsets)
        chunk = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
        out = [[], [], []]
        for c in np.unique(chunk):
            mine = chunk == c
            for table, keys in (("ratio", words[mine]), ("head", context[mine]), ("extra", _pair(context[mine], words[mine]))):
                keys = np.unique(keys).view(np.int64)
                for x, y in zip(out, ([c] * len(keys), [table] * len(keys), keys.tolist()), strict=True):
                    x.extend(y)
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())]

    asked = materialise(map_text(rows, [F.col("_chunk"), F.col(names[-1])], ask, "chunk long, kind string, key long", WordHash).distinct(), "asked")
    found = [asked.where(F.col("kind") == name).join(table, "key").select("chunk", "kind", "key", "value") for name, table in model["tables"].items()]
    answers = found[0].unionByName(found[1]).unionByName(found[2])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        local = {name: _sorted(right.filter(pa.compute.equal(right.column("kind"), name))) for name in ("ratio", "head", "extra")}
        got = left.select(names).combine_chunks()
        cols = [got.column(n).combine_chunks() for n in names]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        return pa.table(fn(features(cols[-1].to_pylist(), own | {"local": local}, _known), cols), names=[x.split()[0] for x in schema.split(", ")])

    return rows.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_calibration: int = MAX_CALIBRATION_DOCS, local_rows: int = LOCAL_ROWS) -> dict:
    """Counts from all labelled rows but a bounded sample, a quarter of them at most, which the weights and the intercept are fitted on.

    labelled: id, text and a 0/1 label per row; rows with a null among them are left out. With one class or no row, the score is constant.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    drawn_share = min(0.25, max_calibration / max(rows.count(), 1))
    is_drawn = hash_share(F.col(id_col)) < drawn_share
    model = fit_counts(bigram_counts(rows.where(~is_drawn), text_col, label_col), local_rows)
    drawn = rows.where(is_drawn)
    got = measured(drawn, [F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")], model, lambda x, columns: [columns[0], *(pa.array(c) for c in x.T)], "label int, a double, b double, c double, d double").toPandas()
    y, x = got["label"].to_numpy(float), got[["a", "b", "c", "d"]].to_numpy(float)
    mean, dev = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(4), np.ones(4))
    if 0 < y.sum() < len(y):
        model["weights"] = fit_logistic((x - mean) / dev, y)
    else:
        model["weights"] = np.array([0.0, 0.0, 0.0, 0.0, 3.0 if len(y) and y.all() else -3.0])
    return model | {"mean": mean, "dev": dev}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) per row from the whole text; null and wordless texts score by the intercept and zero features. The id column may not have an output's name."""
    no_clash([id_col], "score", "predicted")
    kind = df.schema[id_col].dataType.simpleString()
    mean, dev, weights = model["mean"], model["dev"], model["weights"]

    def fn(x, columns):
        p = sigmoid((x - mean) / dev @ weights[:-1] + weights[-1])
        return [columns[0], pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return measured(df, [F.col(id_col), F.col(text_col)], model, fn, f"{id_col} {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return fold_of(F.col(id_col), 4) == 2
