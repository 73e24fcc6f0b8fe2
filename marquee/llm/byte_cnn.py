"""Quality by a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over overlapping chunks that cover the whole document. Each chunk is
max-pooled; the document's vector is the mean and the greatest pooled value of its chunks, and a logistic layer
gives one probability. Filters and weights are trained together (Adam, gradients through the pooled positions).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold_of, hash_share, map_text, no_clash, sigmoid

WIDTH, FILTERS, CHUNK = 4, 16, 256
STRIDE = CHUNK - WIDTH + 1  # every window of WIDTH bytes lies in one chunk
#: Bounds of the labelled sample: documents in expectation, and bytes of one document of the sample (of longer ones, chunks spread over the whole text are drawn).
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 3000, 50_000


def _bytes(text: str | bytes | None) -> np.ndarray:
    raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([raw, np.zeros(max(0, WIDTH - len(raw)), np.uint8)])


def _chunks(n: int) -> np.ndarray:
    """Start of each chunk of n bytes; the last begins early enough to be full, so chunks overlap and cover every window."""
    starts = np.arange(0, n - WIDTH + 1, STRIDE)
    starts[-1] = min(starts[-1], max(0, n - CHUNK))
    return starts


def _matrix(doc: np.ndarray) -> tuple[np.ndarray, int]:
    """A document's chunks as rows of CHUNK bytes, and the number of windows in each row (a shorter text's row is padded)."""
    at = _chunks(len(doc))[:, None] + np.arange(CHUNK)
    return doc[np.minimum(at, len(doc) - 1)], min(STRIDE, len(doc) - WIDTH + 1)


def drawn_chunks(text: str, most: int) -> bytes:
    """A text's UTF-8 bytes; of more than `most`, evenly spread pieces of CHUNK bytes, the first and the last among them."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return raw
    starts = np.linspace(0, len(raw) - CHUNK, max(2, most // CHUNK)).astype(np.int64)
    return b"".join([raw[i : i + CHUNK] for i in starts.tolist()])


def train(texts: list[str | bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 48, seed: int = 7) -> dict:
    """Filters (WIDTH x 256 x FILTERS), bias and logistic weights for the labelled texts."""
    rng = np.random.default_rng(seed)
    docs, windows = zip(*[_matrix(_bytes(t)) for t in texts], strict=True) if texts else ((), ())
    params = {"conv": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "base": np.zeros(1)}
    rate0 = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    params["base"][0] = np.log(rate0 / (1 - rate0))
    if not len(labels) or labels.min() == labels.max():
        return {k: v.astype(np.float32) for k, v in (params | {"out": np.zeros(2 * FILTERS)}).items()}
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            rows = np.concatenate([docs[i] for i in own])
            counts = np.array([len(docs[i]) for i in own])
            doc = np.repeat(np.arange(len(own)), counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            conv32 = params["conv"].astype(np.float32)
            z = sum(conv32[k][rows[:, k : k + STRIDE]] for k in range(WIDTH))
            z[np.arange(STRIDE)[None] >= np.repeat([windows[i] for i in own], counts)[:, None]] = -1e9
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + params["bias"]
            act = np.maximum(top, 0)
            mean = np.add.reduceat(act, starts) / counts[:, None]
            peak = np.maximum.reduceat(act, starts)
            p = sigmoid(np.concatenate([mean, peak], 1) @ params["out"] + params["base"][0])
            err = (p - labels[own]) / len(own)
            grad = {"out": np.concatenate([err @ mean, err @ peak]) + 1e-4 * params["out"], "base": np.array([err.sum()])}
            g = (err / counts)[doc, None] * params["out"][:FILTERS]
            is_peak = act == peak[doc]
            g += is_peak * err[doc, None] * params["out"][FILTERS:]
            g *= top > 0
            grad["bias"] = g.sum(0)
            grad["conv"] = 1e-5 * params["conv"]
            for k in range(WIDTH):
                codes = np.take_along_axis(rows, at + k, 1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                grad["conv"][k] += np.bincount(codes.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, v in grad.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                params[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in params.items()}


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> dict:
    """A network from a bounded sample of rows with text and a 0/1 label, drawn by a hash of the id.

    One class or no row gives a constant score.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    size = rows.count()
    drawn = rows.where(hash_share(F.col(id_col)) < min(1.0, max_docs / max(size, 1)))
    kind = labelled.schema[id_col].dataType.simpleString()

    def cut(batch: pa.RecordBatch, _):
        return [batch.column(0), batch.column(1), pa.array([drawn_chunks(t, max_bytes) for t in batch.column(2).to_pylist()], pa.binary())]

    got = map_text(drawn, [F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")], cut, f"id {kind}, label int, text binary").toPandas()
    got["text"] = [bytes(x) for x in got["text"]]
    got = got.sort_values(["id", "text"], kind="stable")
    return train(got["text"].tolist(), got["label"].to_numpy(float))


class _Network:
    """The trained filters as two tables over byte pairs."""

    def __init__(self, model: dict):
        conv = model["conv"]
        self.model, self.low, self.high = model, (conv[0][:, None] + conv[1][None]).reshape(65536, -1), (conv[2][:, None] + conv[3][None]).reshape(65536, -1)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        docs = [_bytes(t) for t in texts]
        joined = np.concatenate(docs)
        pairs = joined[:-1].astype(np.int32) << 8 | joined[1:]
        z = self.low[pairs[:-2]] + self.high[pairs[2:]]
        ends = np.cumsum([len(d) for d in docs])
        starts = [_chunks(len(d)) for d in docs]
        counts = np.array([len(s) for s in starts])
        begin = np.concatenate([s + e - len(d) for s, e, d in zip(starts, ends, docs, strict=True)])
        stop = np.minimum(begin + STRIDE, np.repeat(ends, counts) - WIDTH + 1)
        edges = np.column_stack([begin, np.minimum(stop, len(z) - 1)]).ravel()
        top = np.maximum.reduceat(z, edges, axis=0)[::2]
        if stop[-1] == len(z):  # the very last window has no later edge
            top[-1] = np.maximum(top[-1], z[-1])
        act = np.maximum(top + self.model["bias"], 0)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.concatenate([np.add.reduceat(act, first) / counts[:, None], np.maximum.reduceat(act, first)], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(self.vectors(texts).astype(np.float64) @ self.model["out"].astype(np.float64) + float(self.model["base"][0]))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, extra: list | None = None) -> DataFrame:
    """(id, extra columns, score, predicted) per row from every byte of the text; null and empty texts count as WIDTH zero bytes. Carried columns may not have an output's name."""
    no_clash(df.select(F.col(id_col), *(extra or [])).columns, "score", "predicted")
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(id_col), *(extra or []), F.col(text_col)]
    head = df.select(*columns[:-1]).schema

    def fn(batch: pa.RecordBatch, net):
        p = net.score(batch.column(batch.num_columns - 1).to_pylist())
        return [*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", score double, predicted int"
    return map_text(df, columns, fn, schema, lambda: _Network(shared.value), slice_bytes=1 << 19)


def held_out(id_col: str = "doc_id"):
    return fold_of(F.col(id_col), 5) == 0
