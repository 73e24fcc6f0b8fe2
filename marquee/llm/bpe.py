"""Byte-level BPE encoding and decoding of text columns (tiktoken library, local rank file)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import map_text

#: Ids that are decoded together, about.
MOST_IDS = 1_000_000


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text; null counts as empty and gives an empty array. Other columns are dropped."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, _):
        raws = tokens.tiktoken_encoder(ranks, pattern).encode([t or "" for t in batch.column(1).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
        return [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32)))]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, ids array<int>")


def decode(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded binary): the raw bytes of each row's ids, which need not be valid UTF-8 on their own."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        raw, words = tokens.decoder_table(ranks), [str(i) for i in range(len(tokens.decoder_table(ranks)))]
        for batch in batches:
            # A slice has about MOST_IDS ids; a longer list is its own.
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_IDS, side="right")))
                part, at = batch.slice(at, to - at), to
                rows = [x or [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in rows], pa.int64()),
                        pa.array([hashlib.sha256(",".join([words[i] for i in x]).encode()).hexdigest() for x in rows]),
                        pa.array([b"".join([raw[i] for i in x]) for x in rows], pa.binary()),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded"],
                )

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded binary")
