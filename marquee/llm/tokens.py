"""Byte-level BPE over whole texts: units split at safe boundaries, encoded once each, and raw-byte decoding.

A cut before white space that follows a non-space character is always safe: no match of the
pattern contains such a pair, and the look-ahead of its white-space branch never sees the cut. So a
text is the concatenation of its units, and equal units have equal ids. The pattern of the byte-level
pre-tokenizer allows two more cuts (`safe_starts`).
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units of up to so many characters are remembered, about so many of them.
UNIT_CHARS, UNITS = 64, 600_000
#: Units that a column's encoder remembers: workers hold them on while later stages run.
COLUMN_UNITS = 150_000
#: Longer units are cut again where a letter meets a digit or the reverse.
LONG = 4096
#: Units that are encoded as one text.
JOINED = 1000
#: White space before a blank: every such pair, so that a text is searched for each by the string's own search.
_GAPS = tuple(c + " " for c in map(chr, range(0x3001)) if c.isspace())
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=\s)")
_KIND = None


def safe_pieces(text: str) -> list[str]:
    """Cuts a text at safe boundaries only; its pieces concatenate to the text and tokenise apart."""
    if "\0" not in text and not any(gap in text for gap in _GAPS):
        pieces = text.replace(" ", "\0 ").split("\0")
        if not pieces[0]:
            del pieces[0]
    else:
        pieces = _BEFORE_SPACE.split(text)
    if len(text) > LONG and max(map(len, pieces)) > LONG:
        pieces = [y for x in pieces for y in (_cut_long(x) if len(x) > LONG else [x])]
    return pieces


def _cut_long(piece: str) -> list[str]:
    import regex

    global _KIND
    if _KIND is None:
        _KIND = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
    return _KIND.split(piece)


class Encoder:
    """ids of texts as little-endian 32-bit bytes; encode_many gives such bytes for each of a list of new units."""

    def __init__(self, encode_many):
        self.encode_many, self.known = encode_many, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        known, cut = self.known, [safe_pieces(t) for t in texts]
        met = set().union(*cut)
        if len(known) > UNITS:  # what these texts hold stays: the frequent units are among it
            known = self.known = {u: known[u] for u in met.intersection(known)}
        new = list(met.difference(known))
        fresh = self.encode_many(new) if new else {}
        long = {u: fresh.pop(u) for u in new if len(u) > UNIT_CHARS}
        known.update(fresh)
        if long:
            return [b"".join([known[u] if u in known else long[u] for u in units]) for units in cut]
        return [b"".join(map(known.__getitem__, units)) for units in cut]


def _ids_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _bytes_table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SPACE = _bytes_table("\t\n\v\f\r\x1c\x1d\x1e\x1f ")
#: White space for every engine.
_GAP = _bytes_table("\t\n\r ")
_MARK = _bytes_table(".,;:!?")
_CUT_AT = _GAP | _MARK
_WORD = _bytes_table("".join(c for c in map(chr, range(128)) if c.isalnum()))
#: First bytes of visible characters of ASCII and Latin-1.
_VISIBLE = _bytes_table("".join(map(chr, range(0x21, 0x7F))))
_VISIBLE[0xC3] = True
#: The last two bytes of white space beyond ASCII.
_WIDE_SPACE = np.zeros(1 << 16, bool)
_WIDE_SPACE[[int.from_bytes(chr(c).encode()[-2:]) for c in range(128, 0x3001) if chr(c).isspace()]] = True


def safe_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units start in UTF-8 bytes, if they are to tokenise apart under the pattern of the byte-level pre-tokenizer.

    first are the starts of the texts that are not empty. Units start there, at white space behind anything else, at a mark behind
    an ASCII or Latin-1 letter or digit (no match holds these two), and behind a single line feed before a visible character (that
    line feed is a match of its own). What is in doubt is not cut.
    """
    at = np.flatnonzero(_CUT_AT[data])
    here, before, lead = data[at], data[at - 1], data[np.maximum(at - 2, 0)]  # what lies before a text is of no account: its start is a cut anyway
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)  # neither the sign of multiplication nor of division
    gap = _GAP[here] & ~_SPACE[before] & ~_WIDE_SPACE[lead.astype(np.uint16) << 8 | before]
    at = at[gap | (_MARK[here] & (_WORD[before] | latin))]
    cut = np.zeros(len(data), bool)
    cut[at] = True
    behind = at[data[at] == 0x0A] + 1
    behind = behind[behind < len(data)]
    cut[behind[_VISIBLE[data[behind]]]] = True
    cut[first] = True
    return np.flatnonzero(cut)


class ColumnEncoder:
    """ids of a column of texts: cut as bytes, the distinct units of a batch looked up once, new ones handed to encode_many as a list."""

    def __init__(self, encode_many):
        self.encode_many, self.known = encode_many, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [bytes(ids[4 * lo : 4 * hi]) for lo, hi in itertools.pairwise(ends.tolist())]

    def encode_column(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Little-endian 32-bit ids of all texts, one after another, and the offset in ids of each text (n + 1). Null is empty."""
        if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
            return memoryview(b""), np.zeros(len(texts) + 1, np.int64)
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
        raw, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        starts = safe_starts(raw, ends[:-1][ends[1:] > ends[:-1]])
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._ids_of(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(units.indices)
        _, offsets, out = ids.buffers()
        unit_ends = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset)
        return memoryview(out)[: unit_ends[-1]], unit_ends[np.searchsorted(starts, ends)] // 4

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > COLUMN_UNITS:  # what these texts hold stays: the frequent units are among it
            known = self.known = {u: known[u] for u in units if u in known}
        new = [u for u in units if u not in known]
        if not new:
            return list(map(known.__getitem__, units))
        cut = {u: [x.encode() for x in _cut_long(u.decode())] for u in new if len(u) > LONG}
        fresh = self.encode_many(list(set(new).difference(cut).union(*cut.values())) if cut else new)
        fresh |= {u: b"".join(map(fresh.__getitem__, own)) for u, own in cut.items()}
        known.update(fresh)
        ids = list(map(known.__getitem__, units))
        for u in [u for u in fresh if len(u) > UNIT_CHARS]:
            del known[u]
        return ids


class _JoinedUnits:
    """Encodes units by a Hugging Face tokenizer of byte-level BPE, those that may stand side by side as one text.

    Units that begin with their only blank and do not end in one or in a control meet at safe cuts, and the tokens that begin with a
    blank are then the units' first ones.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True  # byte-level form of a blank

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def __call__(self, units: list[bytes]) -> dict[bytes, bytes]:
        side = [u for u in units if u.rfind(b" ") == 0 and u[-1] > 32]
        apart, out = set(units).difference(side), {}
        for lo in range(0, len(side), JOINED):
            own = side[lo : lo + JOINED]
            ids = np.asarray(self._ids([b"".join(own)])[0], "<u4")
            cuts = np.flatnonzero(self.first[ids])
            if len(cuts) != len(own):
                apart.update(own)
                continue
            raw, cuts = ids.tobytes(), (4 * np.append(cuts, len(ids))).tolist()
            out |= {u: raw[x:y] for u, x, y in zip(own, cuts, cuts[1:], strict=False)}
        return out | dict(zip(apart, map(_ids_bytes, self._ids(list(apart))), strict=True))


@lru_cache(1)
def huggingface_encoder(path: str) -> ColumnEncoder:
    """Encoder by a tokenizers JSON file of byte-level BPE; strings of its special tokens become these, as the library has it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if any(re.search(r"\s|[^\W\d_]\d|\d[^\W\d_]|[^\W_][.,;:!?]", t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("texts may not be cut inside a special token")
    split = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    if tokenizer.normalizer or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space", True):
        raise ValueError("the safe cuts are those of the byte-level pre-tokenizer without prefix and normalizer")
    return ColumnEncoder(_JoinedUnits(tokenizer))


@lru_cache(1)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizers JSON file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


@lru_cache(1)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(1)
def tiktoken_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(1)
def tiktoken_encoder(path: str, pattern: str) -> Encoder:
    """Encoder by a local rank file and the tiktoken library."""
    ordinary = tiktoken_encoding(path, pattern).encode_ordinary
    return Encoder(lambda units: {u: _ids_bytes(ordinary(u)) for u in units})


@lru_cache(1)
def decoder_table(path: str) -> list[bytes]:
    """Raw bytes by id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
