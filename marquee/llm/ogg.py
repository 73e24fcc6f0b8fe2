"""Ogg media columns: page checksums, packets from lacing values, logical streams, granule times.

A stored payload is an 8-bit PCM stream (serial 1: a header packet, then packets of PACKET
samples) interleaved with a cue stream (serial 2: a header packet, then one packet per CUE samples
that holds the block's start and CRC). Pages follow RFC 3533; equal payloads give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_text

PCM, CUES = 1, 2
RATE, PACKET, CUE = 8000, 4096, 65536
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def page_crc(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, not reflected, start 0), by the reflected CRC of flipped bytes."""
    plain = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "little").translate(_FLIP), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", page_crc(blank)) + blank[26:]


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream from (packet, granule at its end); returns (granule, page)."""
    segments: list[tuple[bytes, int, bool]] = []  # bytes, granule if a packet ends here (else -1), starts a packet
    pages, number = [], 0

    def flush(last: bool) -> None:
        nonlocal segments, number
        granule = next((g for _, g, _ in reversed(segments) if g >= 0), -1)
        kind = (not segments[0][2]) | 2 * (number == 0) | 4 * last
        pages.append((granule, _page(kind, granule, serial, number, bytes(len(s) for s, _, _ in segments), b"".join(s for s, _, _ in segments))))
        segments, number = [], number + 1

    for k, (data, granule) in enumerate(packets):
        n = len(data) // 255 + 1
        for j in range(n):
            if len(segments) == 255:
                flush(False)
            segments.append((data[255 * j : 255 * j + 255], granule if j == n - 1 else -1, j == 0))
        if k == 0 and len(packets) > 1:
            flush(False)  # the header has a page of its own
    flush(True)
    return pages


def encode_ogg(payload: bytes) -> bytes:
    """One Ogg file that holds payload as 8-bit samples, with its cues multiplexed in time order."""
    n = len(payload)
    sound = [(b"PCM     " + struct.pack("<HHIBB", 0, 1, RATE, 8, 1), 0)]
    sound += [(payload[i : i + PACKET], min(n, i + PACKET)) for i in range(0, n, PACKET)]
    cues = [(b"CUES" + struct.pack("<I", CUE), 0)]
    cues += [(struct.pack("<QI", i, zlib.crc32(payload[i : i + CUE])), i) for i in range(0, n, CUE)]
    first, second = write_stream(PCM, sound), write_stream(CUES, cues)
    rest = sorted([(g, 1, i, p) for i, (g, p) in enumerate(first[1:])] + [(g, 0, i, p) for i, (g, p) in enumerate(second[1:])], key=lambda x: (x[1], x[2]))
    return first[0][1] + second[0][1] + b"".join(x[3] for x in rest)


def read_pages(data: bytes):
    """Yields (kind, granule, serial, number, lacing, body) of each page; raises OggError on damage."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or end > len(data):
            raise OggError(f"page at byte {at} is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield kind, granule, serial, number, lacing, data[at + 27 + count : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream as (bytes, granule); granule is None but for the last packet that ends on a page."""
    streams: dict[int, list] = {}
    partial: dict[int, bytes] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    for kind, granule, serial, number, lacing, body in read_pages(data):
        if (kind & 2 > 0) != (serial not in streams) or serial in ended:
            raise OggError(f"stream {serial} begins or ends out of place")
        if number != numbers.get(serial, -1) + 1 or (kind & 1 > 0) != (serial in partial):
            raise OggError(f"stream {serial} lacks a page before {number}")
        packets, at, piece = streams.setdefault(serial, []), 0, partial.pop(serial, b"")
        finished, parts = 0, [piece]
        for size in lacing:
            parts.append(body[at : at + size])
            at += size
            if size < 255:
                packets.append((b"".join(parts), None))
                finished, parts = finished + 1, []
        if lacing and lacing[-1] == 255:
            partial[serial] = b"".join(parts)
        if finished:
            packets[-1] = (packets[-1][0], granule)
        numbers[serial] = number
        if kind & 4:
            ended.add(serial)
    if partial or ended != set(streams):
        raise OggError("a stream has no end")
    return streams


def packet_times(packets: list[tuple[bytes, int | None]]) -> list[tuple[int, int]]:
    """(start, end) in samples of each sound packet, counted back from the granule position of its page."""
    ends, known = [0] * len(packets), None
    for i in reversed(range(len(packets))):
        if packets[i][1] is not None:
            known = packets[i][1]
        if known is None:
            raise OggError("a packet has no granule position")
        ends[i] = known
        known -= len(packets[i][0])
    return [(e - len(p), e) for e, (p, _) in zip(ends, packets, strict=True)]


def decode_ogg(data: bytes) -> tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]:
    """Payload, (start, end) of each sound packet in samples, and the cues (start, crc) after a check of each."""
    streams = demultiplex(data)
    if PCM not in streams or not streams[PCM][0][0].startswith(b"PCM     "):
        raise OggError("no PCM stream")
    sound = streams[PCM][1:]
    times = packet_times(sound)
    if any(a[1] != b[0] for a, b in zip(times, times[1:], strict=False)) or (times and times[0][0]):
        raise OggError("granule positions leave a gap")
    payload = b"".join(p for p, _ in sound)
    cues = [struct.unpack("<QI", p) for p, _ in streams.get(CUES, [])[1:]]
    if any(zlib.crc32(payload[i : i + CUE]) != crc for i, crc in cues):
        raise OggError("a cue's checksum differs")
    return payload, times, cues


def feature(payload: bytes, times: list[tuple[int, int]], cues: list) -> str:
    """Sample count, packets, cues, duration, mean, power and sign changes of the decoded sound; integers only."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"samples={len(x)};packets={len(times)};cues={len(cues)};us={times[-1][1] * 1_000_000 // RATE if times else 0};sum={int(centred.sum())};power={int((centred * centred).sum())};crossings={crossings};peak={int(np.abs(centred).max()) if len(x) else 0}"


def pad64(raw: bytes) -> bytes:
    """raw with zero bytes up to the next positive multiple of 64."""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 (null: empty), padded, as an Ogg file. Other columns are dropped."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, _):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return [batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode_ogg(pad64(r)) for r in raws], pa.binary())]

    return map_text(df, [F.col(id_col), F.col(text_col)], fn, f"{id_col} {kind}, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload digests, media digests, feature) from stored bytes; null bytes give nulls, a damaged file fails the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch, _):
        rows = []
        for media in batch.column(2).to_pylist():
            if media is None:
                rows.append((None,) * 6)
                continue
            payload, times, cues = decode_ogg(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, times, cues)))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]

    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_text(df, [F.col(id_col), F.col("n_bytes"), F.col(media_col)], fn, schema)
