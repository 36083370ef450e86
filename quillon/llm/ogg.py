"""Payloads in Ogg: pages with checksums, packets from lacing values, logical streams, timestamps from granule positions.

A payload is written as 8-bit samples: packets of 576 samples in one logical stream, and beside it, page by page, a second
logical stream with the number of samples so far. Both are multiplexed. Reading verifies each page's checksum, tells the
streams apart by their serial numbers, joins lacing values to packets and dates packets by granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batch

UNIT, RATE = 576, 8000
#: Fixed values of the container: capture pattern, header flags, the most lacing values in a page.
PATTERN, CONTINUED, FIRST, LAST, LACES = b"OggS", 1, 2, 4, 255
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_REVERSED_16 = np.array([int(f"{i:016b}"[::-1], 2) for i in range(1 << 16)], np.uint32)
SAMPLES, MARKS = 0x53414D50, 0x4D41524B


def checksum(page: bytes) -> int:
    """CRC-32 of the plain (not reflected) polynomial 0x04C11DB7 from 0, by way of zlib's reflected one."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(_REVERSED_16[c & 0xFFFF]) << 16 | int(_REVERSED_16[c >> 16])


def page(serial: int, sequence: int, granule: int, flags: int, laces: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(PATTERN, 0, flags, granule, serial, sequence, 0, len(laces)) + laces
    out = bytearray(head + body)
    out[22:26] = checksum(bytes(out)).to_bytes(4, "little")
    return bytes(out)


def write(payload: bytes, unit: int = UNIT) -> bytes:
    """``payload`` (a positive multiple of ``unit`` bytes) as two multiplexed logical streams."""
    lace = b"\xff" * (unit // 255) + bytes([unit % 255])
    per_page = LACES // len(lace)
    head = b"\x00pcm8" + struct.pack("<IHH", RATE, 1, unit)
    out = [page(SAMPLES, 0, 0, FIRST, bytes([len(head)]), head), page(MARKS, 0, 0, FIRST, b"\x05", b"\x00mark")]
    step = per_page * unit
    for k, at in enumerate(range(0, len(payload), step)):
        body = payload[at : at + step]
        end = at + len(body)
        last = LAST if end == len(payload) else 0
        out.append(page(SAMPLES, k + 1, end, last, lace * (len(body) // unit), body))
        out.append(page(MARKS, k + 1, end, last, b"\x08", struct.pack("<Q", end)))
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: Time at each packet's end in samples; -1 where no packet ends a page that says.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: bytes = b""


def read(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. ValueError tells what is damaged: pattern, checksum, sequence or end."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) < at + _HEAD.size or media[at : at + 4] != PATTERN:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(media, at)
        laces = media[at + 27 : at + 27 + n]
        begin = at + 27 + n
        end = begin + sum(laces)
        whole = media[at:end]
        if version or len(whole) < end - at or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        s = streams.setdefault(serial, Stream())
        if sequence != s.pages or bool(flags & FIRST) != (s.pages == 0) or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"page {sequence} of stream {serial} is out of place")
        s.pages += 1
        s.ended |= bool(flags & LAST)
        i, done = begin, 0
        for lace in laces:
            s.part += media[i : i + lace]
            i += lace
            if lace < 255:
                s.packets.append(s.part)
                s.granules.append(-1)
                s.part, done = b"", done + 1
        if done:
            s.granules[-1] = granule
        at = end
    for serial, s in streams.items():
        if s.part or not s.ended:
            raise ValueError(f"stream {serial} has no end")
    return streams


def features(streams: dict[int, Stream]) -> tuple[bytes, str]:
    """The payload that was stored, and what is known of it: times come from granule positions, not from the payload."""
    samples, marks = streams[SAMPLES], streams[MARKS]
    payload = b"".join(samples.packets[1:])
    stated = [g for g in samples.granules[1:] if g >= 0]
    marked = [struct.unpack("<Q", p)[0] for p in marks.packets[1:]]
    if marked != stated or marked[-1] != len(payload):
        raise ValueError("granule positions don't agree with the packets")
    x = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(x, minlength=256)
    share = histogram[histogram > 0] / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return payload, f"streams=2;pages={samples.pages + marks.pages};packets={len(samples.packets) - 1};ms={marked[-1] * 1000 // RATE};sum={int(x.sum(dtype=np.int64))};bits={-(share * np.log2(share)).sum():.4f};crossings={crossings}"


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _stored(batches):
    for b in batches:
        rows: list[list] = [[], [], []]
        size = 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            media = write(raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT)))
            for c, v in zip(rows, (doc_id, len(raw), media), strict=True):
                c.append(v)
            size += len(media)
            if size > 1 << 22:
                yield batch(_MEDIA, *rows)
                rows, size = [[], [], []], 0
        yield batch(_MEDIA, *rows)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with bytes 255 to a positive multiple of 576, as an Ogg file. Null
    and empty texts are one unit of padding. Equal texts have equal media. Other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read_back(batches):
    for b in batches:
        rows: list[list] = [[] for _ in _OUT]
        for doc_id, n, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            media = cell.as_buffer().to_pybytes()
            payload, feature = features(read(media))
            found = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            for c, v in zip(rows, found, strict=True):
                c.append(v)
        yield batch(_OUT, *rows)


def describe(media: DataFrame) -> DataFrame:
    """Reads media back as written by ``store`` and returns digests of payload and media, and features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
