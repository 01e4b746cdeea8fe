"""MPEG audio columns: frames, tags, seek tables, durations.

``parse`` reads a stream as found in the wild: it skips ID3v2 tags, finds frame headers
and, where bytes between frames are damaged or foreign, resynchronises at the next header
that another one confirms; it reads Xing, Info and VBRI tables, verifies the checksum of
protected Layer III frames, and takes a trailing ID3v1 tag off where the chain of frames ends, so
that a frame's own bytes are never taken for one.  Durations are exact: samples and sampling rate,
both integers.  Each frame's offset is a seek point.

``encode`` stores bytes without loss in a playable stream: Layer III frames at 48 kHz,
mono, whose side information declares no audio data, so that they decode to silence and
the whole main-data area is ancillary data, which holds the bytes.  All frames are
protected by a checksum.  Full frames are of 320 kbit/s; the last is the shortest that
holds the rest.  An ID3v2 tag states the payload's length, a Xing frame the number of
frames and bytes and a table of contents.

Edge cases: null and empty texts are stored as one unit of blanks; an empty stream, or one
without a confirmed frame, has no frames and the duration 0; a last frame that is cut off
is not counted; free-format frames are not recognised; rows are independent, so repeated
rows, ties and any doc_id (null too) pass through; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by version 1 or later, layer and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Fixed values of the format: Hz by version bits and index.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Payload bytes come in multiples of this.
UNIT = 192
TAG_KEY = "payload-bytes"


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int  # bytes of the frame
    samples: int

    @property
    def kind(self) -> tuple[int, int, int, bool]:
        """What the frames of a stream have in common."""
        return self.version, self.layer, self.rate, self.protected

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return ((17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)) if self.layer == 3 else 0


@lru_cache(1 << 12)
def header(word: int) -> Header | None:
    """What four bytes, big-endian, mean as a frame header; None if they are none."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bitrate, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 3 else 2, layer][bitrate]
    hz, pad = RATES[version][rate], word >> 9 & 1
    if layer == 1:
        samples, length = 384, (12_000 * kbps // hz + pad) * 4
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        length = samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not word >> 16 & 1, kbps, hz, word >> 6 & 3 == 3, length, samples)


@lru_cache(1 << 12)
def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    """A parsed stream. offsets and headers are of the audio frames, without that of a table."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    bad_crc: int = 0
    checked: int = 0
    skipped: int = 0  # bytes that belong to nothing

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> tuple[int, int]:
        """Samples and sampling rate of the first frame: an exact number of seconds."""
        return self.samples, self.headers[0].rate if self.headers else 1

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample."""
        at = 0
        for offset, h in zip(self.offsets, self.headers, strict=True):
            at += h.samples
            if sample < at:
                return offset
        raise ValueError(f"no sample {sample}")


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _text(data: bytes) -> str:
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return data[1:].decode(kinds.get(data[0], "latin-1"), "replace") if data else ""


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The end of the tag at ``at``, whose text frames go to tags; ``at`` if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos = 0
    if flags & 0x40 and len(body) >= 4:
        pos = _syncsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    wide = major > 2
    while pos + (10 if wide else 6) <= len(body) and body[pos]:
        name = body[pos : pos + (4 if wide else 3)].decode("latin-1")
        n = body[pos + 4 : pos + 8] if wide else body[pos + 3 : pos + 6]
        n = _syncsafe(n) if major == 4 else int.from_bytes(n, "big")
        pos += 10 if wide else 6
        if name.startswith("T"):
            value = _text(body[pos : pos + n])
            if name in ("TXXX", "TXX"):
                key, _, value = value.partition("\0")
                name = f"TXXX:{key}"
            tags[name] = value.strip("\0")
        pos += n
    return at + 10 + size + (10 if flags & 0x10 else 0)


def _vbr_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table of a frame, if it has one."""
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI":
        entries, scale, width, per = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58, 60))
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "per_entry": per, "toc": toc}
    return {}


def _confirmed(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether the frame at ``at`` ends with the data, or where one of its kind begins."""
    after = data[at + h.length : min(at + h.length + 4, end)]
    n = header(int.from_bytes(after, "big")) if len(after) == 4 else None
    return at + h.length == end or (n is not None and n.kind == h.kind)


def _sync(data: bytes, at: int, end: int) -> int:
    """The next offset with a header that another one, or the end, confirms; -1 if none."""
    while 0 <= (at := data.find(b"\xff", at, end)) and at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h and _confirmed(data, at, h, end):
            return at
        at += 1
    return -1


def _id3v1(data: bytes) -> dict[str, str]:
    return {k: v for k, a, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30)) if (v := data[a : a + n].split(b"\0")[0].decode("latin-1").strip())}


def parse(data: bytes) -> Stream:
    s, at, end = Stream(), 0, len(data)
    tag = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else -1  # a tag only if no frame holds it
    while (to := _id3v2(data, at, s.tags)) > at:
        at = min(to, end)
    kind = None
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if at <= tag and (not h or tag < at + h.length and not _confirmed(data, at, h, end)):
            s.tags |= _id3v1(data[tag:])
            end, tag = tag, -1
            continue
        if not h or at + h.length > end or (kind and h.kind != kind) or (not kind and _sync(data, at, at + h.length + 4 if at + h.length + 4 <= end else end) != at):
            to = _sync(data, at + 1, end)
            s.skipped += (to if to >= 0 else end) - at
            at = to if to >= 0 else end
            continue
        first = kind is None
        kind = h.kind
        if h.protected and h.layer == 3:
            s.checked += 1
            s.bad_crc += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first and h.layer == 3 and (table := _vbr_table(data[at : at + h.length], h)):
            s.table = table
        else:
            s.offsets.append(at)
            s.headers.append(h)
        at += h.length
    return s


def _frame_head(kbps: int) -> bytes:
    """Header, checksum and side information of a silent frame, protected, 48 kHz, mono."""
    word = 0xFFFA0000 | BITRATES[1, 3].index(kbps) << 12 | 1 << 10 | 3 << 6 | 4
    head, side = word.to_bytes(4, "big"), bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_HEADS = {k: _frame_head(k) for k in BITRATES[1, 3][1:]}
_HEAD = 23
_SIZES = {k: 3 * k for k in _HEADS}  # bytes of a frame: 144 * kbps * 1000 / 48000


def encode(payload: bytes) -> bytes:
    """A stream that holds the payload; see the module's docstring."""
    most, frames = _SIZES[320] - _HEAD, []
    for i in range(0, len(payload), most):
        part = payload[i : i + most]
        kbps = next(k for k, n in _SIZES.items() if n - _HEAD >= len(part))
        frames.append(_HEADS[kbps] + part + bytes(_SIZES[kbps] - _HEAD - len(part)))
    sizes = [len(f) for f in frames]
    total = sum(sizes)
    at, toc = 0, []
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    for i in range(100):
        at = ends[i * len(frames) // 100]
        toc.append(at * 256 // total if total else 0)
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (total + _SIZES[64]).to_bytes(4, "big") + bytes(toc)
    text = b"\x03" + TAG_KEY.encode() + b"\0" + str(len(payload)).encode()
    frame = b"TXXX" + _safe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _safe(len(frame)) + frame
    return tag + _HEADS[64] + table + bytes(_SIZES[64] - _HEAD - len(table)) + b"".join(frames)


def _safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def decode(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a stream made by encode(), and the stream as parsed."""
    s = parse(data)
    if s.bad_crc or s.skipped or s.table.get("frames") != len(s.offsets):
        raise ValueError("the stream is damaged")
    at = [(o + 4 + 2 * h.protected + h.side, o + h.length) for o, h in zip(s.offsets, s.headers, strict=True)]
    return b"".join(data[a:z] for a, z in at)[: int(s.tags[f"TXXX:{TAG_KEY}"])], s


def pad(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these bytes with blanks up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % UNIT if data else UNIT)


def feature(s: Stream) -> str:
    """Frames, exact duration, mean bitrate and a digest of the seek offsets."""
    samples, rate = s.duration
    size = sum(h.length for h in s.headers)
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
    return f"frames={len(s.offsets)};duration={samples}/{rate};bps={size * 8 * rate // samples if samples else 0};crc_ok={s.checked - s.bad_crc};seek_crc32={seek}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in shared.slices(batch, "text", 8_000_000):
            ids, texts = shared.columns(b, "doc_id", "text")
            padded = [pad(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in padded], pa.int64()), pa.array([encode(p) for _, p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, seek_offsets array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in shared.slices(batch, "media", 8_000_000):
            ids, sizes, media = shared.columns(b, "doc_id", "n_bytes", "media")
            rows = []
            for m in media.to_pylist():
                payload, s = decode(m)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(s), *s.duration, s.offsets))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, sizes, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in RESULT.split(", ")])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column of each row's text, written as a table."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return shared.table(docs.mapInArrow(_encode, "doc_id long, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold (RESULT); media: doc_id, n_bytes, media."""
    return media.mapInArrow(_features, RESULT)
