"""MPEG audio columns: write bytes into valid frames, and parse any MPEG audio stream.

The reader resynchronises on frame headers (a header counts only if a second one, or the end,
follows where its length says), parses ID3v1, ID3v2 (2.2 to 2.4, with extended headers and
unsynchronisation) and APE tags and the Xing, Info and VBRI tables, verifies the CRC-16 of protected frames
of all layers, and gives exact durations (samples over rate, summed over rates as a fraction) and the
byte offset of every frame for seeking. It reads layers I to III of MPEG 1, 2 and 2.5.

The writer stores a payload losslessly in a layer III stream whose granules are silent: each frame's
side information says that no main data is used, so the rest of the frame is ancillary data, and that
is where the bytes go. Full frames have the highest bit rate; the last frame takes the lowest one that
holds what is left, so the stream has a variable bit rate, and a first frame holds its Xing table. Where
the payload's end would be read as a tag, an empty frame follows.

Defined results: null is stored like empty bytes; equal payloads give equal streams; junk between
frames is skipped and counted; a stream without a frame has duration 0 and no offsets; a wrong CRC is
counted and never raises; payloads of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches

# Bit rates in kbit/s by (version 1 or not, layer), and sample rates by version (ISO 11172-3 and 13818-3).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Subbands of layer II by bits of their allocation, as (bits, subbands), by table (ISO 11172-3 B.2a to B.2d, 13818-3 B.1).
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 192
RATE = 32000
SIDE = 17  # bytes of side information of a version 1 mono frame
OVERHEAD = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first bits of the data."""
    c = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        top = c >> 15 ^ data[i // 8] >> 7 - i % 8 & 1
        c = (c << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return c


class Header:
    """A decoded frame header; ``parse`` gives None where the four bytes are no header."""

    __slots__ = ("version", "layer", "protected", "bitrate", "rate", "mono", "bound", "length", "samples", "side")

    @classmethod
    def parse(cls, data: bytes, at: int) -> Header | None:
        if at + 4 > len(data):
            return None
        return _decode(data[at : at + 4])


@lru_cache(maxsize=8192)
def _decode(four: bytes) -> Header | None:
    if four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_at, bits_at = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bits_at in (0, 15) or four[3] & 3 == 2:
        return None
    h = Header()
    h.version, h.layer, h.protected = version, layer, not four[1] & 1
    h.bitrate, h.rate = BITRATES[version == 3, layer][bits_at] * 1000, RATES[version][rate_at]
    h.mono = four[3] >> 6 == 3
    h.bound = 4 + 4 * (four[3] >> 4 & 3) if four[3] >> 6 == 1 else 32  # subbands from here on share what they allocate
    pad = four[2] >> 1 & 1
    h.samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    h.length = (12 * h.bitrate // h.rate + pad) * 4 if layer == 1 else h.samples // 8 * h.bitrate // h.rate + pad
    h.side = 0 if layer != 3 else (17 if h.mono else 32) if version == 3 else (9 if h.mono else 17)
    return h


def allocation_table(h: Header) -> tuple[int, ...]:
    """Bits of the allocation of each subband of a layer II frame."""
    if h.version != 3:
        name = "lsf"
    else:
        each = h.bitrate // (1 if h.mono else 2)
        name = ("d" if h.rate == 32000 else "c") if each <= 48000 else "a" if each <= 80000 or h.rate == 48000 else "b"
    return tuple(bits for bits, n in ALLOCATION[name] for _ in range(n))


def _checked_bits(data: bytes, at: int, h: Header) -> tuple[bytes, int]:
    """What the CRC covers, and how many bits of it: two header bytes, then the side information (III), or the allocation (I) and the selection of scale factors (II)."""
    head, channels = data[at + 2 : at + 4], 1 if h.mono else 2
    if h.layer == 3:
        return head + data[at + 6 : at + 6 + h.side], 16 + 8 * h.side
    if h.layer == 1:
        bits = 4 * (32 if h.mono else min(h.bound, 32) + 32)
        return head + data[at + 6 : at + 6 + -(-bits // 8)], 16 + bits
    body = data[at + 6 : at + 6 + 60]
    value, size, used, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for subband, bits in enumerate(allocation_table(h)):
        for _ in range(channels if subband < h.bound else 1):
            if value >> max(0, size - used - bits) & (1 << bits) - 1:
                chosen += 1 if subband < h.bound else channels
            used += bits
    return head + body, min(16 + used + 2 * chosen, 16 + size)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _synchsafe_value(raw: bytes) -> int:
    return sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=False))


def parse_id3v2(body: bytes, major: int, flags: int) -> dict:
    """Text frames of an ID3v2 tag's body, by frame name; ``TXXX`` and ``TXX`` by their description."""
    tags: dict[str, str] = {}
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at, short = 0, major == 2
    if flags & 0x40 and not short:  # an extended header, whose size counts itself only from 2.4 on
        at = _synchsafe_value(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    width, head = (3, 6) if short else (4, 10)
    while at + head <= len(body) and body[at : at + width].isalnum():
        key, raw = body[at : at + width].decode("latin-1"), body[at + width : at + 2 * width]
        n = _synchsafe_value(raw) if major >= 4 else int.from_bytes(raw, "big")
        frame = body[at + head : at + head + n]
        if major >= 4:
            if body[at + 9] & 0x01:  # the frame begins with its length
                frame = frame[4:]
            if body[at + 9] & 0x02 or flags & 0x80:
                frame = frame.replace(b"\xff\x00", b"\xff")
        if key.startswith("T") and frame:
            text = frame[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(frame[0], "utf-8"), "replace").rstrip("\0")
            if key in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
                key = f"{key}:{name}"
            tags[key] = text.lstrip("\ufeff")
        at += head + n
    return tags


def parse_tags(data: bytes) -> tuple[dict, int, int]:
    """Tags of a stream, and where audio may begin and end."""
    tags, start, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = _synchsafe_value(data[6:10])
        start = min(len(data), 10 + size + (10 if data[5] & 0x10 else 0))
        tags |= parse_id3v2(data[10 : min(len(data), 10 + size)], data[3], data[5])
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[key] = value
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        end = max(start, end - size - (32 if flags & 0x80000000 else 0))
        tags["APE"] = str(size)
    return tags, start, end


def vbr_table(frame: bytes, h: Header) -> dict | None:
    """Xing, Info or VBRI table of a first frame."""
    at = 4 + (2 if h.protected else 0) + h.side
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        at = 4 + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out, flags = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, per = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return None


def parse_stream(data: bytes) -> dict:
    """Everything the stream says: tags, variable-bit-rate table, frames with offsets, CRC results, exact duration."""
    tags, at, end = parse_tags(data)
    offsets, lengths, skipped, good, bad, vbr = [], [], 0, 0, 0, None
    kinds, bits, locked = [], set(), False  # samples and rate of every frame
    while at + 4 <= end:
        h = Header.parse(data, at)
        follows = h is not None and at + h.length <= end and (locked or at + h.length == end or Header.parse(data, at + h.length) is not None)
        if not follows:
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt > 0 else end) - at
            at, locked = (nxt if nxt > 0 else end), False
            continue
        if h.protected:
            if crc16_bits(*_checked_bits(data, at, h)) == int.from_bytes(data[at + 4 : at + 6], "big"):
                good += 1
            else:
                bad += 1
        if not offsets and vbr is None and (table := vbr_table(data[at : at + h.length], h)) is not None:
            vbr = table | {"offset": at}
            at, locked = at + h.length, True
            continue
        offsets.append(at)
        lengths.append(h.length)
        kinds.append((h.samples, h.rate))
        bits.add(h.bitrate)
        at, locked = at + h.length, True
    skipped += end - at if at < end else 0
    by_kind = Counter(kinds)
    return {
        "tags": tags, "vbr": vbr, "offsets": offsets, "lengths": lengths, "skipped": skipped, "crc_good": good, "crc_bad": bad,
        "samples": sum(n * k for (n, _), k in by_kind.items()), "rate": kinds[0][1] if kinds else 0, "kinds": kinds if len(by_kind) > 1 else kinds[:1], "bitrates": sorted(bits),
        "duration": sum((Fraction(n * k, r) for (n, r), k in by_kind.items()), Fraction(0)),
    }


def seek_offset(stream: dict, seconds: Fraction | float) -> int | None:
    """Byte offset of the frame that holds a moment; None beyond the end."""
    if not stream["offsets"] or not 0 <= seconds < stream["duration"]:
        return None
    if len(stream["kinds"]) == 1:
        samples, rate = stream["kinds"][0]
        return stream["offsets"][int(Fraction(seconds) * rate / samples)]
    starts = list(accumulate((Fraction(n, r) for n, r in stream["kinds"]), initial=Fraction(0)))
    return stream["offsets"][bisect_right(starts, Fraction(seconds)) - 1]


def _frame_head(bits_at: int) -> bytes:
    """Header, CRC and empty side information of a protected mono frame."""
    head = bytes((0xFF, 0xFA, bits_at << 4 | RATES[3].index(RATE) << 2, 0xC0))
    side = bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _sizes() -> list[tuple[int, int]]:
    """(bit rate index, bytes of payload) of the frame sizes in use, by size."""
    return [(i, 144 * b * 1000 // RATE - OVERHEAD) for i, b in enumerate(BITRATES[True, 3]) if b]


def pad(data: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of the unit."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def encode(data: bytes | None) -> bytes:
    """A stream that holds the padded bytes, and in its tag how many there were."""
    data = data or b""
    payload, sizes = pad(data), _sizes()
    top_at, top = sizes[-1]
    full, rest = divmod(len(payload), top)
    frames = [_frame_head(top_at) + payload[i * top : (i + 1) * top] for i in range(full)]
    if rest:
        bits_at, room = next(x for x in sizes if x[1] >= rest)
        frames.append(_frame_head(bits_at) + payload[full * top :].ljust(room, b"\0"))
    if frames[-1][-128:-125] == b"TAG" or frames[-1][-32:-24] == b"APETAGEX":  # text that would be read as a tag
        bits_at, room = sizes[0]
        frames.append(_frame_head(bits_at) + bytes(room))
    audio = sum(map(len, frames))
    info_at, room = next(x for x in sizes if x[1] >= 116)
    table = bytearray(b"Xing" + struct.pack(">III", 7, len(frames), audio + room + OVERHEAD))
    starts, seen = [], room + OVERHEAD
    for f in frames:
        starts.append(seen)
        seen += len(f)
    table += bytes(min(255, 256 * starts[min(len(frames) - 1, len(frames) * p // 100)] // seen) for p in range(100))
    info = _frame_head(info_at) + bytes(table).ljust(room, b"\0")
    text = b"\x03" + f"n_bytes\0{len(data)}\0{len(payload)}".encode()
    tag = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synchsafe(len(tag)) + tag + info + b"".join(frames)


def decode(media: bytes) -> tuple[bytes, int, dict]:
    """Payload read back from the frames' ancillary bytes, the count of unpadded bytes, and the stream."""
    stream = parse_stream(media)
    n, _, padded = stream["tags"]["TXXX:n_bytes"].partition("\0")
    body = b"".join(media[o + OVERHEAD : o + size] for o, size in zip(stream["offsets"], stream["lengths"], strict=True))
    if len(body) < int(padded):
        raise ValueError(f"{len(body)} of {padded} payload bytes can be read back")
    return body[: int(padded)], int(n), stream


MEDIA = T.StructType(
    [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


def digest_row(text: str | None) -> tuple:
    """Store a text, read it back from the stored bytes alone, and describe both."""
    media = encode((text or "").encode("utf-8"))
    payload, n, s = decode(media)
    feature = {
        "codec": "mpeg1-layer3", "rate": s["rate"], "frames": len(s["offsets"]), "samples": s["samples"], "duration": f"{s['duration'].numerator}/{s['duration'].denominator}",
        "vbr_frames": s["vbr"]["frames"], "vbr_bytes": s["vbr"]["bytes"], "crc_good": s["crc_good"], "crc_bad": s["crc_bad"], "skipped": s["skipped"], "bitrates": s["bitrates"],
        "first_offset": s["offsets"][0], "middle_offset": seek_offset(s, s["duration"] / 2), "offsets_crc32": zlib.crc32(struct.pack(f">{len(s['offsets'])}Q", *s["offsets"])),
    }
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, sort_keys=True, separators=(",", ":"))


def digest_column(text: Column) -> Column:
    """Struct of the digests and features of every text's stored form."""
    bound_batches()

    @F.pandas_udf(MEDIA)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([digest_row(t) for t in texts], columns=MEDIA.names)

    return digest(text)


def encode_column(data: Column) -> Column:
    """Streams that hold a binary column."""
    bound_batches()

    @F.pandas_udf(T.BinaryType())
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(encode)

    return stored(data)


STREAM = T.StructType(
    [T.StructField(n, t) for n, t in (("duration", T.StringType()), ("duration_samples", T.LongType()), ("rate", T.IntegerType()), ("frame_offsets", T.ArrayType(T.LongType())), ("crc_good", T.LongType()), ("crc_bad", T.LongType()), ("skipped_bytes", T.LongType()), ("tags", T.MapType(T.StringType(), T.StringType())), ("vbr", T.StringType()))]
)


def parse_column(media: Column) -> Column:
    """Struct with the exact duration in seconds (a fraction, as text), samples, first rate, seek offsets, CRC counts, tags and VBR table of any MPEG audio column."""
    bound_batches()

    @F.pandas_udf(STREAM)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [parse_stream(bytes(m) if m is not None else b"") for m in rows]
            yield pd.DataFrame([(f"{s['duration'].numerator}/{s['duration'].denominator}", s["samples"], s["rate"], s["offsets"], s["crc_good"], s["crc_bad"], s["skipped"], s["tags"], json.dumps(s["vbr"], sort_keys=True)) for s in found], columns=STREAM.names)

    return parsed(media)
