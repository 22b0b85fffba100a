import hashlib
import struct
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mpeg_audio as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    media = m.encode(data)
    payload, n, s = m.decode(media)
    assert payload == m.pad(data) and payload[:n] == data and len(payload) % 192 == 0 and payload
    assert s["crc_bad"] == 0 and s["skipped"] == 0 and s["crc_good"] == len(s["offsets"]) + 1
    assert s["vbr"]["frames"] == len(s["offsets"]) and s["duration"] == Fraction(1152 * len(s["offsets"]), 32000)
    assert s["offsets"] == [o for o in s["offsets"] if media[o] == 0xFF and media[o + 1] == 0xFA]


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX"])
@pytest.mark.parametrize("size", [100, 192, 1400, 3000])
def test_text_that_looks_like_a_tag(mark, size):
    found = 0
    for at in range(size - len(mark) + 1):
        data = b"x" * at + mark + b"x" * (size - len(mark) - at)
        media = m.encode(data)
        payload, n, s = m.decode(media)
        assert payload == m.pad(data) and n == size and s["skipped"] == 0 and s["vbr"]["frames"] == len(s["offsets"])
        found += s["vbr"]["frames"] > m.parse_stream(m.encode(b"x" * size))["vbr"]["frames"]
    assert found <= mark.count(b"TAG") + (mark == b"APETAGEX")  # that mark holds the other one


def test_lost_payload_is_an_error():
    media = m.encode(b"x" * 5000)
    with pytest.raises(ValueError):
        m.decode(media[:-10])


def test_resynchronises_after_junk_and_false_headers():
    media = m.encode(b"\xff\xfb\x90\x00" * 2000)
    s = m.parse_stream(media)
    cut = s["offsets"][2]
    broken = m.parse_stream(media[:cut] + b"junk\xff\xfb\x90junk" + media[cut:])
    assert broken["skipped"] == 11 and len(broken["offsets"]) == len(s["offsets"]) and broken["offsets"][2] == cut + 11


def test_wrong_checksum_is_counted():
    media = bytearray(m.encode(b"abc"))
    at = m.parse_stream(bytes(media))["offsets"][0]
    media[at + 8] ^= 1
    assert m.parse_stream(bytes(media))["crc_bad"] == 1


def test_crc_of_a_known_vector():
    def slow(data):
        c = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = (c >> 15) ^ (byte >> bit & 1)
                c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        return c

    assert all(m.crc16(d) == slow(d) for d in (b"", b"\x00", b"123456789", bytes(range(40))))


def test_tags_and_tables():
    frame = bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(413)
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + bytes(6) + struct.pack(">II", 1000, 2) + struct.pack(">HHHH", 2, 1, 2, 1)
    vbri[62:66] = struct.pack(">HH", 417, 417)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    s = m.parse_stream(bytes(vbri) + frame * 3 + v1)
    assert s["vbr"]["kind"] == "VBRI" and s["vbr"]["frames"] == 2 and len(s["offsets"]) == 3
    assert s["tags"]["title"] == "Song" and s["tags"]["artist"] == "Band" and s["duration"] == Fraction(3 * 1152, 44100)
    assert m.seek_offset(s, 0) == 417 and m.seek_offset(s, 100) is None
    assert m.parse_stream(b"")["duration"] == 0 and m.parse_stream(b"no audio at all")["offsets"] == []


def slow_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = (c >> 15) ^ b
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def bits_of(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


@pytest.mark.parametrize("layer", [1, 2])
@pytest.mark.parametrize("mode", [0x00, 0x40, 0x50, 0x70, 0xC0])  # stereo, joint from subband 4, 8 and 16 on, mono
@pytest.mark.parametrize("head", [(0xFC, 5, 0), (0xFC, 9, 4), (0xFC, 14, 8), (0xF4, 5, 0)])  # versions, bit rates and sample rates
def test_checksums_of_layers_one_and_two(layer, mode, head):
    version, rate_at, hz = head
    four = bytes((0xFF, version & 0xF8 | (4 - layer) << 1, rate_at << 4 | hz, mode))
    h = m.Header.parse(four, 0)
    assert h.layer == layer and h.protected
    body = bytes((i * 37 + 11) % 256 for i in range(h.length - 6))
    bits, channels = bits_of(body), 1 if mode == 0xC0 else 2
    bound = 4 + 4 * (mode >> 4 & 3) if mode >> 6 == 1 else 32
    if layer == 1:
        covered = 4 * (32 if channels == 1 else 32 + bound)
    else:
        covered, scale = 0, 0
        for subband, width in enumerate(m.allocation_table(h)):
            for _ in range(channels if subband < bound else 1):
                if any(bits[covered : covered + width]):
                    scale += 2 * (1 if subband < bound else channels)
                covered += width
        covered += scale
    crc = slow_crc(bits_of(four[2:]) + bits[:covered])
    frame = four + crc.to_bytes(2, "big") + body
    s = m.parse_stream(frame * 3)
    assert (s["crc_good"], s["crc_bad"], len(s["offsets"])) == (3, 0, 3)
    wrong = bytearray(frame * 3)
    wrong[7] ^= 0x10
    assert m.parse_stream(bytes(wrong))["crc_bad"] == 1


def test_subbands_of_layer_two():
    sizes = {k: sum(n for _, n in v) for k, v in m.ALLOCATION.items()}
    assert sizes == {"a": 27, "b": 30, "c": 8, "d": 12, "lsf": 30}


def test_streams_of_mixed_rates_have_exact_durations():
    fast, slow = bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(413), bytes((0xFF, 0xFB, 0x98, 0xC0)) + bytes(572)
    s = m.parse_stream(fast * 3 + slow * 2 + fast)
    assert s["duration"] == Fraction(4 * 1152, 44100) + Fraction(2 * 1152, 32000) and s["samples"] == 6 * 1152
    at = [Fraction(0)]
    for rate in (44100, 44100, 44100, 32000, 32000):
        at.append(at[-1] + Fraction(1152, rate))
    assert [m.seek_offset(s, t) for t in at] == s["offsets"] and m.seek_offset(s, s["duration"]) is None
    assert m.seek_offset(s, at[4] - Fraction(1, 10**6)) == s["offsets"][3]


def test_tags_of_all_versions():
    audio = m.encode(b"x")[m.parse_tags(m.encode(b"x"))[1] :]
    size = lambda n: n.to_bytes(4, "big")
    v22 = b"TT2" + (5).to_bytes(3, "big") + b"\0Song" + b"TXX" + (6).to_bytes(3, "big") + b"\0k\0val"
    for major, flags, body, want in (
        (2, 0, v22, {"TT2": "Song", "TXX:k": "val"}),
        (3, 0x40, size(6) + bytes(6) + b"TIT2" + size(5) + b"\0\0" + b"\0Song", {"TIT2": "Song"}),
        (3, 0x80, (b"TIT2" + size(5) + b"\0\0" + b"\x00a\xffbc").replace(b"\xff", b"\xff\x00"), {"TIT2": "a\xffbc"}),
        (4, 0x40, m.synchsafe(6) + b"\x01\0" + b"TIT2" + m.synchsafe(5) + b"\0\0" + b"\x03Song", {"TIT2": "Song"}),
        (4, 0, b"TIT2" + m.synchsafe(7) + b"\0\x02" + b"\x00a\xff\x00bcd", {"TIT2": "a\xffbcd"}),
        (4, 0, b"TIT2" + m.synchsafe(9) + b"\0\x01" + m.synchsafe(5) + b"\x03Song" + b"TALB" + m.synchsafe(3) + b"\0\0" + b"\x03AB", {"TIT2": "Song", "TALB": "AB"}),
    ):
        s = m.parse_stream(b"ID3" + bytes((major, 0, flags)) + m.synchsafe(len(body)) + body + audio)
        assert s["tags"] == want and s["skipped"] == 0 and len(s["offsets"]) == 1


def test_column(spark, odd_docs, no_docs):
    rows = odd_docs.select("text", m.digest_column(F.col("text")).alias("m")).select("text", "m.*").collect()
    for r in rows:
        payload = m.pad((r["text"] or "").encode())
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert len({r["feature"] for r in rows if not r["text"]}) == 1
    assert no_docs.select(m.digest_column(F.col("text"))).count() == 0
    stored = odd_docs.select(m.encode_column(F.col("text").cast("binary")).alias("a")).select(m.parse_column(F.col("a")).alias("s")).select("s.*").collect()
    assert all(r["crc_bad"] == 0 and r["rate"] == 32000 for r in stored)
