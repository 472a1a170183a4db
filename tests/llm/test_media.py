import hashlib
import zlib

import numpy as np
import pytest

from foldspark.llm import flac, flac_general
from foldspark.llm import media as M

from .conftest import prose


def payloads():
    rng = np.random.default_rng(0)
    wave = (128 + 60 * np.sin(np.arange(5760) / 9) + rng.normal(0, 3, 5760)).astype(np.uint8).tobytes()
    noise = rng.integers(0, 256, 2304, dtype=np.uint8).tobytes()
    return [wave, noise, b"\xff" * 576, b"\x00" * 1152, (bytes(range(256)) * 9)[:1728], prose(1, 400).encode().ljust(576 * 6, b"\xff")[: 576 * 6], b"\x00\xff" * 288]


def test_round_trip_in_lanes_and_bit_by_bit():
    streams = flac.encode(payloads())
    for payload, stream, samples in zip(payloads(), streams, flac.decode(streams), strict=True):
        assert (samples + 128).astype(np.uint8).tobytes() == payload
        assert (flac_general.decode_stream(stream, flac.Info(stream)) == samples).all()
        assert flac.encode([payload])[0] == stream  # whatever stands beside it
    assert len(streams[0]) < 0.75 * len(payloads()[0])


def test_many_frames_and_seeking():
    payload = np.random.default_rng(1).integers(90, 140, 576 * 300, dtype=np.uint8).tobytes()
    stream = flac.encode([payload])[0]
    info = flac.Info(stream)
    assert len(info.seek) == 4 and info.n == len(payload)
    for at, n in ((0, 10), (575, 2), (64 * 576, 576), (100_000, 3000), (len(payload) - 5, 5)):
        assert (flac.decode_from(stream, at, n) + 128).astype(np.uint8).tobytes() == payload[at : at + n]
    for n in (0, 127, 128, 2047, 2048, 65_535, 65_536, 2**21 - 1, 2**21, 2**26):  # frame numbers as extended UTF-8
        raw = flac.frame_number(n)
        assert n > 0x10FFFF or 0xD800 <= n < 0xE000 or raw == chr(n).encode()


def test_a_header_inside_a_frame_is_no_frame_end():
    """A verbatim frame that holds the bytes of the next frame's header."""
    rng = np.random.default_rng(3)
    first = bytearray(rng.integers(0, 256, 576, dtype=np.uint8).tobytes())
    false_head = flac.frame_head(1)
    first[300 : 300 + len(false_head)] = bytes(x ^ 0x80 for x in false_head)  # samples are stored with the top bit turned
    payload = bytes(first) + rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    stream, good = flac.encode([payload])[0], flac.encode([b"\x11" * 1152])[0]
    assert stream.count(false_head) == 2
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode([stream, good])] == [payload, b"\x11" * 1152]
    assert (flac.decode_from(stream, 100, 700) + 128).astype(np.uint8).tobytes() == payload[100:800]
    assert [(a, n) for a, n, _ in flac.pcm_blocks(stream)] == [(576 * i, 576) for i in range(4)]
    assert (np.frombuffer(b"".join(p for _, _, p in flac.pcm_blocks(stream)), np.int8).astype(int) + 128).astype(np.uint8).tobytes() == payload


@pytest.mark.parametrize("where", ["header", "body", "footer", "md5"])
def test_damage_is_found(where):
    stream = bytearray(flac.encode([payloads()[0]])[0])
    info = flac.Info(bytes(stream))
    at = {"header": info.frames_at + 2, "body": info.frames_at + 100, "footer": len(stream) - 1, "md5": 26}[where]
    stream[at] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])
    with pytest.raises(ValueError):
        flac_general.decode_stream(bytes(stream), flac.Info(bytes(stream)))


def bits(*fields):
    text = "".join(f"{value & ((1 << width) - 1):0{width}b}" for value, width in fields)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def rice(value, k):
    folded = value << 1 if value >= 0 else -value * 2 - 1
    return [(1, (folded >> k) + 1), (folded & ((1 << k) - 1), k)] if k else [(1, folded + 1)]


def test_foreign_layouts():
    """Stereo of 16 bits as mid and side: wasted bits, two partitions, an escaped one, a block of its own size."""
    left, right = np.array([10, 14, 20, 30, 38, 40]) * 4, np.array([8, 12, 22, 26, 36, 44]) * 4
    middle, side = (left + right) >> 1, left - right
    head = bits((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (10, 4), (4, 3), (0, 1), (0, 8), (5, 8))
    head += bytes([flac.crc8(head)])
    m, s = middle >> 2, side >> 3  # two and three wasted bits
    first = [(0, 1), (9, 6), (1, 1), (1, 2), (m[0], 14), (0, 2), (1, 4), (1, 4)]
    d = np.diff(m).tolist()
    for r in d[:2]:
        first += rice(r, 1)
    first += [(15, 4), (6, 5), *[(r, 6) for r in d[2:]]]
    second = [(0, 1), (8, 6), (1, 1), (1, 3), (0, 2), (0, 4), (2, 4)]
    for r in s.tolist():
        second += rice(r, 2)
    frame = head + bits(*[(int(v), w) for v, w in first + second])
    check = 0
    for x in frame:
        check = (check << 8 & 0xFFFF) ^ int(flac.CRC16[check >> 8 ^ x])
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (44_100 << 44 | 1 << 41 | 15 << 36 | 6).to_bytes(8, "big")
    samples = np.stack([left, right], 1)
    info += hashlib.md5(samples.astype("<i2").tobytes()).digest()
    stream = b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame + check.to_bytes(2, "big")
    assert (middle % 4 == 0).all() and (side % 8 == 0).all()
    assert (flac.decode([stream])[0] == samples).all()
    assert [(a, n) for a, n, _ in flac.pcm_blocks(stream)] == [(0, 6)]


def test_digests(make, edge_rows):
    found = M.media_digests(make(edge_rows)).collect()
    assert len(found) == len(edge_rows)
    same: dict = {}
    for (i, text, *_), r in zip(edge_rows, found, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = flac.encode([payload])[0]
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert same.setdefault(text or "", r["feature"]) == r["feature"]
    assert M.media_digests(make(edge_rows).limit(0)).count() == 0


def test_media_columns_and_blocks(make, edge_rows):
    table = M.with_media(make(edge_rows).filter("doc_id IS NOT NULL"))
    back = table.select("text", M.text_of(table["media"], table["n_chars"] * 0 + 4).alias("four")).filter("length(text) > 4 AND text NOT LIKE '%ï%'")
    assert all(r["four"] == r["text"][:4] for r in back.filter("doc_id <> 8").collect())
    blocks = M.pcm_table(table.select("doc_id", "media")).filter("doc_id = 7").orderBy("first_sample").collect()
    text = next(t for i, t, *_ in edge_rows if i == 7).encode()
    assert [b["first_sample"] for b in blocks] == list(range(0, 576 * len(blocks), 576))
    pcm = b"".join(bytes(b["pcm"]) for b in blocks)
    assert (np.frombuffer(pcm, np.int8).astype(int) + 128).astype(np.uint8).tobytes()[: len(text)] == text
