"""FLAC: Rice residuals and linear predictors, frame checksums, and PCM blocks with sample offsets.

Frames are the lanes of array operations: frames of many streams are coded and decoded together, one residual of every
frame at a time, so a Python step costs as much for thousands of frames as for one.  ``encode`` makes streams of
8-bit mono samples in blocks of 576 (constant, verbatim, fixed and LPC subframes, one Rice partition).  ``decode`` reads
streams of that layout in lanes and every other stream (more channels, 4 to 32 bits, wasted bits, more partitions,
escaped residuals, variable blocks) bit by bit.  Both verify the CRC-8 of each frame header, the CRC-16 of each frame
and the MD5 of the samples, and raise ValueError for a damaged stream.

A stream carries a seek table, so ``decode_from`` starts at the last point before a sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 576
#: Frames between two points of the seek table.
SEEK_FRAMES = 64
#: Frames that are worked on together.
LANES = 2048
LPC_ORDER = 2
LPC_PRECISION = 10
#: Header bytes of a frame before its number: sync and fixed blocks; 576 samples at 8 kHz; mono, 8 bits.
HEAD = bytes([0xFF, 0xF8, 0x24, 0x02])


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for x in data:
        value = int(CRC8[value ^ x])
    return value


def _crc16_lanes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + length] for each lane."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    value, table = np.zeros(len(starts), np.int64), CRC16
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    for i, n in enumerate(live):
        v = value[:n]
        value[:n] = ((v << 8) & 0xFFFF) ^ table[(v >> 8) ^ data[starts[:n] + i]]
    out = np.empty_like(value)
    out[order] = value
    return out


def frame_number(n: int) -> bytes:
    """The extended UTF-8 form of a frame number."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1) or k == 7)
    tail = bytes(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1)]) + tail


def frame_head(n: int) -> bytes:
    head = HEAD + frame_number(n)
    return head + bytes([crc8(head)])


# ---------------------------------------------------------------- coding


def _lpc(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors (lanes, order) and their shifts, by Levinson's recursion on integer autocorrelations."""
    n, order = len(samples), LPC_ORDER
    lags = np.stack([(samples[:, lag:] * samples[:, : BLOCK - lag]).sum(1) for lag in range(order + 1)], 1).astype(float)
    coefs, error = np.zeros((n, order)), lags[:, 0].copy()
    for i in range(order):
        reflected = (lags[:, i + 1] - (coefs[:, :i] * lags[:, i:0:-1]).sum(1)) / np.where(error > 0, error, 1)
        coefs[:, :i] -= reflected[:, None] * coefs[:, :i][:, ::-1].copy()
        coefs[:, i] = reflected
        error *= 1 - reflected**2
    top = np.abs(coefs).max(1)
    exponent = np.where(top > 0, np.floor(np.log2(np.where(top > 0, top, 1))), -1).astype(np.int64)
    shift = np.clip(LPC_PRECISION - 2 - exponent, 0, 15)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.round(coefs * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _residuals(samples: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Residuals of the fixed predictors 0 to 2 and of LPC, zero where the warm-up stands."""
    zero, one = samples, np.diff(samples, axis=1)
    two = np.diff(one, axis=1)
    coefs, shift = _lpc(samples)
    predicted = sum(coefs[:, j : j + 1] * samples[:, LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER))
    lpc = samples[:, LPC_ORDER:] - (predicted >> shift[:, None])
    return [np.pad(r, ((0, 0), (BLOCK - r.shape[1], 0))) for r in (zero, one, two, lpc)], coefs, shift


def _frames(samples: np.ndarray, numbers: Sequence[int]) -> list[bytes]:
    """The frames of blocks (lanes, 576)."""
    n = len(samples)
    kinds = ((0, 8), (1, 9), (2, 10), (LPC_ORDER, 32 + LPC_ORDER - 1))  # warm-up samples, subframe type
    extra = np.array([0, 0, 0, 9 + LPC_ORDER * LPC_PRECISION])
    residuals, coefs, shift = _residuals(samples)
    folded = [(r << 1) ^ (r >> 63) for r in residuals]
    sums = np.stack([f.sum(1) for f in folded], 1)
    counts = BLOCK - np.array([w for w, _ in kinds])
    guess = np.clip(np.floor(np.log2(np.maximum(sums / counts * 0.6931, 1e-9))), 0, 13).astype(np.int64)
    cost = counts * (guess + 1) + (sums >> guess) + 8 * np.array([w for w, _ in kinds]) + extra
    best = cost.argmin(1)
    lane = np.arange(n)
    values = np.choose(best[:, None], folded)
    warm = np.array([w for w, _ in kinds])[best]
    k = guess[lane, best]
    used = np.arange(BLOCK) >= warm[:, None]
    bits = [((values >> (k + d)[:, None]) * used).sum(1) + (BLOCK - warm) * (k + d + 1) for d in (0, 1)]
    k = np.where(bits[1] < bits[0], np.minimum(k + 1, 14), k)
    quotient = values >> k[:, None]
    body = 8 * warm + extra[best] + 10 + (quotient * used).sum(1) + (BLOCK - warm) * (k + 1)
    constant = (samples == samples[:, :1]).all(1)
    verbatim = ~constant & (body >= 8 * BLOCK)
    coded = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, body))
    heads = [frame_head(x) for x in numbers]
    head = np.array([len(h) for h in heads])
    size = head + 1 + -(-body // 8) + 2
    start = np.concatenate([[0], np.cumsum(size)])
    total = int(start[-1])

    cells = total // 4 + 3
    high, low = np.zeros(cells), np.zeros(cells)

    def put(at: np.ndarray, value: np.ndarray, width) -> None:
        """Codes of 32 bits at most, at bit places.  Codes do not overlap, so sums are unions, exact in doubles."""
        full = value.astype(np.uint64) << (64 - width - (at & 31)).astype(np.uint64)
        high[:] += np.bincount(at >> 5, weights=(full >> np.uint64(32)).astype(float), minlength=cells)
        low[:] += np.bincount(at >> 5, weights=(full & np.uint64(0xFFFFFFFF)).astype(float), minlength=cells)

    at = 8 * (start[:-1] + head)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.array([t for _, t in kinds])[best]))
    put(at, kind << 1, 8)
    at = at + 8
    raw = samples & 0xFF
    if constant.any():
        put(at[constant], raw[constant, 0], 8)
    if verbatim.any():
        put((at[verbatim][:, None] + 8 * np.arange(BLOCK)).ravel(), raw[verbatim].ravel(), 8)
    for w in range(LPC_ORDER):
        lanes = coded & (warm > w)
        if lanes.any():
            put(at[lanes], raw[lanes, w], 8)
        at = at + 8 * lanes
    lanes = coded & (best == 3)
    if lanes.any():
        put(at[lanes], (LPC_PRECISION - 1) << 5 | shift[lanes], 9)
        for j in range(LPC_ORDER):
            put(at[lanes] + 9 + j * LPC_PRECISION, coefs[lanes, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    at = at + np.where(lanes, extra[3], 0)
    if coded.any():
        put(at[coded], k[coded], 10)  # one partition: six zero bits, then the parameter
        k1, used = k[coded][:, None], used[coded]
        lengths = np.where(used, quotient[coded] + k1 + 1, 0)
        ends = (at[coded] + 10)[:, None] + np.cumsum(lengths, 1)
        width = np.broadcast_to(k1 + 1, used.shape)[used]
        code = (1 << k1) | (values[coded] & ((1 << k1) - 1))
        put(ends[used] - width, code[used], width)
    words = high
    words[1:] += low[:-1]
    data = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[:total].copy()
    joined = np.frombuffer(b"".join(heads), np.uint8)
    first = np.concatenate([[0], np.cumsum(head)[:-1]])
    data[np.repeat(start[:-1] - first, head) + np.arange(len(joined))] = joined
    check = _crc16_lanes(data, start[:-1], size - 2)
    data[start[1:] - 2] = check >> 8
    data[start[1:] - 1] = check & 0xFF
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _stream(frames: list[bytes], payload: bytes) -> bytes:
    sizes = [len(f) for f in frames]
    n = len(payload)
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (8000 << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + md5
    points, place = b"", 0
    for i, size in enumerate(sizes):
        if i % SEEK_FRAMES == 0 and i:
            points += (i * BLOCK).to_bytes(8, "big") + place.to_bytes(8, "big") + BLOCK.to_bytes(2, "big")
        place += size
    table = bytes([0x83]) + len(points).to_bytes(3, "big") + points if points else b""
    return b"fLaC" + bytes([0x00 if points else 0x80]) + len(info).to_bytes(3, "big") + info + table + b"".join(frames)


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """A stream for each payload of unsigned bytes; lengths are positive multiples of 576.  Equal payloads, equal streams."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError(f"a payload's length is not a positive multiple of {BLOCK}")
    counts = [len(p) // BLOCK for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = [i for c in counts for i in range(c)]
    frames: list[bytes] = []
    for a in range(0, len(samples), LANES):
        frames += _frames(samples[a : a + LANES].astype(np.int64) - 128, numbers[a : a + LANES])
    out, at = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        out.append(_stream(frames[at : at + c], payload))
        at += c
    return out


# ---------------------------------------------------------------- decoding


class Info:
    """The metadata of a stream: layout, number of samples, MD5, seek points, and where the frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek = 4, False, []
        self.block = None
        while not last:
            if at + 4 > len(data):
                raise ValueError("the metadata is cut off")
            last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = (int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"))
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.n = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind == 3:
                points = [body[i : i + 18] for i in range(0, size, 18)]
                self.seek = [(int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big")) for p in points if p[:8] != b"\xff" * 8]
            at += 4 + size
        if self.block is None:
            raise ValueError("no stream information")
        self.frames_at = at

    @property
    def plain(self) -> bool:
        return self.block == (BLOCK, BLOCK) and self.channels == 1 and self.bits == 8 and self.n % BLOCK == 0


class _Lanes:
    """Bits of a buffer, at a place for each lane."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for i in range(8):
            self.words |= padded[i : n + i] << np.uint64(56 - 8 * i)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits and more from a bit place, at the top."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of 0 to 56 bits."""
        return (self.window(at) >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value = self.read(at, width)
        return value - ((value >> (width - 1) & 1) << width)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zero bits before the next one."""
        out = np.zeros(len(at), np.int64)
        rest = np.arange(len(at))
        while len(rest):
            top = (self.window(at[rest] + out[rest]) >> np.uint64(11)).astype(np.float64)
            found = top >= 16  # the window is whole down to there
            out[rest] += np.where(found, 1075 - (np.maximum(top, 1).view(np.int64) >> 52), 48)
            rest = rest[~found]
            if len(rest) and (at[rest] + out[rest] > 8 * len(self.words)).any():
                raise ValueError("a frame ends inside a residual")
        return out


def _decode_lanes(frames: list[bytes]) -> np.ndarray:
    """Samples (lanes, 576) of checked frames of the plain layout."""
    sizes = np.array([len(f) for f in frames])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(frames), np.uint8)
    found = _crc16_lanes(data, start, sizes - 2)
    if (found != (data[start + sizes - 2].astype(np.int64) << 8 | data[start + sizes - 1])).any():
        raise ValueError("a frame's CRC-16 differs")
    bits = _Lanes(data)
    first = data[start + 4]
    number = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, np.where(first < 0xF8, 4, np.where(first < 0xFC, 5, 6)))))
    at = 8 * (start + 5 + number)
    kind = bits.read(at, 8)
    if (kind & 0x81).any():
        raise ValueError("a subframe is not of the plain layout")
    kind >>= 1
    at = at + 8
    out = np.zeros((len(frames), BLOCK), np.int64)
    for lane in np.flatnonzero(kind == 0):
        out[lane] = bits.signed(at[lane : lane + 1], 8)
    for lane in np.flatnonzero(kind == 1):
        a = int(at[lane]) >> 3
        out[lane] = data[a : a + BLOCK].view(np.int8)
    coded = np.flatnonzero(kind > 1)
    fixed, lpc = (kind[coded] >= 8) & (kind[coded] <= 12), kind[coded] >= 32
    if not (fixed | lpc).all():
        raise ValueError("a subframe has a reserved type")
    order = np.where(fixed, kind[coded] - 8, kind[coded] - 31)
    at, samples = at[coded], np.zeros((len(coded), BLOCK), np.int64)
    for i in range(int(order.max(initial=0))):
        samples[:, i] = np.where(order > i, bits.signed(at, 8), 0)
        at = at + np.where(order > i, 8, 0)
    precision = np.where(lpc, bits.read(at, 4) + 1, 1)
    shift = np.where(lpc, bits.signed(at + 4, 5), 0)
    if (precision[lpc] == 16).any() or (shift < 0).any():
        raise ValueError("a predictor has a reserved precision or shift")
    at = at + np.where(lpc, 9, 0)
    top = int(order.max(initial=0))
    coefs = np.zeros((len(coded), max(top, 1)), np.int64)
    for j in range(top):
        lanes = lpc & (order > j)
        coefs[:, j] = np.where(lanes, bits.signed(at, precision), 0)
        at = at + np.where(lanes, precision, 0)
    for o in range(1, 5):  # the fixed predictors are the differences of that order
        coefs[np.ix_(fixed & (order == o), range(o))] = [c * (-1) ** j for j, c in enumerate(((1,), (2, 1), (3, 3, 1), (4, 6, 4, 1))[o - 1])]
    if (bits.read(at, 6) != 0).any():
        raise ValueError("a residual is not of the plain layout")
    k = bits.read(at + 6, 4)
    if (k == 15).any():
        raise ValueError("a residual is not of the plain layout")
    at = at + 10
    residual = np.zeros_like(samples)
    for i in range(BLOCK):
        live = slice(None) if i >= top else np.flatnonzero(order <= i)
        places, kk = at[live], k[live]
        q = bits.zeros(places)
        value = q << kk | bits.read(places + q + 1, kk)
        residual[live, i] = (value >> 1) ^ -(value & 1)
        at[live] = places + q + 1 + kk
    for o in range(top + 1):
        lanes = np.flatnonzero(order == o)
        if not len(lanes):
            continue
        if o == 0:
            samples[lanes] = residual[lanes]
            continue
        own, turn, c, s = samples[lanes].T.copy(), residual[lanes].T.copy(), coefs[lanes].T.copy(), shift[lanes]
        for i in range(o, BLOCK):
            predicted = c[0] * own[i - 1]
            for j in range(1, o):
                predicted += c[j] * own[i - 1 - j]
            own[i] = turn[i] + (predicted >> s)
        samples[lanes] = own.T
    out[coded] = samples
    if (out < -128).any() or (out > 127).any():
        raise ValueError("a sample does not fit its width")
    return out


def split_frames(data: bytes, info: Info, first: int = 0, at: int | None = None, last: int | None = None, checked: bool = False) -> list[bytes]:
    """The frames of a plain stream from frame ``first`` to before ``last``: each begins with the very header that its number
    asks for.  checked: a frame ends where its CRC-16 holds, however often that header stands inside it."""
    at, out = info.frames_at if at is None else at, []
    count = info.n // BLOCK
    for i in range(first, count if last is None else min(last, count)):
        if not data.startswith(frame_head(i), at):
            raise ValueError(f"frame {i} has no valid header")
        end = at + 8
        while True:
            end = data.find(frame_head(i + 1), end) if i + 1 < count else len(data)
            if end < 0:
                raise ValueError(f"frame {i + 1} has no valid header")
            if not checked or i + 1 == count or _crc16_lanes(np.frombuffer(data[at:end], np.uint8), np.array([0]), np.array([end - at]))[0] == 0:
                break
            end += 1
        out.append(data[at:end])
        at = end
    return out


def decode(streams: Sequence[bytes]) -> list[np.ndarray]:
    """The samples of each stream: (samples,) of mono streams, else (samples, channels)."""
    infos = [Info(s) for s in streams]
    for checked in (False, True):
        try:
            cut = [split_frames(s, i, checked=checked) if i.plain else None for s, i in zip(streams, infos, strict=True)]
            frames = [f for c in cut if c for f in c]
            parts = [_decode_lanes(frames[a : a + LANES]) for a in range(0, len(frames), LANES)]
            break
        except ValueError:
            if checked:
                raise
    lanes = np.concatenate(parts) if parts else np.empty((0, BLOCK), np.int64)
    out, at = [], 0
    for stream, info, own in zip(streams, infos, cut, strict=True):
        if own is None:
            from .flac_general import decode_stream

            samples = decode_stream(stream, info)
        else:
            samples = lanes[at : at + len(own)].ravel()
            at += len(own)
            if info.md5 != bytes(16) and hashlib.md5(samples.astype(np.int8).tobytes()).digest() != info.md5:
                raise ValueError("the MD5 of the samples differs")
        out.append(samples)
    return out


def decode_from(stream: bytes, sample: int, n: int) -> np.ndarray:
    """n samples of a plain stream from a sample on; decoding starts at the seek point before it."""
    info = Info(stream)
    begun, place = max(((s, o) for s, o in info.seek if s <= sample), default=(0, 0))
    last = -(-(sample + n) // BLOCK)
    try:
        samples = _decode_lanes(split_frames(stream, info, begun // BLOCK, info.frames_at + place, last))
    except ValueError:
        samples = _decode_lanes(split_frames(stream, info, begun // BLOCK, info.frames_at + place, last, checked=True))
    return samples.ravel()[sample - begun : sample - begun + n]


def pcm_blocks(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first sample, samples, little-endian PCM) of each block of a stream, from the decoded frames."""
    info = Info(stream)
    width = -(-info.bits // 8)
    if info.plain:
        # Frames are decoded LANES at a time, so that a long stream is never samples as a whole; the MD5 is that of all.
        md5, count = hashlib.md5(), info.n // BLOCK
        frames = split_frames(stream, info)
        for first in range(0, count, LANES):
            try:
                samples = _decode_lanes(frames[first : first + LANES]).astype(np.int8)
            except ValueError:
                frames = split_frames(stream, info, checked=True)
                samples = _decode_lanes(frames[first : first + LANES]).astype(np.int8)
            md5.update(samples.tobytes())
            for i, block in enumerate(samples, first):
                yield i * BLOCK, BLOCK, block.tobytes()
        if info.md5 not in (bytes(16), md5.digest()):
            raise ValueError("the MD5 of the samples differs")
        return
    samples = decode([stream])[0]
    for a in range(0, len(samples), info.block[1]):
        part = samples[a : a + info.block[1]]
        raw = np.ascontiguousarray(part.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :width]
        yield a, len(part), raw.tobytes()
