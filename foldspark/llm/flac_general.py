"""Any FLAC stream, bit by bit: channels, widths, wasted bits, partitions, escaped residuals, variable blocks."""

from __future__ import annotations

import hashlib

import numpy as np

from .flac import CRC16, crc8

# Fixed values of the format.
_BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def read(self, width: int) -> int:
        end = self.at + width
        if end > 8 * len(self.data):
            raise ValueError("the stream is cut off")
        value = int.from_bytes(self.data[self.at >> 3 : -(-end // 8)], "big") >> (-end % 8)
        self.at = end
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.read(width)
        return value - (value >> (width - 1) << width) if width else 0

    def zeros(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _number(bits: _Bits) -> None:
    first = bits.read(8)
    more = 0
    while first << more & 0x80:
        more += 1
    if more == 1 or more > 7:
        raise ValueError("a frame's number is not valid")
    bits.read(8 * max(0, more - 1))


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    method, parts = bits.read(2), bits.read(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        raise ValueError("a residual has a reserved method or too many partitions")
    width, out = 4 + method, []
    for part in range(1 << parts):
        n = (block >> parts) - (order if not part else 0)
        k = bits.read(width)
        if k == (1 << width) - 1:
            raw = bits.read(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            value = bits.zeros() << k
            value |= bits.read(k)
            out.append(value >> 1 ^ -(value & 1))
    return out


def _subframe(bits: _Bits, block: int, width: int) -> np.ndarray:
    if bits.read(1):
        raise ValueError("a subframe's first bit is set")
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.zeros() + 1
    width -= wasted
    if kind == 0:
        samples = [bits.signed(width)] * block
    elif kind == 1:
        samples = [bits.signed(width) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        samples, shift = [bits.signed(width) for _ in range(order)], 0
        if kind < 32:
            coefs: tuple[int, ...] | list[int] = _FIXED[order]
        else:
            precision = bits.read(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("a predictor has a reserved precision or shift")
            coefs = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, block, order):
            samples.append(r + (sum(c * samples[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise ValueError("a subframe has a reserved type")
    return np.array(samples, np.int64) << wasted


def decode_frame(data: bytes, at: int, info) -> tuple[np.ndarray, int]:
    """The samples (block, channels) of the frame at a byte, and the byte after it."""
    bits = _Bits(data, at)
    if bits.read(15) != 0x7FFC:
        raise ValueError("no frame here")
    bits.read(1)
    block_code, rate_code, layout, width_code = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    _number(bits)
    block = bits.read(8) + 1 if block_code == 6 else bits.read(16) + 1 if block_code == 7 else _BLOCKS.get(block_code, 0)
    if not block or layout > 10 or rate_code == 15:
        raise ValueError("a frame header has a reserved value")
    bits.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if crc8(data[at : bits.at >> 3]) != bits.read(8):
        raise ValueError("a frame header's CRC-8 differs")
    width = _WIDTHS.get(width_code, info.bits)
    channels = layout + 1 if layout < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    parts = [_subframe(bits, block, width + (c == side)) for c in range(channels)]
    bits.read(-bits.at % 8)
    end, check = bits.at >> 3, 0
    for x in data[at:end]:
        check = (check << 8 & 0xFFFF) ^ int(CRC16[check >> 8 ^ x])
    if check != bits.read(16):
        raise ValueError("a frame's CRC-16 differs")
    if layout == 8:
        parts[1] = parts[0] - parts[1]
    elif layout == 9:
        parts[0] = parts[0] + parts[1]
    elif layout == 10:
        middle, difference = parts[0] << 1 | parts[1] & 1, parts[1]
        parts = [(middle + difference) >> 1, (middle - difference) >> 1]
    return np.stack(parts, 1), end + 2


def decode_stream(data: bytes, info) -> np.ndarray:
    at, blocks = info.frames_at, []
    while at < len(data):
        block, at = decode_frame(data, at, info)
        blocks.append(block)
    samples = np.concatenate(blocks) if blocks else np.empty((0, info.channels), np.int64)
    if info.n and len(samples) != info.n:
        raise ValueError("the number of samples differs")
    raw = np.ascontiguousarray(samples.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, : -(-info.bits // 8)]
    if info.md5 != bytes(16) and hashlib.md5(raw.tobytes()).digest() != info.md5:
        raise ValueError("the MD5 of the samples differs")
    return samples[:, 0] if info.channels == 1 else samples
