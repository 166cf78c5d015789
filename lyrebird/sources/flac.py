"""FLAC files as samples: frames of Rice-coded residuals of linear predictors.

A frame whose header or body fails its check sum is left out with a warning, or is
an error, and reading goes on at the next frame.  A frame is decoded by itself, so a
file takes the memory of its samples.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: block sizes and rates by code, bits a sample by code.
_BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (poly if crc >> (bits - 1) else 0)
            crc &= (1 << bits) - 1
        out.append(crc)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ b]
    return crc


class Invalid(ValueError):
    """A frame that cannot be read."""


class _Bits:
    """Bits of a frame from a byte on."""

    def __init__(self, data: bytes, start: int):
        self.data, self.at, self.begin = data, start * 8, start
        self.ones: np.ndarray | None = None

    def read(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise Invalid("the file ends in a frame")
        value = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & ((1 << n) - 1)
        self.at = end
        return value

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
        return zeros

    def many(self, n: int, count: int) -> np.ndarray:
        """count signed numbers of n bits."""
        return np.array([self.signed(n) for _ in range(count)], np.int64)

    def rice(self, k: int, count: int, most: int) -> np.ndarray:
        """count Rice codes; a frame has about most bytes."""
        if self.ones is None:
            bits = np.unpackbits(np.frombuffer(self.data, np.uint8, min(most, len(self.data) - self.begin), self.begin))
            place = np.where(bits, np.arange(len(bits)), len(bits))
            self.bits, self.ones = bits, np.minimum.accumulate(place[::-1])[::-1].tolist()
        base, ones, stops, starts = 8 * self.begin, self.ones, [], []
        at = self.at - base
        for _ in range(count):
            if at >= len(ones) or ones[at] + 1 + k > len(ones):
                raise Invalid("a residual without an end")
            starts.append(at)
            stops.append(ones[at])
            at = ones[at] + 1 + k
        self.at = at + base
        stop = np.array(stops, np.int64)
        value = stop - np.array(starts, np.int64)
        for j in range(1, k + 1):
            value = (value << 1) | self.bits[stop + j]
        return (value >> 1) ^ -(value & 1)


@dataclass(frozen=True)
class Stream:
    rate: int
    channels: int
    bits: int
    samples: int  # 0 if unknown
    first: int  # the byte of the first frame


def stream_info(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, found = 4, None
    while True:
        if at + 4 > len(data):
            raise ValueError("the file ends in its head")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            found = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
        at += 4 + size
        if kind >> 7:
            break
    if not found or not found[0]:
        raise ValueError("no description of the stream")
    return Stream(*found, at)


def _residual(bits: _Bits, block: int, order: int, most: int) -> np.ndarray:
    width = 4 + bits.read(2)
    if width > 5:
        raise Invalid("an unknown residual")
    parts = 1 << bits.read(4)
    if block % parts or block // parts < order:
        raise Invalid("partitions do not fit")
    out = []
    for part in range(parts):
        count, k = block // parts - (order if part == 0 else 0), bits.read(width)
        out.append(bits.many(bits.read(5), count) if k == (1 << width) - 1 else bits.rice(k, count, most))
    return np.concatenate(out)


def _subframe(bits: _Bits, block: int, depth: int, most: int) -> np.ndarray:
    if bits.read(1):
        raise Invalid("a subframe that does not begin as one")
    kind = bits.read(6)
    wasted = 1 + bits.unary() if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(block, bits.signed(depth), np.int64)
    elif kind == 1:
        out = bits.many(depth, block)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = bits.many(depth, order)
        out = _residual(bits, block, order, most)
        for j in range(order - 1, -1, -1):  # each sum undoes one difference
            out = np.diff(warm, n=j)[-1] + np.cumsum(out)
        out = np.concatenate([warm, out])
    elif kind >= 32:
        order = kind - 31
        warm = bits.many(depth, order).tolist()
        precision, shift = bits.read(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Invalid("a predictor that is not allowed")
        weights = bits.many(precision, order).tolist()[::-1]
        for r in _residual(bits, block, order, most).tolist():
            warm.append(r + (sum(a * b for a, b in zip(weights, warm[-order:], strict=True)) >> shift))
        out = np.array(warm, np.int64)
    else:
        raise Invalid("an unknown subframe")
    return out << wasted


def frame(data: bytes, start: int, s: Stream) -> tuple[np.ndarray, int]:
    """(channels, samples) of the frame at a byte, and the byte behind it."""
    bits = _Bits(data, start)
    if bits.read(15) != 0x7FFC:
        raise Invalid("no frame begins here")
    bits.read(1)
    size, rate, channels, depth = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    reserved, lead = bits.read(1), bits.read(8)  # lead is the first byte of the frame's number
    if size == 0 or rate == 15 or channels > 10 or depth == 3 or reserved or lead == 0xFF:
        raise Invalid("a head that is not allowed")
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    bits.read(8 * max(0, extra - 1))
    block = bits.read(8) + 1 if size == 6 else bits.read(16) + 1 if size == 7 else _BLOCKS[size]
    own = {12: lambda: 1000 * bits.read(8), 13: lambda: bits.read(16), 14: lambda: 10 * bits.read(16)}.get(rate, lambda: _RATES.get(rate, s.rate))()
    if crc8(data[start : bits.at // 8]) != bits.read(8):
        raise Invalid("a head whose check sum is wrong")
    depth = _BITS.get(depth, s.bits)
    if (own, depth, channels + 1 if channels < 8 else 2) != (s.rate, s.bits, s.channels):
        raise Invalid("a frame of another stream")
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    most = 2 * s.channels * block * (depth + 1) // 8 + 1024
    out = np.stack([_subframe(bits, block, depth + (k == side), most) for k in range(s.channels)])
    if channels == 8:
        out[1] = out[0] - out[1]
    elif channels == 9:
        out[0] += out[1]
    elif channels == 10:
        middle = (out[0] << 1) | (out[1] & 1)
        out[0], out[1] = (middle + out[1]) >> 1, (middle - out[1]) >> 1
    end = (bits.at + 7) // 8
    if end + 2 > len(data) or crc16(data[start:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise Invalid("a frame whose check sum is wrong")
    return out, end + 2


def flac_values(data: bytes, skip_invalid: bool = True) -> tuple[np.ndarray, int]:
    """(channels, samples) from -1 to 1 and the rate of a FLAC file.

    Frames that cannot be read are left out with a warning, or are an error without
    skip_invalid; a file without any sample is an error.
    """
    s, parts = stream_info(data), []
    at = s.first
    while at < len(data):
        try:
            samples, at = frame(data, at, s)
            parts.append(samples)
        except Invalid as e:
            if not skip_invalid:
                raise
            warnings.warn(f"a frame is left out: {e}", stacklevel=2)
            at = data.find(b"\xff", at + 1)
            while at >= 0 and data[at + 1 : at + 2] not in (b"\xf8", b"\xf9"):
                at = data.find(b"\xff", at + 1)
            if at < 0:
                break
    if not parts:
        raise ValueError("no samples")
    return np.concatenate(parts, axis=1) / float(1 << (s.bits - 1)), s.rate
