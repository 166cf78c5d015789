"""FLAC frames from an own encoder of constants, verbatim samples, fixed and linear predictors."""

from __future__ import annotations

import numpy as np
import pytest

from lyrebird.sources.audio import decode_wav, wav_samples
from lyrebird.sources.flac import crc8, crc16, flac_values, stream_info


class Writer:
    def __init__(self):
        self.text = ""

    def put(self, value: int, n: int) -> None:
        self.text += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def bytes(self) -> bytes:
        text = self.text + "0" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def put_residual(w: Writer, residual: list[int], block: int, order: int, parts: int, wide: bool, escape: bool) -> None:
    w.put(int(wide), 2)
    w.put(parts, 4)
    at, width = 0, 5 if wide else 4
    for part in range(1 << parts):
        own = residual[at : at + (block >> parts) - (order if part == 0 else 0)]
        at += len(own)
        if escape:
            n = max([abs(r) for r in own] + [0]).bit_length() + 1
            w.put((1 << width) - 1, width)
            w.put(n, 5)
            for r in own:
                w.put(r, n)
            continue
        k = min(max(0, int(np.mean(np.abs(own)) if own else 0).bit_length()), (1 << width) - 2)
        w.put(k, width)
        for r in own:
            z = 2 * r if r >= 0 else -2 * r - 1
            w.text += "0" * (z >> k) + "1"
            w.put(z, k)


def put_subframe(w: Writer, x: list[int], depth: int, kind: str, parts: int, wide: bool, escape: bool, wasted: int) -> None:
    w.put(0, 1)
    order = int(kind[-1]) if kind[-1].isdigit() else 0
    w.put({"c": 0, "v": 1, "f": 8 + order, "l": 31 + order}[kind[0]], 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.text += "0" * (wasted - 1) + "1"
        x, depth = [v >> wasted for v in x], depth - wasted
    if kind[0] == "c":
        w.put(x[0], depth)
        return
    for v in x if kind == "v" else x[:order]:
        w.put(v, depth)
    if kind == "v":
        return
    if kind[0] == "f":
        residual = np.diff(np.array(x, np.int64), n=order).tolist()
    else:
        weights, shift = [3, -2, 1, 1, -1, 2, 1, -1][:order], 2
        w.put(6 - 1, 4)
        w.put(shift, 5)
        for a in weights:
            w.put(a, 6)
        residual = [x[i] - (sum(a * x[i - 1 - j] for j, a in enumerate(weights)) >> shift) for i in range(order, len(x))]
    put_residual(w, residual, len(x), order, parts, wide, escape)


def flac_file(x: np.ndarray, rate: int, bits: int, block: int, kind: str = "f2", stereo: int | None = None, parts: int = 0, wide: bool = False, escape: bool = False, wasted: int = 0) -> bytes:
    channels, n = x.shape
    w = Writer()
    for value, size in ((block, 16), (block, 16), (0, 24), (0, 24), (rate, 20), (channels - 1, 3), (bits - 1, 5), (n, 36), (0, 128)):
        w.put(value, size)
    out = b"fLaC" + bytes([1 | 0x00]) + (4).to_bytes(3, "big") + b"none" + bytes([0x80]) + (34).to_bytes(3, "big") + w.bytes()
    for number, at in enumerate(range(0, n, block)):
        own = x[:, at : at + block]
        head = Writer()
        for value, size in ((0x3FFE, 14), (0, 2), (7, 4), (0, 4), (channels - 1 if stereo is None else stereo, 4), (0, 3), (0, 1)):
            head.put(value, size)
        body = head.bytes() + chr(number).encode() + (own.shape[1] - 1).to_bytes(2, "big")
        body += bytes([crc8(body)])
        if stereo == 8:
            own = np.stack([own[0], own[0] - own[1]])
        elif stereo == 9:
            own = np.stack([own[0] - own[1], own[1]])
        elif stereo == 10:
            own = np.stack([(own[0] + own[1]) >> 1, own[0] - own[1]])
        w, side = Writer(), {8: 1, 9: 0, 10: 1}.get(stereo)
        fits = own.shape[1] % (1 << parts) == 0 and own.shape[1] >> parts >= 8
        for k, row in enumerate(own.tolist()):
            put_subframe(w, row, bits + (k == side), kind if own.shape[1] > 8 or kind == "c" else "v", parts if fits else 0, wide, escape, wasted)
        body += w.bytes()
        out += body + crc16(body).to_bytes(2, "big")
    return out


def music(channels: int, n: int, bits: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    wave = np.sin(np.arange(n) / 9)[None, :] * 0.5 + rng.normal(0, 0.02, (channels, n))
    return np.clip(wave * (1 << (bits - 1)), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)


@pytest.mark.parametrize("kind", ["v", "f0", "f1", "f2", "f3", "f4", "l1", "l4", "l8"])
@pytest.mark.parametrize("stereo", [None, 8, 9, 10])
def test_predictors_and_channels(kind, stereo):
    x = music(2, 700, 16)
    back, rate = flac_values(flac_file(x, 44100, 16, 256, kind, stereo, parts=2))
    assert rate == 44100 and np.array_equal(np.rint(back * 32768), x)


@pytest.mark.parametrize(("bits", "wide", "escape", "wasted"), [(8, False, False, 0), (24, True, False, 0), (20, True, True, 0), (16, False, True, 0), (16, False, False, 3), (12, False, False, 1)])
def test_widths(bits, wide, escape, wasted):
    x = music(1, 300, bits) >> wasted << wasted
    back, _ = flac_values(flac_file(x, 48000, bits, 96, "f2", None, 1, wide, escape, wasted))
    assert np.array_equal(np.rint(back * (1 << (bits - 1))), x)
    flat = np.full((1, 100), -5)
    assert np.array_equal(np.rint(flac_values(flac_file(flat, 8000, bits, 64, "c"))[0] * (1 << (bits - 1))), flat)


def test_frames_with_errors_are_left_out():
    x = music(2, 1024, 16)
    data = bytearray(flac_file(x, 44100, 16, 128))
    whole = stream_info(bytes(data)).first
    data[whole + (len(data) - whole) // 2] ^= 0x10  # in the middle of one frame
    with pytest.warns(UserWarning, match="left out"):
        back = np.rint(flac_values(bytes(data))[0] * 32768)
    assert back.shape == (2, 1024 - 128)
    k = next(k for k in range(0, 1024, 128) if not np.array_equal(back[:, k : k + 128], x[:, k : k + 128]))
    assert np.array_equal(back, np.delete(x, range(k, k + 128), axis=1))
    with pytest.raises(ValueError):
        flac_values(bytes(data), skip_invalid=False)
    with pytest.warns(UserWarning):
        assert flac_values(flac_file(x, 44100, 16, 128)[:-9])[0].shape == (2, 1024 - 128)
    for bad in (b"fLaC", b"RIFF", flac_file(np.zeros((1, 0), np.int64), 8000, 16, 64)):
        with pytest.raises(ValueError):
            flac_values(bad)


def test_files_of_both_kinds(spark):
    x = music(2, 500, 16)
    data = flac_file(x, 44100, 16, 200, "l4", 10)
    assert np.allclose(wav_samples(data, 44100), x / 32768, atol=1e-7) and wav_samples(data, 22050).shape == (2, 250)
    rows = decode_wav(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")).orderBy("channel").collect()
    assert np.allclose([r.samples for r in rows], x / 32768, atol=1e-7)
