"""Tones through the resampler, and pieces against the whole."""

from __future__ import annotations

import numpy as np
import pytest

from lyrebird.functions.resample import Resampler


def tone(hz: float, rate: int, n: int) -> np.ndarray:
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)[None, :]


def level(x: np.ndarray) -> float:
    middle = x[:, x.shape[1] // 4 : -x.shape[1] // 4]
    return 20 * np.log10(np.sqrt((middle**2).mean()) + 1e-12)


@pytest.mark.parametrize(("own", "rate"), [(44100, 16000), (48000, 44100), (44100, 8000)])
def test_tones_beyond_the_new_band_go(own, rate):
    for part in (1.02, 1.3, 2.0):
        hz = part * rate / 2
        if hz < own / 2:
            assert level(Resampler(own, rate)(tone(hz, own, own // 2))) < -60


@pytest.mark.parametrize(("own", "rate"), [(44100, 16000), (16000, 44100), (48000, 44100), (8000, 8001)])
def test_tones_within_the_band_stay(own, rate):
    for part in (0.05, 0.4, 0.75):
        hz = part * min(own, rate) / 2
        out = Resampler(own, rate)(tone(hz, own, own // 2))
        wanted = tone(hz, rate, out.shape[1])
        edge = 200
        assert np.abs(out - wanted)[:, edge:-edge].max() < 2e-3


@pytest.mark.parametrize(("own", "rate"), [(44100, 16000), (8000, 44100), (3, 7), (7, 3), (44100, 44099)])
def test_pieces_are_the_whole(own, rate):
    x = np.random.default_rng(1).normal(size=(2, 1500))
    r = Resampler(own, rate)
    whole, parts, at = r(x), [], 0
    for end in (1, 2, 400, 401, 900, 1499, 1500):
        lo, hi = max(0, at - r.reach), min(1500, end + r.reach)
        parts.append(r.piece(x[:, lo:hi], lo, r.outputs(at), r.outputs(end)))
        at = end
    assert np.allclose(np.concatenate(parts, axis=1), whole, rtol=0, atol=1e-12)
    assert whole.shape[1] == -(-1500 * rate // own)


def test_short_and_equal_rates():
    assert Resampler(8, 4)(np.zeros((1, 0))).shape == (1, 0)
    one = Resampler(44100, 22050)(np.ones((1, 1)))
    assert one.shape == (1, 1) and 0 < one[0, 0] < 1
    x = np.ones((1, 5))
    assert Resampler(5, 5)(x) is x
    flat = Resampler(44100, 16000)(np.ones((1, 4000)))
    assert np.allclose(flat[:, 100:-100], 1, atol=1e-12)
