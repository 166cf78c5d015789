"""Band-limited change of the sample rate, piece by piece or at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np

#: zero crossings of the filter to each side, its window's shape, and its cutoff as a part of the lower Nyquist frequency
ZEROS, BETA, CUTOFF = 32, 8.0, 0.92
#: outputs that are summed at once, and phases of a filter that is kept
_BLOCK, _KEPT = 2048, 4096


@dataclass(frozen=True)
class Resampler:
    """Polyphase windowed sinc from one rate to another; what lies beyond the ends of a clip is silence.

    An output is one sum over the inputs around its time, so pieces with margins of
    `reach` inputs give what the whole gives.  Outputs go on while their time is
    before the clip's end, so the last ones use what the filter still holds.
    """

    own: int
    rate: int

    @property
    def up(self) -> int:
        return self.rate // gcd(self.own, self.rate)

    @property
    def down(self) -> int:
        return self.own // gcd(self.own, self.rate)

    @property
    def reach(self) -> int:
        """Inputs to each side that an output takes."""
        return -(-ZEROS * max(self.up, self.down) // self.up)

    def outputs(self, inputs: int) -> int:
        """Outputs whose time is before that of an input; of a clip of so many inputs, all."""
        return -(-inputs * self.up // self.down)

    def weights(self, phase: np.ndarray) -> np.ndarray:
        """A row of filter weights for each phase, the part of an input's time by which an output is late."""
        scale = CUTOFF * min(1.0, self.up / self.down)
        at = np.arange(1 - self.reach, self.reach + 1) - (phase / self.up)[:, None]
        window = np.i0(BETA * np.sqrt(np.maximum(0.0, 1 - (at / self.reach) ** 2)))
        weights = np.sinc(scale * at) * window
        return weights / weights.sum(axis=1, keepdims=True)

    def piece(self, inputs: np.ndarray, first: int, begin: int, end: int) -> np.ndarray:
        """Outputs begin .. end - 1 of (channels, inputs) that start at input first; inputs that are not there are silence."""
        out = np.empty((len(inputs), max(0, end - begin)))
        lead, tail = self.reach, 2 * self.reach
        padded = np.pad(inputs.astype(np.float64), ((0, 0), (lead, tail)))
        table = _table(self) if self.up <= _KEPT else None
        for a in range(begin, end, _BLOCK):
            at = np.arange(a, min(a + _BLOCK, end)) * self.down
            place, phase = at // self.up - first + lead, at % self.up
            weights = table[phase] if table is not None else self.weights(phase)
            spans = np.lib.stride_tricks.sliding_window_view(padded, 2 * self.reach, axis=1)
            out[:, a - begin : a - begin + len(at)] = np.einsum("ckj,kj->ck", spans[:, place - self.reach + 1], weights)
        return out

    def __call__(self, inputs: np.ndarray) -> np.ndarray:
        """The whole of (channels, inputs)."""
        if self.own == self.rate:
            return inputs
        return self.piece(inputs, 0, 0, self.outputs(inputs.shape[1]))


@lru_cache(maxsize=4)
def _table(r: Resampler) -> np.ndarray:
    return r.weights(np.arange(r.up))
