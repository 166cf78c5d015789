"""Dynamic range compression of clips that arrive piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lyrebird.operators.signal import Compressor, gain_steps, run_gains

_STATE = "piece long, gain double, envelope double, waiting array<long>, held array<array<double>>"


def compress_stream(pieces: DataFrame, c: Compressor) -> DataFrame:
    """A stream of clip_id, piece, samples -> the same with gains applied.

    The state of a clip is three numbers, its next piece, its gain and its last
    envelope, and the pieces that have come before they are due; those come forth
    once the ones before them have come, in this batch or a later one.  A piece that
    comes twice is an error.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, gain, before, waiting, held = state.get if state.exists else (0, 1.0, float("nan"), [], [])
        due = dict(zip(waiting, held, strict=True))
        for row in pd.concat(list(frames)).itertuples():
            if row.piece < number or row.piece in due:
                raise ValueError(f"clip {key[0]}: piece {row.piece} came twice")
            due[row.piece] = row.samples
        while number in due:
            v = np.asarray(due.pop(number), np.float64)
            e, gains = np.abs(v), np.empty(0)
            if len(v):
                k, kt = gain_steps(e, e[0] if np.isnan(before) else before, c)
                if np.isnan(before):
                    k[0] = kt[0] = 0.0
                gains = run_gains(k, kt, gain)
                gain, before = float(gains[-1]), float(e[-1])
            yield pd.DataFrame({"clip_id": [key[0]], "piece": [number], "samples": [(v * gains).tolist()]})
            number += 1
        rest = sorted(due)
        state.update((number, gain, before, [int(k) for k in rest], [[float(x) for x in due[k]] for k in rest]))

    kind = pieces.schema["clip_id"].dataType.simpleString()
    return pieces.groupBy("clip_id").applyInPandasWithState(
        step, f"clip_id {kind}, piece long, samples array<double>", _STATE, "append", GroupStateTimeout.NoTimeout
    )
