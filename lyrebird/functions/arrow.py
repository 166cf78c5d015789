"""Arrow batches between Spark and Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def joined_batches(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16, number: int = 1 << 10) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or are so many; sending one costs as much as some thousand rows."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.num_rows
        if total >= rows or len(held) >= number:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def keyed_batches(pieces: Iterable[tuple[str, list[np.ndarray]]], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Pieces, each a key and arrays of one length, as batches of so many rows or a piece more: the key, repeated, and the arrays."""

    def made() -> pa.RecordBatch:
        keys, arrays = zip(*held, strict=True)
        at = np.repeat(np.arange(len(held)), [len(x[0]) for x in arrays])
        columns = [pa.array(np.concatenate(x)) for x in zip(*arrays, strict=True)]
        return pa.record_batch([pa.array(keys, pa.string()).take(pa.array(at)), *columns], names)

    held, total = [], 0
    for key, arrays in pieces:
        held.append((key, arrays))
        total += len(arrays[0])
        if total >= rows:
            yield made()
            held, total = [], 0
    if held:
        yield made()
