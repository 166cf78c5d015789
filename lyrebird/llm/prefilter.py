"""A bitmap of ids, of bounded size, that keeps most rows out of a join.

The bitmap has a bit for the hash of every wanted id, and grows with them up to
16 MB.  Rows whose bit is not set are certainly not wanted and are dropped where
they are read; the join that follows decides on the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.words import mix

#: a bitmap has from 2**20 to 2**27 bits (16 MB), eight for each id where none is named
BITS = 20, 27


def _words(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << width, bool)
        for batch in batches:
            seen[_places(batch.column(0), width)] = True
        packed = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "bits": pa.array(packed[at])})

    return run


def _places(ids: pa.Array, width: int) -> np.ndarray:
    known = ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return mix(known.view(np.uint64)) >> np.uint64(64 - width)


def among(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each id, 64 bits, is set."""
    return bits[mix(ids) >> np.uint64(64 - (len(bits).bit_length() - 1))]


def bitmap(ids: DataFrame, bits_an_id: int = 8) -> np.ndarray:
    """The bitmap of the first column of ids, a long; its length is a power of two."""
    width = min(max((bits_an_id * ids.count()).bit_length(), BITS[0]), BITS[1])
    parts = ids.select(F.col(ids.columns[0]).cast("long")).mapInArrow(_words(width), "at int, bits long")
    rows = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2**width / 64 rows at most
    out = np.zeros((1 << width) // 64, np.int64)
    out[rows["at"]] = rows["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def likely_in(df: DataFrame, ids: DataFrame, column: str = "doc_id", then: Callable | None = None, schema=None) -> DataFrame:
    """Rows of df whose id may be among ids, and few others; null ids are not.

    With then, a function from batches to batches, and the schema of what it
    returns, the rows pass through it at once.
    """
    marked = bitmap(ids)
    width, shared = len(marked).bit_length() - 1, df.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            keep[batch[column].is_valid().to_numpy(zero_copy_only=False)] = bits[_places(batch[column], width)]
            yield batch.filter(pa.array(keep))

    return df.mapInArrow((lambda batches: then(run(batches))) if then else run, schema or df.schema)
