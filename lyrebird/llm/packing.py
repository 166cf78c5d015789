"""Token ids packed into rows of fixed length, best fit decreasing.

Each document becomes token ids and an end token.  Documents longer than a row
are split into whole rows and a rest.  The rests of a block of documents go, the
longest first, into the row with the least room that still takes them; a segment
tree over the room left finds that row in log steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.words import text_blocks
from lyrebird.staging import table

LENGTH = 2048
#: the vocabulary, read on the driver
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: free in that vocabulary
END = 50256
#: how the public byte-level vocabularies cut text; a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: bytes of text that are packed together
BLOCK_BYTES = 4 << 20


class Room:
    """Open rows by the room left in them, 0 .. length, under a segment tree of counts."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Row and room of the row with the least room of at least need."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each row, by falling size; no row's sizes sum to more than length."""
    room, rows = Room(length), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[item])
        row, left = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(item)
        room.put(row, left - sizes[item])
    return rows


def pack(ids: list[np.ndarray], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document, first token, tokens) that hold every token once."""
    rows, rests = [], []
    for doc, tokens in enumerate(ids):
        whole = len(tokens) // length * length
        rows += [[(doc, at, length)] for at in range(0, whole, length)]
        if len(tokens) > whole:
            rests.append((doc, whole, len(tokens) - whole))
    return rows + [[rests[i] for i in row] for row in best_fit([r[2] for r in rests], length)]


def load_ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in lines}


_encoders: dict = {}


def _encoder(ranks: dict[bytes, int], name: str):
    """The encoder of a vocabulary, made once in a worker; name is a digest of the ranks."""
    if name not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def packed_ids(docs: DataFrame, length: int = LENGTH, ranks: str = RANKS, end: int | None = END, pad: int = 0) -> DataFrame:
    """One row for each packed row of ids.

    input_ids is length little-endian ids (32 bits), of which n_tokens are used
    and the rest are pad; cu_seqlens are the cumulative lengths of its segments,
    from 0; position_resets are the places where positions start again at 0;
    doc_ids and doc_offsets tell of each segment its document and its first token
    there.  The rows of a block, one below the other, are its matrix.  A null or
    empty text is its end token alone, or nothing without one.  Repeated rows are
    packed each.  An empty table gives no rows.  Other columns are left alone.
    Blocks are runs of rows of an input partition, so the same files split the
    same way are packed the same way.
    """
    known = load_ranks(ranks)
    name = hashlib.sha256(repr(sorted(known.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, name)
        tail = np.array([] if end is None else [end], np.int32)
        for batch in batches:
            for first, raw, offsets in text_blocks(batch["text"], BLOCK_BYTES):
                texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ids = [np.concatenate([np.array(encoder.encode_ordinary(t), np.int32), tail]) for t in texts]
                names = batch["doc_id"].slice(first, len(texts)).to_pylist()
                rows = pack(ids, length)
                for some in range(0, len(rows), 256):
                    part = rows[some : some + 256]
                    matrix = np.full((len(part), length), pad, np.int32)
                    ends = [np.cumsum([0, *(n for _, _, n in row)]).astype(np.int32) for row in part]
                    for line, row, cuts in zip(matrix, part, ends, strict=True):
                        for (doc, at, n), to in zip(row, cuts, strict=False):
                            line[to : to + n] = ids[doc][at : at + n]
                    yield pa.record_batch({
                        "doc_ids": pa.array([[names[d] for d, _, _ in row] for row in part], pa.list_(pa.int64())),
                        "doc_offsets": pa.array([[at for _, at, _ in row] for row in part], pa.list_(pa.int64())),
                        "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                        "position_resets": pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                        "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int32()),
                        "input_ids": pa.array([line.astype("<i4").tobytes() for line in matrix], pa.binary()),
                    })

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, input_ids binary")


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(table(spark, sf_dir, "documents"))
