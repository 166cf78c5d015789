"""Words of Arrow text columns as arrays of 64-bit ids.

A text column is cut into blocks of a few megabytes.  In each block all bytes
are looked at together: a 256-entry table maps every separator to a space (and
letters to lower case where asked for), words are the runs between spaces, and
a word's id is a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20

_U = np.uint64
_K1, _K2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _table(is_separator, lower: bool) -> bytes:
    out = bytearray(range(256))
    for b in range(256):
        if is_separator(b):
            out[b] = 32
        elif lower and 65 <= b <= 90:
            out[b] = b + 32
    return bytes(out)


#: words [^\x20\x09-\x0D]+
PLAIN = _table(lambda b: b == 32 or 9 <= b <= 13, lower=False)
#: the same, with A-Z in lower case
LOWER = _table(lambda b: b == 32 or 9 <= b <= 13, lower=True)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z in lower case
ALNUM = _table(lambda b: b < 128 and not chr(b).isalnum(), lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> _U(33))
    h *= _K1
    h ^= h >> _U(33)
    h *= _K2
    h ^= h >> _U(33)
    return h


@dataclass
class Block:
    """Rows first_row .. first_row + len(bounds) - 2 of a batch."""

    first_row: int
    raw: np.ndarray  # bytes as they are
    data: np.ndarray  # bytes after the table
    offsets: np.ndarray  # of each row's bytes, one more than rows
    starts: np.ndarray  # of each word
    ends: np.ndarray
    bounds: np.ndarray  # of each row's words, one more than rows

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def ids(self) -> np.ndarray:
        return word_ids(self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit ids of the words data[start:end]; equal words have equal ids."""
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    eight = np.ndarray((len(data) + 1,), np.uint64, padded.data, 0, (1,)) if eight.base is None else eight
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) * _K2)
    at, where = starts.astype(np.int64), None
    while True:
        chunk = eight[at]
        short = left < 8
        chunk = np.where(short, chunk & ((_U(1) << (_U(8) * np.minimum(left, 7).astype(np.uint64))) - _U(1)), chunk)
        if where is None:
            h = mix(h + chunk * _K1)
        else:
            h[where] = mix(h[where] * _U(0x9E3779B97F4A7C15) + chunk * _K1)
        go = np.flatnonzero(left > 8)
        if not len(go):
            return h
        where = go if where is None else where[go]
        at, left = at[go] + 8, left[go] - 8


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null is an empty text."""
    column = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.fill_null(column, b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, what = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_blocks(column: pa.Array, mapping: bytes, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks and find the words of each."""
    for first, raw, offsets in text_blocks(column, block_bytes):
        data = np.frombuffer(raw.tobytes().translate(mapping), np.uint8)
        word = np.zeros(len(data) + 2, bool)
        np.not_equal(data, 32, out=word[1:-1])
        edge = np.zeros(len(data) + 1, bool)  # a row ends before this byte
        edge[offsets] = True
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        yield Block(first, raw, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Ids of every n consecutive words; entry i is of words i .. i + n - 1."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        h *= _U(0x9E3779B97F4A7C15)
        h += ids[j : len(ids) - n + 1 + j]
    return mix(h + _U(n))


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles in order of id, and the rows' bounds.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    grams = gram_ids(block.ids, n)
    lengths = np.where(block.counts >= n, block.counts - n + 1, (block.counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(bounds[-1], np.uint64)
    keep = np.ones(len(out), bool)
    for row in range(block.rows):
        a, b, w = bounds[row], bounds[row + 1], block.bounds[row]
        if block.counts[row] >= n:
            own = out[a:b]
            own[:] = grams[w : w + b - a]
            own.sort()
        elif b > a:
            out[a] = gram_ids(block.ids[w : w + block.counts[row]], int(block.counts[row]))[0]
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][lengths > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]


def signed(ids: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return ids.view(np.int64) if ids.dtype == np.uint64 else ids.astype(np.int64)
