"""Words, their ids and shingles against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lyrebird.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .\t\n\x0b\x1c é漢😀", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([8, 64, 1 << 20]), st.integers(0, 2))
def test_words_of_blocks(texts, size, cut):
    column = pa.array([*(["x y"] * cut), *texts], pa.string())[cut:]
    for table, split in ((W.PLAIN, bytes.split), (W.LOWER, lambda b: b.lower().split()), (W.ALNUM, lambda b: b.translate(W.ALNUM).split())):
        got = []
        for block in W.word_blocks(column, table, size):
            data = block.data.tobytes()
            got += [[data[s:e] for s, e in zip(block.starts[a:b], block.ends[a:b], strict=True)] for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True)]
        assert got == [split((t or "").encode()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: b.replace(b" ", b"_")), min_size=1, max_size=30))
def test_ids_are_equal_just_when_words_are(some):
    data = b" ".join(some)
    ends = np.cumsum([len(w) + 1 for w in some]) - 1
    ids = W.word_ids(np.frombuffer(data, np.uint8), ends - [len(w) for w in some], ends)
    assert len(set(ids.tolist())) == len(set(some))
    alone = W.word_ids(np.frombuffer(some[0], np.uint8), np.array([0]), np.array([len(some[0])]))
    assert alone[0] == ids[0]


def test_shingle_sets():
    texts = ["a b c d e f", "a b c d e a b c d e", "", "a b", None, "b a"]
    block = next(W.word_blocks(pa.array(texts), W.LOWER))
    sets, bounds = W.shingle_sets(block, 5)
    assert np.diff(bounds).tolist() == [2, 5, 0, 1, 0, 1]
    assert len(set(sets[bounds[3] : bounds[4]].tolist() + sets[bounds[5] :].tolist())) == 2
    assert np.intersect1d(sets[: bounds[1]], sets[bounds[1] : bounds[2]]).size == 1
