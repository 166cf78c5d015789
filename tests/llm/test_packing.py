"""Packing: exact round trip and best fit."""

from __future__ import annotations

import random

import numpy as np
import pytest
import tiktoken

from lyrebird.llm import packing


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 16, 100])
    sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(60))]
    left, wanted = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, k) for k, r in enumerate(left) if r >= sizes[i]]
        if fits:
            room = min(fits)[0]
            k = [k for r, k in fits if r == room][0]
        else:
            left.append(length)
            k = len(left) - 1
        left[k] -= sizes[i]
    rows = packing.best_fit(sizes, length)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(left) and wanted == []


@pytest.mark.parametrize("end", [packing.END, None])
def test_round_trip(docs, odd_docs, no_docs, rows, end):
    coder = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=packing.load_ranks(packing.RANKS), special_tokens={})
    out = packing.packed_ids(odd_docs, length=64, end=end).collect()
    pieces: dict = {}
    for r in out:
        ids = np.frombuffer(r.input_ids, "<i4")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and not ids[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.position_resets)
        for doc, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces.setdefault((doc, at), []).append(ids[a:b].tolist())
    if end is None:
        total = sum(len(coder.encode_ordinary(t or "")) for _, t, *_ in rows)
        assert sum(len(x) for v in pieces.values() for x in v) == total
        return
    by_id: dict = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append([*coder.encode_ordinary(t or ""), end])
    for doc, many in by_id.items():
        for ids in many:
            for at in range(0, len(ids), 64):
                assert ids[at : at + 64] in pieces[doc, at]
                pieces[doc, at].remove(ids[at : at + 64])
    assert not any(pieces.values())
    assert packing.packed_ids(no_docs).count() == 0
    assert coder.decode(by_id[rows[0][0]][0][:-1]) in [t or "" for i, t, *_ in rows if i == rows[0][0]]


def test_vocabularies_one_after_the_other(spark, tmp_path):
    """A worker that has made an encoder makes another for other ranks."""
    import base64

    one, two = ({bytes([b]): (b + shift) % 256 for b in range(256)} for shift in (0, 7))
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string").coalesce(1)
    for k, ranks in enumerate((one, two, one)):
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(a) + b" " + str(b).encode() + b"\n" for a, b in ranks.items()))
        row = packing.packed_ids(docs, length=8, ranks=str(path), end=None).first()
        assert np.frombuffer(row.input_ids, "<i4")[:3].tolist() == [ranks[b"a"], ranks[b"b"], ranks[b"c"]]
