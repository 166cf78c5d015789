"""Texts longer than a block of words, in every operator that reads them in blocks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from awkward import COLUMNS

from lyrebird.llm import decontamination, jaccard, mixing, packing, quality, repeats, sharding, telephony, wordpieces
from lyrebird.llm.words import BLOCK_BYTES

PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="module")
def long_rows():
    word = lambda i, k: f"{i * (2654435761 + k) % 999983:x}"
    body = " ".join(word(i, 1) for i in range(800_000))
    near = body.replace(" ", "  ", 3) + " end"
    texts = ["short text of a few words", body, near, f"{' '.join(word(i, 2) for i in range(760_000))} {PASSAGE}", f"{PASSAGE} behind it"]
    assert sum(len(t) > BLOCK_BYTES for t in texts) == 3
    return [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, COLUMNS).repartition(2).cache()


def test_pairs_and_passages(spark, long_docs, long_rows):
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(long_docs)[0].collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: r for r in repeats.repeated_passages(long_docs).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {0: 0, 1: 0, 2: 800_000, 3: 0, 4: 60}
    assert got[2].kept_sha256 == hashlib.sha256(b"end").hexdigest() and got[4].kept_sha256 == hashlib.sha256(b"behind it").hexdigest()
    items = spark.createDataFrame([(7, " ".join(PASSAGE.split()[40:])), (8, " ".join(long_rows[1][1].split()[-9:]))], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r["items"]) for r in decontamination.benchmark_hits(long_docs, items).collect()}
    assert hits == {0: (6, []), 1: (800_000, ["8"]), 2: (800_001, ["8"]), 3: (760_060, ["7"]), 4: (62, ["7"])}


def test_single_rows(long_docs, long_rows):
    words = {i: len(t.split()) for i, t, *_ in long_rows}
    assert {r.doc_id: r["size"] for r in mixing.mix_plan(long_docs).collect()} == words
    counts = {r.doc_id: r for r in wordpieces.token_counts(long_docs, [chr(c) for c in range(33, 127)] + ["\u2581"]).collect()}
    assert {i: (r.n_words, r.n_tokens, r.n_unknown) for i, r in counts.items()} == {i: (words[i], sum(len(w) + 1 for w in t.split()), 0) for i, t, *_ in long_rows}
    shards = sharding.kd_shards(long_docs, 2).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in shards} == {(i, len(t) + 8, zlib.crc32(t.encode())) for i, t, *_ in long_rows}
    model = {"ratio": np.ones(quality.FEATURES), "weights": np.ones(quality.FEATURES), "bias": 0.0, "a": 1.0, "b": 0.0}
    assert all(0 <= r.score <= 1 for r in quality.score_quality(long_docs, model).collect())


def test_packed(long_docs, long_rows):
    parts: dict = {}
    for r in packing.packed_ids(long_docs).collect():
        ids = np.frombuffer(r.input_ids, "<i4")
        for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(d, {})[at] = ids[a:b].tolist()
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=packing.load_ranks(packing.RANKS), special_tokens={})
    for i, text, *_ in long_rows:
        whole = [x for at in sorted(parts[i]) for x in parts[i][at]]
        assert whole[-1] == packing.END and coder.decode(whole[:-1]) == text


def test_stored_audio(long_docs, long_rows):
    got = {r.doc_id: r for r in telephony.media_columns(long_docs, blobs=False).collect()}
    for i, text, *_ in long_rows:
        payload = text.encode() + bytes(64 - len(text.encode()) % 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
