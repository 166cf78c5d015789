"""Removal of repeats against a table of all windows."""

from __future__ import annotations

import hashlib

import pytest
from awkward import COLUMNS, corpus, outcome, words_of

from lyrebird.llm.repeats import repeated_passages


def brute(rows, k=50):
    first: dict = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            for s in range(len(w) - k + 1):
                g = tuple(w[s : s + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {s + j for s in range(len(w) - k + 1) if i is not None and first[tuple(w[s : s + k])] < i for j in range(k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    got = repeated_passages(spark.createDataFrame(rows, COLUMNS).repartition(3))
    wanted = [r[:4] for r in brute(rows)]
    assert outcome(got) == wanted and sum(r[2] > 0 for r in wanted) > 10


def test_other_windows(docs, rows):
    assert outcome(repeated_passages(docs, window=10, phrase=3)) == [r[:4] for r in brute(rows, 10)]


@pytest.mark.parametrize("phrase", [1, 8, 50])
def test_phrase_changes_no_result(docs, rows, phrase):
    assert outcome(repeated_passages(docs, phrase=phrase)) == [r[:4] for r in brute(rows)]


def test_kept_text(docs, rows):
    wanted = {(r[0], r[3]): r for r in brute(rows)}
    for r in repeated_passages(docs, kept=True).collect():
        w = wanted[r.doc_id, r.kept_sha256]
        assert r.kept == w[4] if r.n_removed else r.kept is None


def test_odd_tables(docs, odd_docs, no_docs):
    assert outcome(repeated_passages(odd_docs)) == outcome(repeated_passages(docs))
    assert repeated_passages(no_docs).count() == 0


def test_many_shards_and_parts(spark, docs, rows, monkeypatch):
    from lyrebird.llm import repeats

    monkeypatch.setattr(repeats, "SHARD_PHRASES", 3)
    monkeypatch.setattr(repeats, "PART_BYTES", 2000)
    assert outcome(repeated_passages(docs)) == [r[:4] for r in brute(rows)]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_change_no_result(docs, rows, monkeypatch, size):
    from lyrebird.llm import repeats

    monkeypatch.setattr(repeats, "SHARD_PHRASES", 2)
    monkeypatch.setattr(repeats, "PIECE_WINDOWS", size)
    assert outcome(repeated_passages(docs)) == [r[:4] for r in brute(rows)]


def test_long_text_of_many_shards_goes_in_pieces():
    import pyarrow as pa

    from lyrebird.llm.repeats import _pieces

    words = [f"w{i}" for i in range(1000)]
    # a hundred shards, each with a phrase of one piece of ten windows
    asked = [{"piece": p, "shard": 1000 + p} for p in range(96)]
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("shard", pa.int32())]))
    held = pa.record_batch({"doc_id": [7], "key": [8], "text": ["\t".join(words)], "asked": pa.array([asked], kind)})
    got = [r for batch in _pieces(50, 10)(iter([held])) for r in batch.to_pylist()]
    assert [(r["doc_id"], r["key"], r["piece"], r["shard"]) for r in got] == [(7, 8, p, 1000 + p) for p in range(96)]
    assert all(r["text"].decode().split() == words[10 * r["piece"] : 10 * r["piece"] + 59] for r in got)


def test_automata_locate():
    from lyrebird.llm.repeats import _automaton, _block_windows, _located

    words = b"a bb a bb c a bb a bb \xc3\xa9 bb bb".split()
    phrases = [b"a bb", b"bb a bb", b"\xc3\xa9 bb", b"b a", b"bb bb"]
    wanted = sorted(i for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert sorted(_located(_automaton(phrases), words).tolist()) == wanted
    import pyarrow as pa

    from lyrebird.llm.words import PLAIN, word_blocks

    text = " ".join(f"w{i}" for i in range(90))
    documents = pa.record_batch({"doc_id": [1], "key": [2], "text": [text]})
    block = next(word_blocks(documents["text"], PLAIN))
    # without the phrase in the automaton no window comes forth; with every phrase all do
    assert not list(_block_windows(documents, block, _automaton([b"x y"]), 50, 8))
    every = [b" ".join(text.encode().split()[i : i + 8]) for i in range(83)]
    assert next(_block_windows(documents, block, _automaton(every), 50, 8))["start"].to_pylist() == list(range(41))
