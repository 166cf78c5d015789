"""K-d shards: every row once, near-equal bytes, slots without gaps."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from awkward import COLUMNS, corpus, outcome

from lyrebird.llm import sharding
from lyrebird.llm.sharding import kd_shards


def check(rows, got, shards, slack):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    total, slots = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) - min(total) <= slack, total


def test_even_bytes(spark):
    rows = [(i, "ab " * (i * 7919 % 50), "en", f"s{i % 3}", 1) for i in range(4000)]
    rows += [(10_000 + i, "one text that a third of all rows have, word for word", "en", "s1", 1) for i in range(2000)]
    got = kd_shards(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    check(rows, got, 24, 0.12 * sum(r.size for r in got) / 24)


def test_awkward_rows(docs, odd_docs, no_docs, rows):
    largest = max(len((t or "").encode()) + 8 for _, t, *_ in rows)
    got = kd_shards(docs, 4).collect()
    check(rows, got, 4, 3 * largest)
    assert outcome(kd_shards(odd_docs, 4).select("doc_id", "size", "shard")) == outcome(kd_shards(docs.repartition(5), 4).select("doc_id", "size", "shard"))
    assert kd_shards(no_docs).count() == 0


def test_fewer_rows_than_shards(spark):
    rows = corpus(9, 1)[:5]
    got = kd_shards(spark.createDataFrame(rows, COLUMNS)).collect()
    check(rows, got, 24, 10**9)


def test_one_text_only(spark):
    rows = [(i, "same", "en", "s", 4) for i in range(480)]
    got = kd_shards(spark.createDataFrame(rows, COLUMNS), 8).collect()
    check(rows, got, 8, 6 * 12)


def test_plan_has_no_python(docs):
    plan = kd_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute(rows, shards):
    """The tree with whole sorted lists, one coordinate at a time."""
    sizes = [len((t or "").encode()) + 8 for _, t, *_ in rows]
    low, high = np.log2(min(sizes)), np.log2(max(sizes))
    ranks = [{v: k for k, v in enumerate(sorted({r[c] for r in rows} - {None}, key=lambda v: v.encode()) + [None] * any(r[c] is None for r in rows))} for c in (3, 2)]
    points = []
    for (i, t, lang, source, *_), size in zip(rows, sizes, strict=True):
        tie = zlib.crc32((t or "").encode()) >> 32 - sharding.TEXT_BITS << sharding.ID_BITS
        tie += (42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)) % (1 << sharding.ID_BITS)
        top = (1 << sharding.VALUE_BITS) - 1
        own = [int(top * (np.log2(size) - low) / max(high - low, 1e-9)), *(r[v] * top // max(len(r) - 1, 1) for r, v in zip(ranks, (source, lang), strict=True))]
        points.append([(min(v, top) << sharding.TEXT_BITS + sharding.ID_BITS) + tie for v in own])
    out, dims = {}, []

    def cut(own, k, first):
        if k == 1 or not own:
            out.update(dict.fromkeys(own, first))
            return
        wide = [np.std([points[i][d] >> sharding.TEXT_BITS + sharding.ID_BITS for i in own]) for d in range(3)]
        d = wide.index(max(wide))
        dims.append(d)
        goal, below, at = sum(sizes[i] for i in own) * (k // 2) / k, 0, None
        for x in sorted({points[i][d] for i in own}):
            mass = sum(sizes[i] for i in own if points[i][d] == x)
            if below + mass >= goal:
                at = x + 1 if abs(below + mass - goal) <= abs(below - goal) else x
                break
            below += mass
        cut([i for i in own if points[i][d] < at], k // 2, first)
        cut([i for i in own if points[i][d] >= at], k - k // 2, first + k // 2)

    cut(list(range(len(rows))), shards, 0)
    return [out[i] for i in range(len(rows))], dims


@pytest.mark.parametrize("seed,shards", [(1, 7), (4, 24)])
def test_against_whole_lists(spark, seed, shards):
    rows = corpus(seed)
    rows = [(i, t, ("en", "de", None)[len(t or "") % 3], s, n) for i, t, _, s, n in rows]
    wanted, dims = brute(rows, shards)
    got = kd_shards(spark.createDataFrame(rows, COLUMNS).repartition(3), shards, fine=0.0).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text_crc32, r.shard) for r in got), key=key) == sorted(((r[0], zlib.crc32((r[1] or "").encode()), s) for r, s in zip(rows, wanted, strict=True)), key=key)
    assert len(set(dims)) > 1


def test_only_size_spreads(spark):
    rows = [(i, "x" * (i * 7919 % 3001), "en", "s", 1) for i in range(900)]
    wanted, dims = brute(rows, 6)
    assert set(dims) == {0}
    got = kd_shards(spark.createDataFrame(rows, COLUMNS), 6).collect()
    edges = [(min(s), max(s)) for k in range(6) if (s := [r.size for r in got if r.shard == k])]
    assert all(a[1] <= b[0] for a, b in zip(edges[:-1], edges[1:], strict=True))


def test_half_of_one_text_is_cut_at_many_places(spark):
    rows = [(i, "the same text", "en", "s", 1) for i in range(3000)] + [(9000 + i, "x" * i, "en", "s", 1) for i in range(60)]
    got = kd_shards(spark.createDataFrame(rows, COLUMNS), 24).collect()
    check(rows, got, 24, 0.05 * sum(r.size for r in got) / 24 + 60)
