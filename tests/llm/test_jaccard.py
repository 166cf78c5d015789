"""The Jaccard join against all pairs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from awkward import COLUMNS, corpus, outcome, words_of
from pyspark.sql import functions as F

from lyrebird.llm import jaccard
from lyrebird.llm.components import connected_components
from lyrebird.llm.rtree import CountTree


def shingles(text):
    w = words_of(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    known = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            both = len(s & t)
            if both and 100 * both >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = [(i, len(shingles(t)), None if i is None else find(i)) for i, t, *_ in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, COLUMNS).repartition(3))[0]
    assert outcome(got) == brute(rows)


def test_parts_and_hot_shingles(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_ROWS", 3)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "CELL_ROWS", 5)
    got = outcome(jaccard.jaccard_classes(docs)[0])
    assert got == brute(rows)


def test_cells_of_streamed_shingles():
    """Whatever the batches, sets that share a shingle share a cell."""
    rng = np.random.default_rng(3)
    for most, together in ((2, 4), (5, 9), (1000, 1000)):
        shingle = np.sort(np.concatenate([rng.integers(-9, 9, 60), np.full(17, 4), np.full(30, 8)]))
        doc = np.arange(len(shingle))
        hot = shingle == -3
        columns = {"shingle": shingle, "doc_id": doc, "n": np.full(len(doc), 10, np.int32), "hot": hot}
        whole = pa.record_batch({c: pa.array(v) for c, v in columns.items()})
        cuts = [0, *sorted(rng.integers(0, len(doc), 12).tolist()), len(doc)]
        found: dict = {}
        for out in jaccard._cells(most, together)(whole.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
            for cell, d in zip(out["cell"].to_pylist(), out["doc_id"].to_pylist(), strict=True):
                found.setdefault(cell, set()).add(d)
        wanted = {frozenset(doc[shingle == s].tolist()) for s in set(shingle.tolist()) if (shingle == s).sum() > 1}
        assert {frozenset(d) for d in found.values() if len(d) > 1} == wanted


def test_large_cells_lose_no_link(spark, monkeypatch):
    """Copies with few changes, in several components, that all have one passage."""
    monkeypatch.setattr(jaccard, "TREE_ROWS", 4)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 6)
    rng = random.Random(7)
    passage, rows = [f"p{i}" for i in range(60)], []
    for group in range(6):
        base = passage + [f"g{group}w{i}" for i in range(3 + 2 * group)]
        for k in range(9):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"x{group}_{k}"
            rows.append((len(rows) * 7 % 54 + 1, " ".join(copy), "en", "s", 1))
    assert outcome(jaccard.jaccard_classes(spark.createDataFrame(rows, COLUMNS).repartition(3))[0]) == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(base), "en", "s", 1)]
    for k in range(2, 30):  # k new words behind: 100 / (100 + k)
        rows.append((k, " ".join(base + [f"v{k}_{i}" for i in range(k)]), "en", "s", 1))
    got = outcome(jaccard.jaccard_classes(spark.createDataFrame(rows, COLUMNS))[0])
    assert got == brute(rows) and got[0][2] == 1


def test_chains_and_links(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[k * 6 : k * 6 + 104]), "en", "s", 1) for k in range(12)]
    members, links = jaccard.jaccard_classes(spark.createDataFrame(rows, COLUMNS))
    assert {r.component_id for r in members.collect()} == {89}
    sets = {i: shingles(t) for i, t, *_ in rows}
    for r in links.collect():
        assert r.shared == len(sets[r.a] & sets[r.b])


def test_empty_and_odd_tables(docs, odd_docs, no_docs):
    assert jaccard.jaccard_classes(no_docs)[0].count() == 0
    assert outcome(jaccard.jaccard_classes(odd_docs)[0]) == outcome(jaccard.jaccard_classes(docs)[0])


def plain_kept(rows):
    """The rows that stay, each judged by itself: one of each class of linked texts, by id and then by digest."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
    known = sorted({(r[0], digest(r[1]), r[1]) for r in rows if r[0] is not None}, key=lambda r: r[:2])
    numbered = [(k, t, "en", "s", 1) for k, (_, _, t) in enumerate(known)]
    heads = {k for k, _, c in brute(numbered) if k == c}
    return sorted((known[k][0], known[k][1]) for k in heads)


def kept_rows(df):
    return sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest() if r.text is not None else "") for r in df.collect() if r.doc_id is not None)


def test_deduplicated(docs, odd_docs, rows, no_docs):
    kept = jaccard.deduplicated(docs)
    assert kept_rows(kept) == plain_kept(rows)
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard.deduplicated(odd_docs).columns == odd_docs.columns and jaccard.deduplicated(odd_docs).count() == kept.count()
    assert jaccard.deduplicated(no_docs).count() == 0


def test_unlinked_texts_of_one_id_stay(spark):
    texts = {i: [" ".join(f"t{i}x{j}w{k}" for k in range(9)) for j in range(4)] for i in range(-2, 12)}
    rows = [(i, t, "en", "s", 1) for i, own in texts.items() for t in own]
    rows += [(100, texts[3][0], "en", "s", 1), (100, None, "en", "s", 1), (100, "", "en", "s", 1), (100, " ", "en", "s", 1), (3, texts[0][1], "en", "s", 1), rows[5], rows[5]]
    for own in (rows, [r for r in rows if r[0] >= 0]):
        assert kept_rows(jaccard.deduplicated(spark.createDataFrame(own, COLUMNS).repartition(3))) == plain_kept(own)
    three = [(1, texts[1][0], "en", "s", 1), (1, texts[1][1], "en", "s", 1), (2, texts[2][0], "en", "s", 1)]
    assert jaccard.deduplicated(spark.createDataFrame(three, COLUMNS)).count() == 3


def test_rows_equal_but_for_other_columns(spark):
    rows = [(1, "a b c", "en", "s2", 1), (1, "a b c", "en", "s1", 2), (1, "a b c", "de", "s0", 3), (2, "other words here", "en", "s", 1)]
    kept = [jaccard.deduplicated(spark.createDataFrame(r, COLUMNS)).orderBy("doc_id").collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [r.doc_id for r in kept[0]] == [1, 2] and kept[0][0].source == "s0"


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(0)
    points = rng.poisson(rng.uniform(0.5, 3, (150, 1)), (150, 64)).astype(np.uint16)
    points[60:120] = np.clip(points[:60].astype(int) + rng.integers(-1, 2, (60, 64)) * (rng.random((60, 64)) < 0.1), 0, None)
    sizes = points.sum(1, dtype=np.int64)
    tags = rng.integers(0, 40, 150)
    tree = CountTree(points, sizes, tags)
    for i in range(150):
        shared = np.minimum(points, points[i]).sum(1, dtype=np.int64)
        fits = (9 * shared >= 4 * (sizes + sizes[i])) & (5 * sizes >= 4 * sizes[i]) & (4 * sizes <= 5 * sizes[i]) & (tags != tags[i])
        assert sorted(tree.probe(points[i], sizes[i], tags[i]).tolist()) == np.flatnonzero(fits).tolist()


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 230)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: find(x) for x in linked} and len(found) == len(linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.range(1).select(F.lit(3).cast("long").alias("a"), F.lit(3).cast("long").alias("b"))).count() == 0


@pytest.mark.parametrize("most", [0, 5, 40])
def test_bound_of_frequent_shingles_changes_no_class(spark, docs, monkeypatch, most):
    monkeypatch.setattr(jaccard, "FREQUENT", 0.0)
    every = outcome(jaccard.jaccard_classes(docs)[0])
    monkeypatch.setattr(jaccard, "LISTED", most)
    assert outcome(jaccard.jaccard_classes(docs)[0]) == every


def test_most_frequent_shingles_are_listed(spark):
    counts = spark.createDataFrame([(i, 8 + i // 3) for i in range(300)], "one long, often long")
    for most in (0, 2, 3, 50, 299, 300, 1000):
        got = sorted(r.one for r in jaccard._most_frequent(counts, most).collect())
        assert len(got) <= most and got == list(range(300 - len(got), 300))
    assert jaccard._most_frequent(counts, 300).count() == 300
    assert jaccard._most_frequent(counts.limit(0), 5).count() == 0
