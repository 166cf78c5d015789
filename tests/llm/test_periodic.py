"""Periodic runs against a plain search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from awkward import outcome, words_of

from lyrebird.llm.periodic import least_match, periodic_runs, planted_period, run_digests, runs_of_rows


def plain_runs(w: list, least_words: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        start = None
        for k in range(len(w) - q + 1):
            equal = k < len(w) - q and w[k] == w[k + q]
            if equal and start is None:
                start = k
            elif not equal and start is not None:
                if k - start + q >= max(least_words, least_exponent * q):
                    found.setdefault((start, k - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w: list, runs: list[tuple[int, int, int]]) -> list:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def random_rows(rng: random.Random) -> list[list[int]]:
    rows = []
    for _ in range(rng.randrange(1, 5)):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(rng.choice([10, 60, 200])))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = [rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 12)
        rows.append(w)
    return rows


@pytest.mark.parametrize("limits", [(6, 4), (3, 3), (9, 3), (2, 5), (20, 4)])
def test_against_all_periods(limits):
    rng = random.Random(7)
    for _ in range(250):
        rows = random_rows(rng)
        ids = np.array([x for r in rows for x in r], np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        found = runs_of_rows(ids, bounds, *limits)
        assert [found.get(i, []) for i in range(len(rows))] == [plain_runs(r, *limits) for r in rows]


def test_shape_of_runs():
    run = lambda w: runs_of_rows(np.array(w, np.uint64), np.array([0, len(w)])).get(0, [])
    assert run([1] * 5) == [] and run([1] * 6) == [(0, 6, 1)]
    assert run([1, 2] * 4) == [(0, 8, 2)] and run([1, 2] * 3) == []
    assert run([9, *[1, 2, 3] * 4, 1, 2, 9]) == [(1, 14, 3)]
    assert run([*[1] * 7, *[2] * 7]) == [(0, 7, 1), (7, 7, 1)]
    assert least_match(6, 4) == 5


def test_long_stretches_stay_linear():
    assert runs_of_rows(np.ones(100_000, np.uint64), np.array([0, 100_000])) == {0: [(0, 100_000, 1)]}
    fold = [1, 2]
    while len(fold) < 30_000:
        fold = fold + [1] + fold[: len(fold) // 2]
    assert runs_of_rows(np.array(fold, np.uint64), np.array([0, len(fold)]))[0] == plain_runs_fast(fold)


def plain_runs_fast(w: list[int]) -> list[tuple[int, int, int]]:
    """The same as plain_runs with whole arrays."""
    w, found = np.array(w), {}
    for q in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text) -> tuple:
    w = words_of(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(plain_collapsed(w, runs))).hexdigest(),
    )


def test_digests_of_awkward_rows(rows, odd_docs):
    short = [r for r in rows if len(r[1] or "") < 8000]
    assert len(short) > 80
    got = outcome(run_digests(odd_docs))
    wanted = sorted((expected(r[0], r[1]) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert got == wanted
    assert sum(r[1] for r in got) > 3


def test_no_documents(no_docs):
    assert run_digests(no_docs).collect() == [] and periodic_runs(no_docs).collect() == []


def test_planted_tails():
    assert planted_period(None, 9) is None and planted_period(3, 0) is None
    chosen = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    at = planted_period(chosen, 50)
    assert len(at) == 50 and at.max() < 50


def test_texts_without_repeats(spark):
    data = [(1, "x y " * 5 + "end", "a"), (2, None, "b"), (3, " \t", "c"), (4, "a  b\nc", "d"), (4, "a  b\nc", "d")]
    df = spark.createDataFrame(data, "doc_id long, Text string, RUNS string")
    out = periodic_runs(df, text="Text").collect()
    assert periodic_runs(df, text="Text").columns == ["doc_id", "Text", "runs", "collapsed_text"]
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed_text) for r in sorted(out, key=lambda r: r.doc_id)] == [
        (1, [(0, 10, 2)], "x y end"), (2, [], None), (3, [], ""), (4, [], "a b c"), (4, [], "a b c"),
    ]
    assert periodic_runs(df, text="Text", collapsed=None).columns == ["doc_id", "Text", "runs"]
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs(df, least_exponent=2)


def test_a_long_text(spark):
    body = " ".join([f"w{i}" for i in range(40_000)] + ["r s t"] * 5_000)
    [row] = periodic_runs(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(40_000, 15_000, 3)] and row.collapsed_text.endswith("w39999 r s t")
