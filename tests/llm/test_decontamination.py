"""Decontamination against a search of every window in every document."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from awkward import COLUMNS, outcome

from lyrebird.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            if item is None or not b:
                continue
            k = min(10, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    some = [(i, " ".join(t.split()[3 : 3 + n])) for i, (t, n) in enumerate(zip(texts[:12], [5, 9, 10, 11, 12, 25, 1, 2, 3, 4, 60, 10], strict=True))]
    return [*some, (100, some[4][1].upper() + "!"), (100, some[4][1]), (20, ""), (21, None), (None, some[3][1]), (22, "¿?"), (23, "not in any text at all, I think so, no")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def digest(hits):
    from pyspark.sql import functions as F

    return hits.select("doc_id", "n_words", D.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("h"), (F.size("items") > 0).alias("c"))


def test_against_all_windows(docs, benchmark, rows, items):
    assert outcome(digest(D.benchmark_hits(docs, benchmark))) == brute(rows, items)


def test_several_passes(spark, rows, benchmark, items):
    once = list({r[0]: r for r in rows if r[0] is not None}.values())
    docs = spark.createDataFrame(once, COLUMNS)
    assert outcome(digest(D.benchmark_hits(docs, benchmark, block_windows=7))) == brute(once, items)


def test_several_passes_of_repeated_and_null_ids(docs, odd_docs, no_docs, benchmark, rows, items):
    assert outcome(digest(D.benchmark_hits(docs, benchmark, block_windows=7))) == brute(rows, items)
    assert outcome(digest(D.benchmark_hits(odd_docs, benchmark, block_windows=7))) == brute(rows, items)
    assert D.benchmark_hits(no_docs, benchmark, block_windows=7).count() == 0


def test_odd_tables(docs, odd_docs, no_docs, benchmark, rows, items):
    none = benchmark.where("false")
    assert D.benchmark_hits(no_docs, benchmark).count() == 0
    assert outcome(digest(D.benchmark_hits(docs, none))) == brute(rows, [])
    assert outcome(digest(D.benchmark_hits(odd_docs, benchmark))) == brute(rows, items)


@pytest.mark.parametrize("block_windows", [7, 1000])
def test_clean_rows(odd_docs, no_docs, benchmark, rows, items, block_windows):
    kept = D.decontaminated(odd_docs, benchmark, block_windows=block_windows)
    assert kept.columns == odd_docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t, *_ in rows if not brute([(i, t)], items)[0][5])
    assert D.decontaminated(no_docs, benchmark).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_windows_of_few_words(spark, seed):
    """Few different words, so that shingles are frequent and places many; texts of null, one word and many."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(["a", "b", "c", "Ü"]) for _ in range(n))
    rows = [(draw.choice([None, draw.randrange(40)]), draw.choice([None, "", text(1), text(draw.randrange(400))])) for _ in range(150)]
    rows += [(7, "a " * 3000), (8, "a " * 3000)]
    items = [(i, text(draw.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(60)] + [(None, "a"), (61, None), (62, "a " * 30)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert outcome(digest(D.benchmark_hits(docs, benchmark, block_windows=0))) == brute(rows, items)
    shared, shuffled = (D.benchmark_hits(docs, benchmark, block_windows=n) for n in (1000, 0))
    pairs = [(s.doc_id, s.n_words, sorted(zip(s.spans[::2], s.spans[1::2], strict=True)), s.items) for s in shared.collect()]
    assert sorted(pairs, key=str) == sorted(
        [(s.doc_id, s.n_words, list(zip(s.spans[::2], s.spans[1::2], strict=True)), s.items) for s in shuffled.collect()], key=str
    )
    long_items = benchmark.where("item_id is null or length(text) > 19")
    clean = [str(r) for r in rows if not brute([r], [i for i in items if i[0] is None or len(i[1] or "") > 19])[0][5]]
    assert sorted(str((r.doc_id, r.text)) for r in D.decontaminated(docs, long_items, block_windows=0).collect()) == sorted(clean)
