"""The stages of the pipeline, each on awkward tables, and the whole of it."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "packing"]


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, DATA)
    assert out.columns == odd_docs.columns and set(r.doc_id for r in out.collect()) <= set(r.doc_id for r in odd_docs.collect())
    empty = stage(spark, no_docs, DATA)
    assert empty.columns == no_docs.columns and empty.count() == 0


def test_clashing_ids(spark, tmp_path):
    """Unlinked rows of one id go through all stages that keep rows."""
    words = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    rows = [(1, words(1), "en", "s", 1), (1, words(2), "en", "s", 1), (2, words(3), "en", "s", 1), (2, words(3), "en", "s", 1), (3, words(1) + " more", "en", "s", 1), (None, words(4), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    distinct = P.distinct_documents(spark, docs, DATA)
    assert sorted(r.text for r in distinct.collect()) == sorted([words(1), words(2), words(3), words(4)])
    assert sorted(r.text for r in P.clean_documents(spark, distinct, DATA).collect()) == sorted(r.text for r in distinct.collect())
    packed = P.packed_documents(spark, docs, DATA).collect()
    assert sorted((d is None, d or 0) for r in packed for d, at in zip(r.doc_ids, r.doc_offsets, strict=True) if at == 0) == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_packing_of_awkward_tables(spark, odd_docs, no_docs):
    rows = P.packed_documents(spark, odd_docs, DATA).collect()
    begun = [d for r in rows for d, at in zip(r.doc_ids, r.doc_offsets, strict=True) if at == 0]
    assert sorted((d is None, d or 0) for d in begun) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd_docs.select("doc_id").collect())
    assert P.packed_documents(spark, no_docs, DATA).count() == 0


def test_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    rows = P.run(spark, DATA).collect()
    begun = [d for r in rows for d, at in zip(r.doc_ids, r.doc_offsets, strict=True) if at == 0]
    assert sorted(begun) == sorted(kept) and max(np.unique(kept, return_counts=True)[1]) <= 2


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_whole_against_plain_stages(spark, tmp_path):
    """run() against the same five decisions taken in plain Python."""
    import hashlib
    import random

    import tiktoken
    from awkward import COLUMNS, corpus
    from pyspark.sql import functions as F
    from test_decontamination import brute as leaks
    from test_jaccard import brute as components
    from test_mixing import reshared, sizes_of
    from test_quality import plain_features

    from lyrebird.llm import mixing, packing, quality

    rows = list({r[0]: r for r in corpus(5) if r[0] is not None}.values())
    rng = random.Random(0)
    labels = [(r[0], int(rng.random() < 0.7 if r[1] and len(r[1]) > 40 else 0)) for r in rows]
    items = [(1, " ".join(rows[4][1].split()[:15]) if rows[4][1] else "none"), (2, "words that no document has at all, in any order of them")]
    for name, table, columns in (("documents", rows, COLUMNS), ("labels", labels, "doc_id long, quality int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(table, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    m = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))

    def score(text):
        f = plain_features(text)
        margin = m["weights"][f].sum() / np.sqrt(max(1e-12, (m["ratio"][f] ** 2).sum())) if f else 0.0
        return 1 / (1 + np.exp(-(m["a"] * (margin + m["bias"]) + m["b"])))

    good = [r for r in rows if score(r[1]) >= P.LEAST_QUALITY]
    heads = {c for _, _, c in components(good)}
    distinct = [r for r in good if r[0] in heads]
    dirty = {h[0] for h in leaks(distinct, items) if h[5]}
    clean = [r for r in distinct if r[0] not in dirty]
    assert len(rows) > len(good) > len(distinct) > len(clean) > 10
    sizes, targets, taken = sizes_of(clean), reshared(sizes_of(clean)), []
    for source in sizes:
        own = [(r, len((r[1] or "").encode().split()), int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32) for r in clean if r[3] == source]
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        copies = [[int(rate) + ((u + k / mixing.SEEDS) % 1 < rate - int(rate)) for _, _, u in own] for k in range(mixing.SEEDS)]
        best = min(copies, key=lambda c: abs(sum(n * s for n, (_, s, _) in zip(c, own, strict=True)) - targets[source]))
        taken += [r for n, (r, _, _) in zip(best, own, strict=True) for _ in range(n)]
    coder = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=packing.load_ranks(packing.RANKS), special_tokens={})
    wanted = sorted((r[0], at, ids[at : at + packing.LENGTH]) for r in taken if (ids := [*coder.encode_ordinary(r[1] or ""), packing.END]) for at in range(0, len(ids), packing.LENGTH))
    got = []
    for r in P.run(spark, str(tmp_path)).collect():
        ids = np.frombuffer(r.input_ids, "<i4")
        got += [(d, at, ids[a:b].tolist()) for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False)]
    assert sorted(got) == wanted
