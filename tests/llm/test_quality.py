"""The classifier: held-out accuracy, what it may learn from, and odd tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from awkward import COLUMNS
from pyspark.sql import functions as F

from lyrebird.llm import quality
from lyrebird.staging import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return table(spark, DATA, "documents"), table(spark, DATA, "labels")


@pytest.fixture(scope="module")
def model(given):
    return quality.train(*given)


def test_held_out_accuracy(given, model):
    scored = quality.score_quality(given[0].select("doc_id", "text"), model).join(given[1], "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.95


def test_held_out_labels_are_not_used(given, model):
    docs, labels = given
    hidden = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), flipped)
    assert np.array_equal(again["weights"], model["weights"]) and again["bias"] == model["bias"]


def test_sample_is_bounded(given):
    small = quality.train(*given, sample_rows=40)
    assert np.isfinite(small["weights"]).all() and small["weights"].any()
    assert not np.array_equal(small["ratio"], np.zeros(quality.FEATURES))


def test_odd_tables(spark, docs, odd_docs, no_docs, given, model):
    got = quality.score_quality(odd_docs, model, score="s2").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.s2 <= 1 for r in got)
    by_text: dict = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.s2) == r.s2
    assert quality.score_quality(no_docs, model).count() == 0
    none = given[1].where("false")
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(r.doc_id, 1) for r in docs.collect() if r.doc_id] + [(None, 0), (-5, 0)], "doc_id long, quality int")
    assert min(r.score for r in quality.score_quality(docs, quality.train(docs, one)).collect()) > 0.9
    messy = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    assert quality.train(no_docs, messy)["b"] == 0.0
    assert spark.createDataFrame([(None, "x", "", "", 0)], COLUMNS).select(quality.learnable(F.col("doc_id")).alias("l")).first().l is False


def plain_features(text):
    """Byte pairs, hashed byte triples and bands of repeat shares, one by one."""
    data, words = (text or "").encode(), (text or "").encode().split()
    found = {data[i] << 8 | data[i + 1] for i in range(len(data) - 1)}
    found |= {quality.PAIRS + ((int.from_bytes(data[i : i + 3]) * 2654435761 % (1 << 32)) >> 15) for i in range(len(data) - 2)}
    pairs = list(zip(words, words[1:], strict=False))
    if pairs:
        shares = 1 - len(set(pairs)) / len(pairs), sum(a == b for a, b in pairs) / len(pairs)
        found |= {quality.PAIRS + quality.TRIPLES + 10 * k + min(9, int(20 * s)) for k, s in enumerate(shares)}
    return sorted(found)


def plain_fit(features, labels, ratio):
    """Dual coordinate descent on the hinge loss with whole vectors and lists."""
    rows = []
    for own in features:
        x = {f: ratio[f] for f in own}
        size = sum(v * v for v in x.values()) ** 0.5 or 1.0
        rows.append({f: v / size for f, v in x.items()} | {"bias": 1.0})
    y = [1 if l == 1 else -1 for l in labels]
    rare = max(1.0, (y.count(1) / max(1, y.count(-1))) ** 0.5)
    w, alpha, order = {}, [0.0] * len(y), np.random.default_rng(5)
    for _ in range(quality.PASSES):
        for i in order.permutation(len(y)).tolist():
            margin = y[i] * sum(w.get(f, 0.0) * v for f, v in rows[i].items())
            new = min(max(alpha[i] - (margin - 1) / 2, 0.0), quality.COST * (rare if y[i] < 0 else 1.0))
            for f, v in rows[i].items():
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y[i] * v
            alpha[i] = new
    return w


def plain_ratio(texts, labels):
    counts = np.full((2, quality.FEATURES), quality.SMOOTHING)
    for t, l in zip(texts, labels, strict=True):
        counts[l, plain_features(t)] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def test_fit_and_ratios_against_a_plain_version(spark, given):
    learnt = given[0].join(given[1], "doc_id").where(quality.learnable(F.col("doc_id"))).select("doc_id", "text", "quality").limit(60).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in learnt], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(r.doc_id, r.quality) for r in learnt], "doc_id long, quality int"))
    ratio = plain_ratio([r.text for r in learnt], [r.quality for r in learnt])
    assert np.allclose(model["ratio"], ratio, atol=1e-12)
    # the rows in the order of the operator: by the hash of their id
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    ordered = sorted(learnt, key=lambda r: keys[r.doc_id])
    w = plain_fit([plain_features(r.text) for r in ordered], [r.quality for r in ordered], ratio)
    own = np.zeros(quality.FEATURES)
    for f, v in w.items():
        if f != "bias":
            own[f] = v
    assert abs(model["bias"] - w["bias"]) < 1e-8 and np.allclose(model["weights"], own * ratio, atol=1e-8)
    scored = quality.score_quality(docs, model).collect()
    for r in scored:
        f = plain_features(r.text)
        margin = (own[f] @ ratio[f]) / np.sqrt(max(1e-12, (ratio[f] ** 2).sum())) if f else 0.0
        assert abs(r.score - 1 / (1 + np.exp(-(model["a"] * (margin + model["bias"]) + model["b"])))) < 1e-6


def test_a_column_of_the_score(odd_docs, model):
    out = quality.score_quality(odd_docs, model)
    assert sorted(out.columns) == sorted(odd_docs.columns) and all(0 <= r.score <= 1 for r in out.collect())
