"""Targets against repeated resharing, and what the mix takes."""

from __future__ import annotations

import random

import pytest
from awkward import COLUMNS, outcome, words_of
from pyspark.sql import functions as F

from lyrebird.llm import mixing


def reshared(sizes: dict) -> dict:
    """Share by weight, take off what is above twice the size, share it again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, total = dict.fromkeys(names), {}, 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(full.values())) / max(1e-300, sum(weight[s] for s in left))
        over = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in left}
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]


def sizes_of(rows):
    out: dict = {}
    for _, t, _, source, *_ in rows:
        out[source] = out.get(source, 0) + len(words_of(t))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 7, 100, 5000, 10**9]) for s in ["a", "Z", "é", "漢", "", "b", "bb", "😀", None][: rng.randrange(1, 10)]}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    wanted = reshared(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert {r.source: r.source_size for r in got} == sizes
    for r in got:
        assert r.target == pytest.approx(wanted[r.source], abs=1e-9)


def test_word_counts(docs, rows):
    got = docs.select("doc_id", mixing.word_count(F.col("text")).alias("n"))
    wanted = [(i, len(words_of(t))) for i, t, *_ in rows]
    assert outcome(got) == sorted(wanted, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_plan(docs, odd_docs, no_docs, rows):
    plan = mixing.mix_plan(docs).collect()
    targets = reshared(sizes_of(rows))
    assert len(plan) == len(rows)
    for r in plan:
        assert r.target == pytest.approx(targets[r.source]) and r.copies <= 2 and r.source_size == sizes_of(rows)[r.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and (rate != int(rate) or r.copies == rate)
    assert outcome(mixing.mix_plan(docs.repartition(7))) == outcome(mixing.mix_plan(odd_docs))
    assert mixing.mix_plan(no_docs).count() == 0


def test_taken_words_come_near(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), "en", f"s{rng.randrange(4)}", 1) for i in range(6000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, COLUMNS))
    for r in plan.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


def test_small_sources_come_near(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 400), "en", f"s{i % 40}", 1) for i in range(2000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, COLUMNS)).collect()
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert len({r.target for r in own}) == 1 and abs(sum(r.size * r.copies for r in own) - own[0].target) < 0.05 * own[0].target
    one = mixing.mix_plan(spark.createDataFrame([(1, "w " * 1000, "en", "a", 1), (2, "w " * 10, "en", "b", 1)], COLUMNS)).collect()
    assert all(r.copies in (1, 2) for r in one)


def test_columns_with_the_names_of_the_mix(docs):
    from pyspark.sql import functions as F

    odd = docs.select("*", *[F.lit(c).alias(c) for c in ("_mix_source", "_mix_rate", "_mix_turn", "_mix_copy", "number", "turn", "copies", "taken0")])
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and {r["_mix_copy"] for r in out.collect()} == {"_mix_copy"}
    assert outcome(out.select("doc_id", "source")) == outcome(mixing.mixed_documents(docs).select("doc_id", "source"))


def test_documents(odd_docs, no_docs):
    copies = mixing.mix_plan(odd_docs).select("doc_id", "source", "size", "copies").collect()
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.copies for r in copies)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_plan_has_no_python(docs):
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
