"""Personal data against plain patterns, and disguised copies that a model has not seen."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from awkward import outcome

from lyrebird.llm import personal
from lyrebird.llm.personal import KINDS, Covered, base_spans, boosted, candidates, features, isotonic, margins, personal_spans, span_digests, spans_of, train


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def with_check_digit(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if personal.luhn(body + d))


def personal_rows(n: int, seed: int = 4) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        extra = [
            f"{rng.choice(vocab)}.{rng.randrange(99)}@{rng.choice(vocab)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), with_check_digit(rng),
            f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", str(rng.randrange(10**6)), f"{rng.randrange(999)}.{rng.randrange(99)}",
        ]
        for x in rng.sample(extra, 3):
            words.insert(rng.randrange(len(words)), x)
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    return train(spark.createDataFrame(personal_rows(1500), "doc_id long, text string"))


def test_base_against_patterns():
    rng = random.Random(2)
    parts = ["1", "12", "255", "256", "0", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "_", "%", "é", "00192", " +1 (017) 555-7713 ", "000000255"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert base_spans(text) == plain_spans(text)


def test_digests_keep_base_spans(models, rows, odd_docs):
    got = {}
    for r in span_digests(odd_docs, models).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows:
        base = plain_spans(text or "")
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        match = [r for r in got[doc_id] if r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()]
        assert match and set(written) <= set(match[0]["spans"].split(",")) | ({""} if not written else set())
        assert [match[0][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]


def test_disguised_copies_are_found(models):
    """Rows and disguises of another seed."""
    assert set(models) == set(KINDS)
    rng, caught, wrong, all_ = random.Random(9), 0, 0, 0
    for doc_id, text in personal_rows(250, seed=77):
        for kind, start, end in base_spans(text):
            body = personal._disguised(kind, text[start:end], rng)
            if plain_spans(body):
                continue
            changed = text[:start] + body + text[end:]
            [(base, added)] = spans_of([changed], models)
            all_ += 1
            caught += any(s == (kind, start, start + len(body)) for s, _ in added)
            # elsewhere only what is such data by itself: patterns drop a number that another one follows
            wrong += sum((b <= start or a >= start + len(body)) and not plain_spans(changed[a:b]) for (_, a, b), _ in added)
    assert all_ > 150 and caught >= 0.9 * all_ and wrong <= 0.02 * all_


def test_clean_texts_stay_clean(models):
    for _, text in personal_rows(300, seed=31):
        clean = " ".join(w for w in re.sub(r"\+1 \([0-9]+\) [0-9-]+", "", text).split() if not plain_spans(w))
        assert [s for base, added in spans_of([clean], models) for s in [*base, *added]] == []


def test_spans_do_not_overlap(models):
    text = "7536784127813050 4845168114407329 and +1 (826) 555-4081 190.137.223.204 or a [at] b.example.com, a (at) b (dot) com"
    [(base, added)] = spans_of([text], models)
    spans = sorted([(a, b) for _, a, b in base] + [(a, b) for (_, a, b), _ in added])
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert all(not added for _, added in spans_of([text], {}))


def test_redaction(spark, models):
    df = spark.createDataFrame([(1, "to ann@x.org or +1 (017) 555-7713.", "c"), (2, None, "c"), (3, "", "c"), (3, "", "c")], "id long, Body string, SPANS string")
    out = sorted(personal_spans(df, models, text="Body").collect(), key=lambda r: r["id"])
    assert [(r["id"], [tuple(s)[:3] for s in r["spans"]], r["redacted_text"]) for r in out] == [
        (1, [("email", 3, 12), ("phone", 16, 33)], "to [EMAIL] or [PHONE]."), (2, [], None), (3, [], ""), (3, [], ""),
    ]
    assert personal_spans(df, models, text="Body", redacted=None).columns == ["id", "Body", "spans"]


def test_no_documents(spark, no_docs):
    assert train(no_docs) == {} and span_digests(no_docs, {}).collect() == []
    few = spark.createDataFrame([(1, "a@b.c"), (None, None)], "doc_id long, text string")
    assert train(few) == {}
    assert outcome(span_digests(few, {}))[0][:5] == (1, 1, 0, 0, 0)


@pytest.mark.parametrize("text", ["1" * 400_000, "1 " * 30_000, "a" * 400_000, "@" * 200_000, "a@b " * 60_000, "+1" * 100_000, "x at y " * 30_000, "(" * 200_000, "1.2.3.4 " * 10_000, "+1 " + " ." * 100_000])
def test_long_texts_take_linear_time(models, text):
    began = time.perf_counter()
    [(base, _)] = spans_of([text], models)
    assert time.perf_counter() - began < 30
    if len(text) < 100_000:
        assert base == plain_spans(text)


def test_boosting_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(int)
    model = boosted(x[:3000], y[:3000])
    assert ((margins(model, x[3000:]) > 0) == y[3000:]).mean() > 0.97
    at, p = isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 1, 1]))
    assert at.tolist() == [1, 2, 4] and p.tolist() == [0, 0.5, 1]


def test_helpers():
    taken = Covered([("a", 5, 9), ("b", 6, 7), ("c", 20, 22)])
    assert [taken(a, a + 2) for a in (3, 4, 8, 9, 18, 19, 21, 22)] == [False, True, True, False, False, True, True, False]
    every = list(candidates("mail ann (at) x dot org, 10[.]0[.]0[.]1, 4111 1111 1111 1111"))
    assert {c.kind for c in every} == set(KINDS) and len({len(features("x" * 99, c)) for c in every}) == 1
