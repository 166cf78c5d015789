"""Personal data by candidates, boosted trees and calibrated thresholds.

1. Base patterns find plain emails, network addresses, card and phone numbers, and
   check them (digits, Luhn's sum, parts).  They always stand.
2. High-recall generators propose overlapping spans: every at-sign or word that may
   stand for one with what is around it, and every window of groups of digits.
3. Each kind has boosted trees on features of format (groups, separators, sums, what
   touches the span) and context (words, cue words, digits and marks around it).
   They learn from a bounded sample of documents: from base spans, from disguised
   copies of them in their places (other separators, `[at]`, no plus), from broken
   copies that no check allows, and from candidates that fail.
4. Held-out documents calibrate the margins by isotonic regression; of a kind the
   least probability is taken whose held-out precision is high enough.  Candidates
   at or above it that no base span and no better candidate overlaps are added.

Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lyrebird.staging import free_name, staged, table

KINDS = ("email", "ip", "card", "phone")
#: about so many documents are sampled to learn from, and of a kind about so many candidates
SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 40_000
#: a threshold's precision on held-out candidates, and the true ones among these, at least
PRECISION, LEAST_TRUE = 0.98, 10
#: one document in so many is held out
HELD_OUT_OF = 4
#: candidates that are judged together
JUDGED = 16_384
ROUNDS, DEPTH, RATE, BINS, RIDGE, LEAST_WEIGHT = 40, 4, 0.3, 32, 1.0, 2.0

Span = tuple[str, int, int]  # kind, start, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGITS = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"@|[ ]?[\[({][ ]?at[ ]?[\])}][ ]?| at ", re.IGNORECASE)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[({][ ]?(?:dot|\.)[ ]?[\])}][ ]?| dot )[A-Za-z0-9-]+)*", re.IGNORECASE)
_DOT = re.compile(r"[ ]?[\[({][ ]?(?:dot|\.)[ ]?[\])}][ ]?| dot |\.", re.IGNORECASE)
_GAP = re.compile(r"[ ().\[\]/_-]{1,3}")
_CUES = re.compile(r"\b(?:e-?mail|mail|contact|kontakt|write|reach|phone|telephone|telefon|tel|call|mobile|cell|fax|card|visa|credit|iban|host|server|address|ip)\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DIGITS.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """The spans that the base patterns match, leftmost and without overlap in a kind, and whose checks hold, by start and kind."""
    runs = _runs(text) if runs is None else runs
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    chain, dotted = 0, 0  # where runs began to be joined by a blank or a hyphen, and by a dot
    for k, (start, end) in enumerate(runs):
        joint = text[end] if k + 1 < len(runs) and runs[k + 1][0] == end + 1 else ""
        if joint not in (" ", "-"):
            digits = "".join(text[a:b] for a, b in runs[chain : k + 1])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", runs[chain][0], end))
            chain = k + 1
        if k - dotted == 3:
            if all(b - a < 4 or not text[a : b - 3].strip("0") for a, b in runs[dotted : k + 1]) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in runs[dotted : k + 1]):
                out.append(("ip", runs[dotted][0], end))
            dotted = k + 1
        elif joint != ".":
            dotted = k + 1
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 10 <= sum(c in "0123456789" for c in found[0]) <= 15:
            out.append(("phone", at, found.end()))
        at = text.find("+", at + 1)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Covered:
    """Whether a stretch overlaps one of some spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.reach = [], []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            self.starts.append(start)
            self.reach.append(max(end, self.reach[-1] if self.reach else 0))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    parts: tuple[str, ...]  # groups of digits, or local part, sign, domain labels and their dots
    joints: tuple[str, ...]
    more: tuple[bool, bool] = (False, False)  # whether groups follow to the left and right


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> Iterator[Candidate]:
    """Spans that may be personal data, overlapping ones among them."""
    runs = _runs(text) if runs is None else runs
    if "@" in text or "at" in text or "AT" in text or "At" in text or "aT" in text:
        last = 0
        for sign in _AT.finditer(text):
            local = text[last : sign.start()]
            start = last + len(local.rstrip(_LOCAL))
            last = sign.end()
            domain = _LOOSE_DOMAIN.match(text, sign.end())
            if start == sign.start() or not domain:
                continue
            ends, at = [], sign.end()
            for dot in _DOT.finditer(text, sign.end(), domain.end()):
                ends.append(dot.start())
            ends.append(domain.end())
            for n in sorted({1, 2, len(ends)} & set(range(1, len(ends) + 1))):
                whole = text[at : ends[n - 1]]
                yield Candidate("email", start, ends[n - 1], (text[start : sign.start()], *_DOT.split(whole)), (sign[0], *_DOT.findall(whole)), (False, n < len(ends)))
    first = 0
    for k, (_, end) in enumerate(runs):
        if k + 1 == len(runs) or not _GAP.fullmatch(text, end, runs[k + 1][0]):
            yield from _number_windows(text, runs[first : k + 1])
            first = k + 1


def _number_windows(text: str, chain: list[tuple[int, int]]) -> Iterator[Candidate]:
    for i in range(len(chain)):
        total = 0
        for j in range(i, min(i + 8, len(chain))):
            total += chain[j][1] - chain[j][0]
            if total > 19:
                break
            if total < 4 or (total < 7 and j - i != 3):
                continue
            parts = tuple(text[a:b] for a, b in chain[i : j + 1])
            joints = tuple(text[chain[k][1] : chain[k + 1][0]] for k in range(i, j))
            more, (start, end) = (i > 0, j + 1 < len(chain)), (chain[i][0], chain[j][1])
            if j - i == 3 and max(map(len, parts)) <= 3:
                yield Candidate("ip", start, end, parts, joints, more)
            if total >= 14:
                yield Candidate("card", start, end, parts, joints, more)
            if 7 <= total <= 15:
                while start and text[start - 1] in "+(" and chain[i][0] - start < 2:
                    start -= 1
                yield Candidate("phone", start, end, parts, joints, more)


def _look(c: str) -> int:
    """What stands beside a span: nothing, blank, letter, digit, mark."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, c: Candidate) -> list[float]:
    """Numbers on the format and the context of a candidate."""
    body, digits = text[c.start : c.end], "".join(p for p in c.parts if p.isascii() and p.isdigit())
    sizes, joined = [len(p) for p in c.parts], "".join(c.joints)
    before, after = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 40]
    words, follow = before.split(), after.split()
    last, label = (words[-1] if words else ""), c.parts[-1]
    number = c.kind != "email"
    return [
        float(number and luhn(digits)), float(number and all(int(p) <= 255 for p in c.parts)), len(digits), len(c.parts), max(sizes), min(sizes), sizes[0], sizes[-1],
        len(set(joined)), len(set(c.joints)), max(map(len, c.joints), default=0), body.startswith(("+", "(+")), "(" in body, "." in joined, " " in joined, "-" in joined, "[" in joined or "{" in joined, "/" in joined or "_" in joined,
        len(body), c.more[0], c.more[1], _look(before[-1:]), _look(after[:1]), _look(after[1:2]),
        max((digits.count(d) for d in set(digits)), default=0) / max(1, len(digits)), digits.startswith("00"),
        sum(x.isdigit() for x in c.parts[0]), sum(x in "._" for x in c.parts[0]), len(label) if label.isalpha() else 0,
        0 if not c.joints or c.joints[0] == "@" else 1 if "at" in c.joints[0].lower() and c.joints[0].strip().lower() != "at" else 2,
        sum(j == "." for j in c.joints), sum("dot" in j.lower() for j in c.joints),
        len(_CUES.findall(before)), len(last), last[:1].isupper(), len(follow[0]) if follow else 0,
        sum(x.isdigit() for x in before) / 40, sum(x.isdigit() for x in after) / 40, sum(x.isalpha() for x in before) / 40, sum(x in "\"'=:#$" for x in before[-12:]),
    ]


N_FEATURES = len(features("a@b.c", Candidate("email", 0, 5, ("a", "b", "c"), ("@", "."))))


def _disguised(kind: str, body: str, rng: random.Random) -> str:
    """The same data written so that the base patterns do not match it."""
    digits = "".join(x for x in body if x in "0123456789")
    if kind == "email":
        local, domain = body.split("@", 1)
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), ("{at}", "."), (" AT ", " DOT ")])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return body.replace(".", rng.choice(["[.]", " . ", "(.)", "-"]))
    if kind == "card":
        by = rng.choice([".", "/", "_", "  ", " - "])
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    by, lead = rng.choice([".", " ", "-", "/"]), rng.choice(["", "00", "(+"])
    head, rest = digits[: len(digits) - 10] or digits[:2], digits[len(digits) - 10 :] if len(digits) > 10 else digits[2:]
    groups = [head, rest[:3], rest[3:6], rest[6:]] if rng.random() < 0.7 else [rest[:3], rest[3:6], rest[6:]]
    body = by.join(g for g in groups if g)
    return "(+" + body.replace(by, ")" + by, 1) if lead == "(+" else lead + body


def _broken(kind: str, body: str, rng: random.Random) -> str:
    """Something alike that is no such data."""
    digits = "".join(x for x in body if x in "0123456789")
    if kind == "email":
        local, domain = body.split("@", 1)
        return local + rng.choice(["@", " at "]) + domain.split(".")[0] if rng.random() < 0.5 else f"{local} at {domain}"
    if kind == "ip":
        parts = body.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return rng.choice([".", "[.]", "-"]).join(parts)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        by = rng.choice([".", "/", "_", "  ", "", " ", "-"])
        return by.join(wrong[i : i + 4] for i in range(0, len(wrong), 4)) if by else wrong
    return rng.choice([digits[-7:], digits[:8], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:3]}.{digits[3:7]}", digits + digits[:4], f"+{digits[:8]}"])


def _fails(c: Candidate) -> bool:
    """Whether a candidate is certainly none of its kind."""
    digits = "".join(c.parts)
    if c.kind == "email":
        return len(c.parts) < 3 or (c.joints[0].strip().lower() == "at" and "." in c.joints)
    if c.kind == "ip":
        return any(int(p) > 255 for p in c.parts)
    if c.kind == "card":
        return not luhn(digits)
    return len(digits) < 10


def examples(text: str, rng: random.Random) -> Iterator[tuple[Candidate, str, int]]:
    """Candidates of a text to learn from, each with the text it stands in and its label."""
    base = base_spans(text)
    known, taken = set(base), Covered(base)
    for c in candidates(text):
        own = (c.kind, c.start, c.end) in known
        if own or _fails(c) or taken(c.start, c.end):
            yield c, text, int(own)
    for kind, start, end in base:
        before, after = text[max(0, start - 60) : start], text[end : end + 60]
        for make, label in ((_disguised, 1), (_broken, 0)):
            body = make(kind, text[start:end], rng)
            snippet, stop = before + body + after, len(before) + len(body)
            for c in candidates(snippet):
                if c.start < stop and len(before) < c.end:
                    whole = c.kind == kind and (c.start, c.end) == (len(before), stop)
                    yield c, snippet, label * int(whole)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> dict:
    """Trees of full depth fitted to the logistic loss by gradients and histograms of each feature."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, weight = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f, own in enumerate(codes):
                if not len(edges[f]):
                    continue
                at = node * BINS + own
                g = np.bincount(at, grad, n * BINS).reshape(n, BINS).cumsum(axis=1)
                h = np.bincount(at, weight, n * BINS).reshape(n, BINS).cumsum(axis=1)
                left_g, left_h, all_g, all_h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], feature[first + np.flatnonzero(better)], cut[first + np.flatnonzero(better)] = top[better], f, edges[f][k[better]]
            node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, weight, 2**depth)
        leaf = -RATE * g / (h + RIDGE)
        margin += leaf[node]
        trees.append((feature, cut, leaf))
    return {"start": start, "feature": np.stack([t[0] for t in trees]), "cut": np.stack([t[1] for t in trees]), "leaf": np.stack([t[2] for t in trees])}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["start"])
    depth, rows = model["leaf"].shape[1].bit_length() - 1, np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > cut[at])
        out += leaf[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the rising probabilities from each of them on, by pooling adjacent violators."""
    values, inverse = np.unique(margin, return_inverse=True)
    true, count = np.bincount(inverse, y), np.bincount(inverse)
    pools: list[list[float]] = []
    for at, t, n in zip(values.tolist(), true.tolist(), count.tolist(), strict=True):
        pools.append([at, t, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, t, n = pools.pop()
            pools[-1][1] += t
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def calibrated(margin: np.ndarray, y: np.ndarray) -> dict | None:
    """Steps of the probability, and the least one at and above which the held-out precision is high enough; None without."""
    if y.sum() < LEAST_TRUE or y.all():
        return None
    at, probability = isotonic(margin, y)
    own = probability[np.searchsorted(at, margin, side="right") - 1]
    for p in np.unique(own):
        if p >= 0.5 and y[own >= p].mean() >= PRECISION:
            return {"at": at, "probability": probability, "least": float(p)}
    return None


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> kind, key, label and features of the candidates to learn from."""
    for batch in batches:
        kind, of, label, x = [], [], [], []
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for c, where, y in examples(text or "", random.Random(key)):
                kind.append(c.kind)
                of.append(key)
                label.append(y)
                x.append(np.array(features(where, c), np.float32).tobytes())
        yield pa.record_batch({"kind": pa.array(kind, pa.string()), "key": pa.array(of, pa.int64()), "label": pa.array(label, pa.int32()), "x": pa.array(x, pa.binary())})


def _fitted(rows: pa.Table) -> pa.Table:
    """The model of one kind as JSON."""
    order = sorted(zip(rows["key"].to_pylist(), rows["x"].to_pylist(), rows["label"].to_pylist(), strict=True))
    x = np.frombuffer(b"".join(r[1] for r in order), np.float32).reshape(len(order), -1).astype(np.float64)
    y, held = np.array([r[2] for r in order]), np.array([r[0] % HELD_OUT_OF == 0 for r in order])
    model = None
    if 0 < y[~held].sum() < (~held).sum() and held.any():
        trees = boosted(x[~held], y[~held])
        steps = calibrated(margins(trees, x[held]), y[held])
        model = steps and {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in (trees | steps).items()}
    return pa.table({"kind": [rows["kind"][0].as_py()], "model": pa.array([json.dumps(model)], pa.string())})


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> dict[str, dict]:
    """Kind -> trees, calibration and threshold, learned from documents that a hash of id and text picks.

    A kind of which the sample has too few examples, or whose precision no threshold
    makes high enough, has no model and adds no spans; an empty table gives none.
    """
    key = F.xxhash64("doc_id", "text")
    n = docs.count()
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).select(key.alias("key"), "text")
    picked = rows.where(F.pmod("key", F.lit(1 << 30)) < int(min(1.0, sample_docs / max(1, n)) * (1 << 30)))
    found = staged(picked.mapInArrow(_sampled, "kind string, key long, label int, x binary"), "personal-examples")
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # a row a kind
    keep = F.lit(False)
    for kind, count in counts.items():
        share = int(min(1.0, sample_candidates / count) * (1 << 30))
        keep = keep | ((F.col("kind") == kind) & (F.pmod(F.xxhash64("key", "x"), F.lit(1 << 30)) < share))
    models = found.where(keep).groupBy("kind").applyInArrow(_fitted, "kind string, model string").collect()
    read = {r["kind"]: json.loads(r["model"]) for r in models}
    return {kind: {k: np.array(v) if isinstance(v, list) else v for k, v in m.items()} for kind, m in sorted(read.items()) if m}


def _scored(found: list[tuple[int, Candidate, list[float]]], models: dict[str, dict]) -> Iterator[tuple[int, float, Candidate]]:
    """Text, probability and span of the candidates that reach the threshold of their kind."""
    for kind, model in models.items():
        own = [f for f in found if f[1].kind == kind]
        if own:
            margin = margins(model, np.array([f[2] for f in own], np.float32).astype(np.float64))
            at = np.searchsorted(model["at"], margin, side="right") - 1
            sure = np.where(at >= 0, model["probability"][np.maximum(at, 0)], 0.0)
            for k in np.flatnonzero(sure >= model["least"]).tolist():
                yield own[k][0], float(sure[k]), own[k][1]


def spans_of(texts: list[str], models: dict[str, dict]) -> Iterator[tuple[list[Span], list[tuple[Span, float]]]]:
    """Of each text its base spans and the spans added, each with its probability, in order."""
    bases: list[list[Span]] = []
    chosen: dict[int, list[tuple[float, int, int, int, Span]]] = {}
    found: list[tuple[int, Candidate, list[float]]] = []

    def judge() -> None:
        for number, p, c in _scored(found, models):
            chosen.setdefault(number, []).append((-p, c.start - c.end, c.start, KINDS.index(c.kind), (c.kind, c.start, c.end)))
        found.clear()

    for number, text in enumerate(texts):
        runs = _runs(text)
        bases.append(base_spans(text, runs))
        taken = Covered(bases[-1])
        for c in candidates(text, runs) if models else ():
            if c.kind in models and not taken(c.start, c.end):
                found.append((number, c, features(text, c)))
                if len(found) == JUDGED:
                    judge()
    judge()
    for number, base in enumerate(bases):
        added: list[tuple[int, int, str, float]] = []  # by start, without overlap
        for p, _, start, _, (kind, _, end) in sorted(chosen.get(number, [])):
            k = bisect_left(added, (end,))
            if not k or added[k - 1][1] <= start:
                insort(added, (start, end, kind, -p))
        yield base, [((kind, start, end), p) for start, end, kind, p in added]


_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("probability", DoubleType())])


def personal_spans(docs: DataFrame, models: dict[str, dict], text: str = "text", spans: str = "spans", redacted: str | None = "redacted_text") -> DataFrame:
    """docs with the spans of personal data of each text, and the text with [EMAIL] and the like in their place.

    spans is an array of (kind, start, end, probability) by start and kind; base spans
    have probability 1.  Where spans of two kinds overlap, one mark stands for both,
    named after the first.  A null text has no spans and a null redacted text; an
    empty one has no spans.  Each row is judged by itself, so repeated rows have equal
    results.  Columns of the names asked for are replaced (whatever their case).
    """
    new = {c.lower() for c in (spans, redacted) if c}
    rest = [f for f in docs.schema.fields if f.name.lower() not in new]
    body, shared = free_name("_text", docs.columns), docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch[body].to_pylist()
            found, marked = [], []
            for t, (base, added) in zip(given, spans_of([t or "" for t in given], shared.value), strict=True):
                every = sorted([(s, 1.0) for s in base] + added, key=lambda a: (a[0][1], KINDS.index(a[0][0])))
                found.append([{"kind": k, "start": a, "end": b, "probability": p} for (k, a, b), p in every])
                out, at = [], 0
                for (kind, a, b), _ in every if t else ():
                    if a >= at:
                        out += [t[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                marked.append(None if t is None else "".join(out) + t[at:])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            columns = {f.name: batch[f.name] for f in rest} | {spans: pa.array(found, kinds)}
            yield pa.record_batch(columns | ({redacted: pa.array(marked, pa.string())} if redacted else {}))

    fields = [*rest, StructField(spans, ArrayType(_SPAN))] + ([StructField(redacted, StringType())] if redacted else [])
    return docs.withColumn(body, docs[text].cast("string")).mapInArrow(run, StructType(fields))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def span_digests(docs: DataFrame, models: dict[str, dict]) -> DataFrame:
    """doc_id, how many base spans of each kind a text has, their digest, and all spans.

    A null text is an empty one; both have the digest of nothing and no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, written = [], []
            for base, added in spans_of([t or "" for t in batch["text"].to_pylist()], shared.value):
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(sorted([*base, *[s for s, _ in added]], key=lambda s: (s[1], KINDS.index(s[0])))))
            columns = {f"n_{kind}": pa.array(n, pa.int64()) for kind, n in counts.items()}
            yield pa.record_batch({"doc_id": batch["doc_id"], **columns, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(written, pa.string())})

    schema = "doc_id long, " + "".join(f"n_{kind} long, " for kind in KINDS) + "base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_digests(docs, train(docs))
