"""Quality classifier: naive Bayes scaled features and a linear support vector machine.

A text's features say which byte pairs, byte triples and kinds of repeated word
pairs it has.  Each is scaled by the log ratio of its counts in the two classes,
counted over all labelled rows that may be learnt from.  The hinge-loss model on
them is fitted by dual coordinate descent on a sample of bounded size, and a
logistic curve on its margins gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from lyrebird.llm.words import PLAIN, Block, gram_ids, word_blocks
from lyrebird.staging import staged, table

#: features: byte pairs, hashed byte triples, and ten bands each of two repeat shares
PAIRS, TRIPLES, BANDS = 1 << 16, 1 << 17, 20
FEATURES = PAIRS + TRIPLES + BANDS
#: most labelled rows, about, that the linear model is fitted on
SAMPLE_ROWS = 8000
#: labels up to this many are sent to every task; more are joined by a shuffle
BROADCAST_LABELS = 1_000_000
PASSES, COST, SMOOTHING = 12, 1.0, 1.0


def feature_sets(block: Block) -> list[np.ndarray]:
    """The features of each row, in order."""
    raw = block.raw.astype(np.uint32)
    pairs = (raw[:-1] << 8) | raw[1:]
    triples = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    triples = PAIRS + ((triples * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64)
    grams = gram_ids(block.ids, 2)
    same = block.ids[:-1] == block.ids[1:]
    out = []
    for row in range(block.rows):
        a, b = block.offsets[row], block.offsets[row + 1]
        parts = [pairs[a : max(a, b - 1)].astype(np.int64), triples[a : max(a, b - 2)]]
        w, e = block.bounds[row], max(block.bounds[row], block.bounds[row + 1] - 1)
        if e > w:
            own = np.sort(grams[w:e])
            distinct = 1 + np.count_nonzero(own[1:] != own[:-1])
            shares = 1 - distinct / (e - w), np.count_nonzero(same[w:e]) / (e - w)
            parts.append(PAIRS + TRIPLES + np.array([10 * k + min(9, int(20 * s)) for k, s in enumerate(shares)], np.int64))
        found = np.concatenate(parts)
        found.sort()
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, FEATURES), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        label = batch["label"].to_numpy(zero_copy_only=False)
        for block in word_blocks(batch["text"], PLAIN):
            for row, found in enumerate(feature_sets(block)):
                y = int(label[block.first_row + row] == 1)
                counts[y, found] += 1
                rows[y] += 1
    held = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch({"feature": pa.array(np.append(held, -1)), "neg": pa.array(np.append(counts[0, held], rows[0])), "pos": pa.array(np.append(counts[1, held], rows[1]))})


def fit(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, passes: int = PASSES, cost: float = COST) -> tuple[np.ndarray, float, float, float]:
    """Weights on the scaled features, bias, and slope and intercept of the logistic curve.

    Dual coordinate descent on the hinge loss; rows of the rarer class cost more.
    The bias is a feature that every row has.
    """
    order = np.random.default_rng(5)
    y = np.where(labels == 1, 1.0, -1.0)
    x = [ratio[f] for f in features]
    norm = np.array([1.0 / np.sqrt(max(1e-12, v @ v)) for v in x])
    limit = np.where(y > 0, 1.0, max(1.0, np.sqrt((y > 0).sum() / max(1, (y < 0).sum())))) * cost
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    for _ in range(passes):
        for i in order.permutation(len(y)):
            f = features[i]
            slope = y[i] * (norm[i] * (w[f] @ x[i]) + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), limit[i])  # rows have length 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * norm[i] * x[i]
                bias += step
                alpha[i] = new
    margins = np.array([n * (w[f] @ v) for f, v, n in zip(features, x, norm, strict=True)]) + bias
    return w, bias, *_logistic(margins, labels == 1)


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with targets drawn in from 0 and 1."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        m = np.array([[h @ (margins * margins) + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(m, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _train(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            label, key = batch["label"].to_pylist(), batch["key"].to_pylist()
            for block in word_blocks(batch["text"], PLAIN):
                for row, found in enumerate(feature_sets(block)):
                    rows.append((key[block.first_row + row], label[block.first_row + row], found.astype(np.int32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2][:50].tobytes()))
        labels = np.array([r[1] for r in rows])
        if len(set(labels.tolist())) < 2:
            return
        w, bias, a, b = fit([r[2] for r in rows], labels, ratio)
        yield pa.record_batch({"weights": pa.array([(w * ratio).tobytes()], pa.binary()), "bias": [bias], "a": [a], "b": [b]})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from the texts of docs and the labels 0 and 1 of doc_id in labels.

    Only rows that learnable() allows are used; labels that are null or neither 0
    nor 1, and ids without a document, are passed over; repeated labels all
    count.  Feature counts are of all such rows.  The linear model is fitted on
    those of them whose id's hash falls under sample_rows / rows.  Without rows
    of both classes the model gives every text the smoothed share of label 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & learnable(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    known = F.broadcast(known) if n <= BROADCAST_LABELS else known
    rows = docs.where(learnable(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id")
    counted = rows.select("text", "label").mapInArrow(_count, "feature long, neg long, pos long")
    counts = counted.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()  # FEATURES rows at most
    totals = counts[counts.feature == -1][["neg", "pos"]].sum()
    held = counts[counts.feature >= 0]
    neg, pos = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    neg[held.feature], pos[held.feature] = held.neg + SMOOTHING, held.pos + SMOOTHING
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    seen = max(1, int(totals.sum()))
    small = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / seen) * (1 << 30))
    sample = rows.where(small).select(F.xxhash64("doc_id").alias("key"), "text", "label").repartition(1)
    fitted = sample.mapInArrow(_train(ratio), "weights binary, bias double, a double, b double").collect() if totals.min() > 0 else []
    if fitted:
        return {"ratio": ratio, "weights": np.frombuffer(fitted[0]["weights"]), **{k: fitted[0][k] for k in ("bias", "a", "b")}}
    share = (totals["pos"] + 1) / (totals.sum() + 2)
    return {"ratio": ratio, "weights": np.zeros(FEATURES), "bias": 0.0, "a": 1.0, "b": float(np.log(share / (1 - share)))}


def score_quality(docs: DataFrame, model: dict, score: str = "score", text: str = "text") -> DataFrame:
    """docs with a column score from 0 to 1: how likely label 1 is; one for empty and null texts too.

    A column of docs that has the name of the score is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != score.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        square = m["ratio"] ** 2
        for batch in batches:
            for block in word_blocks(batch[text], PLAIN):
                margin = [(m["weights"][f].sum() / np.sqrt(max(1e-12, square[f].sum())) if len(f) else 0.0) for f in feature_sets(block)]
                value = 1 / (1 + np.exp(-np.clip(m["a"] * (np.array(margin) + m["bias"]) + m["b"], -30, 30)))
                part = batch.slice(block.first_row, block.rows)
                yield pa.record_batch([*part.columns, pa.array(value)], [*part.schema.names, score])

    return docs.mapInArrow(run, types.StructType([*docs.schema.fields, types.StructField(score, types.DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
