"""Loudness, envelope, vibrato and dynamic range of sampled signals.

Signals come as rows (clip_id, channel, idx, v), idx from 0 without gaps, or as
rows of sample arrays.  Long clips are never one task: sums are grouped before
they are shuffled, sliding windows work on pieces of a clip with the margins they
need, and the gain recurrence is put together from the pieces' linear maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lyrebird.functions.arrow import joined_batches
from lyrebird.functions.units import RATE, db_to_linear
from lyrebird.staging import staged

TINY = 1e-10
#: samples of a piece of a clip
PIECE = 1 << 16


@dataclass(frozen=True)
class SignalConfig:
    normalize: bool = True
    target_dbfs: float = -20.0
    suppress_vibrato: bool = True
    vibrato_threshold_hz: float = 5.0
    vibrato_smooth_window_ms: float = 50.0
    compress: bool = False
    comp_threshold_dbfs: float = -18.0
    comp_ratio: float = 4.0
    comp_attack_ms: float = 10.0
    comp_release_ms: float = 100.0


def window_samples(ms: float, rate: int) -> int:
    return max(1, int(rate * ms / 1000))


def normalize_loudness(samples: DataFrame, target_dbfs: float = -20.0, clip: str = "clip_id", value: str = "v") -> DataFrame:
    """One gain a clip, over all its channels, to the target root mean square; silence stays as it is."""
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    gains = samples.groupBy(clip).agg(rms.alias("_rms")).withColumn(
        "_gain", F.when(F.col("_rms") < TINY, F.lit(1.0)).otherwise(db_to_linear(F.lit(float(target_dbfs)) - 20 * F.log10(F.greatest("_rms", F.lit(TINY)))))
    )
    return samples.join(gains, clip).withColumn(value, F.col(value) * F.col("_gain")).drop("_rms", "_gain")


def linked_peak(samples: DataFrame, clip: str = "clip_id", value: str = "v") -> DataFrame:
    """clip, idx, peak: the largest magnitude over the channels."""
    return samples.groupBy(clip, "idx").agg(F.max(F.abs(value)).alias("peak"))


def first_channel(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("channel") == 0)


def sliding_rms(samples: DataFrame, window: int, keys: tuple[str, ...] = ("clip_id", "channel"), value: str = "v", out: str = "rms", piece: int = PIECE) -> DataFrame:
    """samples with the root mean square of the window around each, the first and last sample repeated beyond the ends.

    A window has window // 2 samples before its own and the rest after it.  Each
    piece of a clip is a group of its own, with the samples around it that its
    windows reach; running sums start anew in each.
    """
    left, right = window // 2, window - window // 2 - 1
    size = max(piece, 2 * window)
    square = F.col(value).cast("double") * F.col(value)
    ends = samples.groupBy(*keys).agg(
        (F.max("idx") + 1).alias("_n"), F.min_by(square, "idx").alias("_first"), F.max_by(square, "idx").alias("_last")
    )
    home = F.expr(f"idx div {size}")
    reach = F.array_distinct(F.array(F.greatest(F.expr(f"(idx - {right}) div {size}"), F.lit(0).cast("long")), home, F.expr(f"(idx + {left}) div {size}")))
    rows = samples.withColumn("_square", square).withColumn("_home", home).withColumn("_piece", F.explode(reach))
    order = Window.partitionBy(*keys, "_piece").orderBy("idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("_square").over(upto))
    high = F.coalesce(F.lead("_sum", right).over(order), F.last("_sum").over(whole)) if right else F.col("_sum")
    low = F.coalesce(F.lag("_sum", left + 1).over(order), F.lit(0.0))
    rows = rows.withColumn("_inside", high - low).where("_piece = _home").join(ends, list(keys))
    before = F.greatest(F.lit(left) - F.col("idx"), F.lit(0)) * F.col("_first")
    after = F.greatest(F.lit(right) - (F.col("_n") - 1 - F.col("idx")), F.lit(0)) * F.col("_last")
    mean = F.greatest(F.col("_inside") + before + after, F.lit(0.0)) / window
    extra = ["_square", "_home", "_piece", "_sum", "_inside", "_n", "_first", "_last"]
    return rows.withColumn(out, F.sqrt(mean)).drop(*extra)


def vibrato_window(threshold_hz: float, smooth_ms: float, rate: int) -> int:
    """Twice the period of the threshold, or the smoothing window if that is longer."""
    period = 1000.0 / threshold_hz if threshold_hz > 0 else 200.0
    return window_samples(max(smooth_ms, 2 * period), rate)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups of equal keys, and where the groups start and the last one ends."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            code = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table), table.num_rows)


def _segment_rms(x: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Root mean square of the window around each value, of values in segments; low and high are the bounds of each one's segment.

    Beyond a segment its first and last value are repeated.
    """
    left, right = window // 2, window - window // 2 - 1
    square, at = x * x, np.arange(len(x))
    sums = np.concatenate([[0.0], np.cumsum(square)])
    inside = sums[np.minimum(at + right + 1, high)] - sums[np.maximum(at - left, low)]
    before, after = np.maximum(low - (at - left), 0), np.maximum(at + right + 1 - high, 0)
    return np.sqrt(np.maximum(inside + before * square[low] + after * square[high - 1], 0.0) / window)


def suppress_vibrato(
    samples: DataFrame, window: int, keys: tuple[str, ...] = ("clip_id", "channel"), value: str = "v", piece: int = PIECE
) -> DataFrame:
    """Each sample over its envelope, times the smoothed envelope; both with the same window.

    A piece of a clip gets the samples around it that two windows reach, so that one
    shuffle does for both.  Indices of a clip's channel that repeat or have gaps are
    an error.
    """
    left, right = window // 2, window - window // 2 - 1
    size = max(piece, 4 * window)
    fields = [f for f in samples.schema.fields if f.name != value] + [StructField(value, DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [*keys, "_piece"]):
            idx, x = table["idx"].to_numpy().astype(np.int64), table[value].to_numpy().astype(np.float64)
            length = np.diff(bounds)
            low, high = np.repeat(bounds[:-1], length), np.repeat(bounds[1:], length)
            if (np.diff(idx)[low[1:] == low[:-1]] != 1).any():
                raise ValueError("indices of a channel repeat or have gaps")
            # beyond a margin's own edge values are of no piece, so only ends of clips count
            envelope = _segment_rms(x, low, high, window)
            smooth = _segment_rms(envelope, low, high, window)
            home = table["_piece"].to_numpy() == idx // size
            out = x / (envelope + TINY) * smooth
            own = table.filter(pa.array(home))
            yield from pa.table([own[f.name] if f.name != value else pa.array(out[home]) for f in fields], [f.name for f in fields]).to_batches()

    first = F.greatest(F.expr(f"(idx - {2 * right}) div {size}"), F.lit(0).cast("long"))
    reach = F.array_distinct(F.array(first, F.expr(f"idx div {size}"), F.expr(f"(idx + {2 * left}) div {size}")))
    rows = samples.withColumn("_piece", F.explode(reach))
    return rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "idx").mapInArrow(run, StructType(fields))


@dataclass(frozen=True)
class Compressor:
    """Hard knee; the gain moves fast while the envelope rises and slowly otherwise."""

    threshold_dbfs: float = -18.0
    ratio: float = 4.0
    attack_ms: float = 10.0
    release_ms: float = 100.0
    rate: int = RATE

    @property
    def threshold(self) -> float:
        return 10 ** (self.threshold_dbfs / 20)

    def speed(self, ms: float) -> float:
        return 1 - float(np.exp(-1 / window_samples(ms, self.rate)))

    def wanted(self, envelope: np.ndarray) -> np.ndarray:
        over = self.threshold + (envelope - self.threshold) / self.ratio
        return np.where(envelope > self.threshold, over, envelope) / (envelope + TINY)


def compressed(samples: Column, c: Compressor) -> Column:
    """A short array of samples with its gain applied; one array expression, for arrays of some thousands."""
    if c.ratio <= 1:
        return samples
    attack, release, t = F.lit(c.speed(c.attack_ms)), F.lit(c.speed(c.release_ms)), F.lit(c.threshold)

    def step(state: Column, x: Column) -> Column:
        x = x.cast("double")
        e = F.abs(x)
        wanted = F.when(e > t, t + (e - t) / c.ratio).otherwise(e) / (e + TINY)
        rising = F.coalesce(e > state["e"], F.lit(False))
        gain = F.when(state["e"].isNull(), F.lit(1.0)).otherwise(state["g"] + F.when(rising, attack).otherwise(release) * (wanted - state["g"]))
        return F.struct(gain.alias("g"), e.alias("e"), F.concat(state["out"], F.array(x * gain)).alias("out"))

    start = F.struct(F.lit(1.0).alias("g"), F.lit(None).cast("double").alias("e"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(samples, start, step, lambda s: s["out"])


def gain_steps(envelope: np.ndarray, before: float, c: Compressor) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample the two numbers of its map g -> (1 - k) g + k t; before is the envelope in front of the first."""
    rising = np.diff(envelope, prepend=before) > 0
    k = np.where(rising, c.speed(c.attack_ms), c.speed(c.release_ms))
    return k, k * c.wanted(envelope)


#: samples whose maps are put together at once; the product of their factors stays above 1e-120
_TOGETHER = 256


def run_gains(k: np.ndarray, kt: np.ndarray, gain: float) -> np.ndarray:
    """The gain at each sample, from the one before the first: g -> (1 - k) g + k t, in blocks of samples side by side."""
    n = len(k)
    rows = -(-n // _TOGETHER)
    keep, add = (np.pad(x, (0, rows * _TOGETHER - n)).reshape(rows, _TOGETHER) for x in (k, kt))
    factor = np.cumprod(1 - keep, axis=1)
    sums = np.cumsum(add / factor, axis=1)
    before = np.empty(rows)
    for row, (f, t) in enumerate(zip(factor[:, -1].tolist(), sums[:, -1].tolist(), strict=True)):
        before[row] = gain
        gain = f * (gain + t)
    return (factor * (before[:, None] + sums)).ravel()[:n]


def _with_gains(pieces: DataFrame, c: Compressor, envelope: Callable[[pa.RecordBatch, int], np.ndarray]) -> DataFrame:
    """pieces with the gain and the envelope in front of each; pieces of a clip are in order of their numbers.

    Every piece sends six numbers: its first and last envelope and the linear map of
    its other samples.  A clip's pieces, one row each, are run through in order.
    The first sample of a clip has gain 1, and null in front of it.
    """

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                e = envelope(batch, row)
                k, kt = gain_steps(e[1:], e[0], c) if len(e) else (e, e)
                found.append((e[0] if len(e) else None, e[-1] if len(e) else None, float(np.prod(1 - k)), float(run_gains(k, kt, 0.0)[-1]) if len(k) else 0.0))
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(4)]
            yield pa.record_batch([batch["clip_id"], batch["piece"], *columns], ["clip_id", "piece", "first", "last", "a", "b"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attack, release = c.speed(c.attack_ms), c.speed(c.release_ms)
        for batch in batches:
            for clip, own in zip(batch["clip_id"], batch["maps"], strict=True):
                piece, *rest = (own.values.field(i) for i in range(5))
                gain, before, fronts = 1.0, None, []
                for first, last, a, b in zip(*(x.to_pylist() for x in rest), strict=True):
                    fronts.append((gain, before))
                    if first is None:
                        continue
                    if before is not None:
                        gain += (attack if first > before else release) * (float(c.wanted(np.array([first]))[0]) - gain)
                    gain, before = a * gain + b, last
                columns = [pa.array([f[i] for f in fronts], pa.float64()) for i in (0, 1)]
                yield pa.record_batch([pa.repeat(clip, len(fronts)), piece, *columns], ["clip_id", "piece", "_gain", "_before"])

    kind = pieces.schema["clip_id"].dataType.simpleString()
    maps = pieces.mapInArrow(numbers, f"clip_id {kind}, piece long, first double, last double, a double, b double")
    ordered = maps.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("piece", "first", "last", "a", "b"))).alias("maps"))
    return pieces.join(ordered.mapInArrow(lambda batches: joined_batches(chain(batches)), f"clip_id {kind}, piece long, _gain double, _before double"), ["clip_id", "piece"])


def _gains(envelope: np.ndarray, gain: float, before: float | None, c: Compressor) -> np.ndarray:
    k, kt = gain_steps(envelope, envelope[0] if before is None and len(envelope) else before or 0.0, c)
    if before is None and len(k):
        k[0] = kt[0] = 0.0  # the first sample of a clip keeps the gain
    return run_gains(k, kt, gain)


def compress_pieces(pieces: DataFrame, c: Compressor) -> DataFrame:
    """clip_id, piece, samples of one channel -> the same with gains applied."""
    if c.ratio <= 1:
        return pieces
    values = lambda batch, row: batch["samples"][row].values.to_numpy(zero_copy_only=False).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fronts = zip(batch["_gain"].to_pylist(), batch["_before"].to_pylist(), strict=True)
            out = [(x := values(batch, row)) * _gains(np.abs(x), gain, before, c) for row, (gain, before) in enumerate(fronts)]
            yield pa.record_batch([batch["clip_id"], batch["piece"], pa.array(out, pa.list_(pa.float64()))], ["clip_id", "piece", "samples"])

    kind = pieces.schema["clip_id"].dataType.simpleString()
    rows = staged(pieces.select("clip_id", F.col("piece").cast("long").alias("piece"), F.col("samples").cast("array<double>").alias("samples")), "pieces")
    return _with_gains(rows, c, lambda batch, row: np.abs(values(batch, row))).mapInArrow(run, f"clip_id {kind}, piece long, samples array<double>")


def compress_linked(samples: DataFrame, c: Compressor, piece: int = PIECE) -> DataFrame:
    """Rows (clip_id, channel, idx, v) with one gain for all channels, by the largest magnitude over them.

    Rows are dealt to pieces once, which are written, and each piece is worked on
    twice.  Channels may have samples that others lack.
    """
    if c.ratio <= 1:
        return samples
    lists = [("channel", samples.schema["channel"].dataType), ("idx", LongType()), ("v", DoubleType())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["clip_id", "piece"]):
            heads = table.take(pa.array(bounds[:-1]))
            offsets = pa.array(bounds.astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, table[name].combine_chunks()) for name, _ in lists]
            yield pa.record_batch([heads["clip_id"].combine_chunks(), heads["piece"].combine_chunks(), *columns], ["clip_id", "piece", "channel", "idx", "v"])

    def envelope(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        idx, x = (batch[name][row].values.to_numpy(zero_copy_only=False) for name in ("idx", "v"))
        heads = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1]]))
        return np.maximum.reduceat(np.abs(x), heads), np.diff(np.append(heads, len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (gain, before) in enumerate(zip(batch["_gain"].to_pylist(), batch["_before"].to_pylist(), strict=True)):
                peaks, repeats = envelope(batch, row)
                gains = np.repeat(_gains(peaks, gain, before, c), repeats)
                channel, idx, x = (batch[name][row].values for name, _ in lists)
                clip = pa.repeat(batch["clip_id"][row], len(idx))
                yield pa.record_batch([clip, channel, idx, pa.array(x.to_numpy(zero_copy_only=False) * gains)], ["clip_id", "channel", "idx", "v"])

    kind = samples.schema["clip_id"].dataType
    rows = samples.select("clip_id", F.expr(f"idx div {piece}").cast("long").alias("piece"), "channel", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    sort = rows.repartition("clip_id", "piece").sortWithinPartitions("clip_id", "piece", "idx", "channel")
    pieces = StructType([StructField("clip_id", kind), StructField("piece", LongType()), *[StructField(name, ArrayType(t)) for name, t in lists]])
    made = _with_gains(staged(sort.mapInArrow(build, pieces), "pieces"), c, lambda batch, row: envelope(batch, row)[0])
    return made.mapInArrow(lambda batches: joined_batches(run(batches)), StructType([StructField("clip_id", kind), *[StructField(name, t) for name, t in lists]]))


def to_pieces(samples: DataFrame, clip: str = "clip_id", value: str = "v", piece: int = PIECE) -> DataFrame:
    """Rows (clip_id, idx, v) as (clip_id, piece, samples)."""
    rows = samples.withColumn("piece", F.expr(f"idx div {piece}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))), lambda r: r["v"])
    return rows.groupBy(F.col(clip).alias("clip_id"), "piece").agg(ordered.alias("samples"))


def from_pieces(pieces: DataFrame, clip: str = "clip_id", value: str = "v", piece: int = PIECE) -> DataFrame:
    rows = pieces.select(F.col("clip_id").alias(clip), "piece", F.posexplode("samples").alias("_at", value))
    return rows.select(clip, (F.col("piece") * piece + F.col("_at")).alias("idx"), value)


def preprocess(samples: DataFrame, config: SignalConfig, rate: int = RATE, tap=None, piece: int = PIECE) -> DataFrame:
    """Loudness, vibrato, dynamic range, each if the config has it; rows (clip_id, channel, idx, v).

    Loudness is of a clip's channels together, vibrato of each channel, and the
    compressor has one gain for all.  Without a column channel a clip is one channel,
    and the rows that come out have none either.  An index that a channel has twice,
    or a gap, is an error where vibrato is suppressed.
    """
    tap = tap or (lambda df, name: df)
    channels = ["channel"] if "channel" in samples.columns else []
    out = samples.select("clip_id", *channels, F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    if config.normalize:
        out = tap(normalize_loudness(out, config.target_dbfs), "02_normalized")
    if config.suppress_vibrato:
        window = vibrato_window(config.vibrato_threshold_hz, config.vibrato_smooth_window_ms, rate)
        out = tap(suppress_vibrato(out, window, ("clip_id", *channels), piece=piece), "03_vibrato_suppressed")
    if config.compress:
        c = Compressor(config.comp_threshold_dbfs, config.comp_ratio, config.comp_attack_ms, config.comp_release_ms, rate)
        linked = compress_linked(out if channels else out.withColumn("channel", F.lit(0)), c, piece)
        out = tap(linked.select("clip_id", *channels, "idx", "v"), "04_compressed")
    return out
