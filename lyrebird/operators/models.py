"""Models that separate stems and align words: their interfaces, stand-ins and how Spark calls them.

The stand-ins are test doubles; they are deterministic and recognise nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.arrow import keyed_batches
from lyrebird.functions.columns import once
from lyrebird.operators.signal import whole_groups
from lyrebird.schema import ALIGNED_WORD
from lyrebird.sources.audio import planar

VOCAL_STEM = "vocals"
#: bytes of text whose words are made at once; a clip counts as _CLIP_BYTES besides its text
TEXT_BYTES, _CLIP_BYTES = 1 << 18, 256


class StemSeparator(Protocol):
    sample_rate: int

    def separate(self, audio: np.ndarray) -> dict[str, np.ndarray]:
        """(channels, samples) -> stem name -> (channels, samples)."""


class Aligner(Protocol):
    def align(self, audio: np.ndarray, text: str, sample_rate: int) -> list[tuple[str, int | None, int | None]]:
        """Words with start and end in milliseconds from the start of the clip; null times where not found."""


class BatchAligner(Protocol):
    def align_batch(self, audios: list[np.ndarray], texts: list[str], languages: list[str | None], sample_rate: int) -> list[list[tuple[str, float | None, float | None]]]:
        """Of each clip its words with start and end in seconds from its start; null times where not found."""


class WholeMixAsVocals:
    """Stand-in separator: the mix is the vocals, and there is nothing else."""

    sample_rate = 44100

    def separate(self, audio: np.ndarray) -> dict[str, np.ndarray]:
        return {VOCAL_STEM: audio, "other": np.zeros_like(audio)}


class EvenAligner:
    """Stand-in aligner: words between spaces, spread evenly over the clip."""

    def align(self, audio: np.ndarray, text: str, sample_rate: int) -> list[tuple[str, int | None, int | None]]:
        words, ms = [w for w in text.split(" ") if w], len(audio) * 1000 // sample_rate
        return [(w, i * ms // len(words), (i + 1) * ms // len(words)) for i, w in enumerate(words)]

    def align_batch(self, audios: list[np.ndarray], texts: list[str], languages: list[str | None], sample_rate: int) -> list[list[tuple[str, float | None, float | None]]]:
        # half a millisecond on, so that cutting to milliseconds gives the same whatever the rounding
        words = [self.align(a, t, sample_rate) for a, t in zip(audios, texts, strict=True)]
        return [[(w, (a + 0.5) / 1000, (b + 0.5) / 1000) for w, a, b in own] for own in words]


def even_words(text: Column, ms: Column) -> Column:
    """EvenAligner as an expression, of a clip of ms milliseconds."""
    at = lambda i, n: F.floor(i * ms / n).cast("long")
    timed = lambda words, n: F.transform(words, lambda w, i: F.struct(w.alias("word"), at(i, n).alias("start_ms"), at(i + 1, n).alias("end_ms")))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return once(words, lambda found: once(F.size(found), lambda n: timed(found, n))).cast(f"array<{ALIGNED_WORD}>")


def separated(audio: DataFrame, make: Callable[[], StemSeparator], stem: str = VOCAL_STEM) -> DataFrame:
    """clip_id, sample_rate, channels (an array of sample arrays) -> the same of one stem; a model is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                stems = model.separate(planar(row["channels"][0]).astype(np.float32))
                if stem not in stems:
                    raise ValueError(f"the separator gives no stem {stem}")
                samples = np.asarray(stems[stem], np.float32)
                channels = pa.ListArray.from_arrays(np.arange(len(samples) + 1, dtype=np.int32) * samples.shape[1], samples.ravel())
                yield pa.record_batch([row["clip_id"], row["sample_rate"], pa.ListArray.from_arrays(np.array([0, len(samples)], np.int32), channels)], batch.schema.names)

    return audio.select("clip_id", "sample_rate", "channels").mapInArrow(run, "clip_id string, sample_rate int, channels array<array<float>>")


def chunk_weights(at: np.ndarray, chunk: int) -> np.ndarray:
    """A triangle over the places of a chunk, above zero at both ends."""
    return np.minimum(at + 1, chunk - at) / (chunk // 2 + 1)


def separated_rows(samples: DataFrame, make: Callable[[], StemSeparator], chunk: int, overlap: int, stem: str = VOCAL_STEM) -> DataFrame:
    """Rows (clip_id, channel, idx, v) of one stem of a mix, a chunk of samples at a time.

    Chunks of a clip overlap; each is one call of the model, and where several cover
    a sample their values are averaged by triangular weights.  A chunk, with all its
    channels, is the most that a task holds.  Channels of a clip have the same
    samples, idx from 0 without gaps; anything else is an error, and so is a stem of
    another shape.  The stem may have other channels than the mix.
    """
    hop = chunk - overlap
    if chunk < 1 or not 0 <= overlap <= chunk // 2:
        raise ValueError("chunks overlap by half of their length at most")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[np.ndarray]]]:
        model = make()
        for table, bounds in whole_groups(batches, ["clip_id", "chunk"]):
            columns = [table[c].to_numpy() for c in ("channel", "idx", "v")]
            clips, chunks = (table[c].take(pa.array(bounds[:-1])).to_pylist() for c in ("clip_id", "chunk"))
            for a, b, clip, number in zip(bounds[:-1].tolist(), bounds[1:].tolist(), clips, chunks, strict=True):
                channel, idx, value = (x[a:b] for x in columns)
                n = int(np.count_nonzero(channel == channel[0]))
                if len(idx) % n or (np.diff(idx.reshape(-1, n), axis=1) != 1).any() or (idx.reshape(-1, n) != idx[:n]).any():
                    raise ValueError("channels of a clip differ in their samples")
                found = model.separate(value.reshape(-1, n).astype(np.float32))
                if stem not in found:
                    raise ValueError(f"the separator gives no stem {stem}")
                out = np.asarray(found[stem], np.float64)
                if out.ndim != 2 or out.shape[1] != n:
                    raise ValueError("a stem has as many samples as its mix")
                weight = np.tile(chunk_weights(idx[:n] - number * hop, chunk), len(out))
                yield clip, [np.repeat(np.arange(len(out), dtype=np.int32), n), np.tile(idx[:n], len(out)), out.ravel() * weight, weight]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keyed_batches(stems(batches), ["clip_id", "channel", "idx", "v", "weight"])

    first = F.greatest(F.floor((F.col("idx") - chunk) / hop) + 1, F.lit(0))
    rows = samples.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("channel").cast("int").alias("channel"), F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("idx") / hop))))
    dealt = rows.repartition("clip_id", "chunk").sortWithinPartitions("clip_id", "chunk", "channel", "idx")
    parts = dealt.mapInArrow(run, "clip_id string, channel int, idx long, v double, weight double")
    return parts.groupBy("clip_id", "channel", "idx").agg((F.sum("v") / F.sum("weight")).cast("float").alias("v"))


def batches_of(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of lengths, in rising order, whose number times the longest is most at most; a longer one is alone."""
    begin = 0
    for end in range(1, len(lengths) + 1):
        if end == len(lengths) or (end + 1 - begin) * lengths[end] > most:
            yield begin, end
            begin = end


def portions(batch: pa.RecordBatch, most: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Runs of a batch's rows whose text has most bytes at most, each with its bytes; a longer row is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + _CLIP_BYTES)
    begin = before = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin), int(ends[end - 1]) - before
        begin, before = end, int(ends[end - 1])


def word_lists(found: list[list[tuple[str, int | None, int | None]]]) -> pa.ListArray:
    """Lists of words with their times, as Arrow."""
    offsets = np.concatenate([[0], np.cumsum([len(one) for one in found], dtype=np.int64)]).astype(np.int32)
    columns = [pa.array([w[i] for one in found for w in one], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["word", "start_ms", "end_ms"]))


def aligned_batches(clips: DataFrame, make: Callable[[], BatchAligner], batch_samples: int, rate: int, held_samples: int | None = None) -> DataFrame:
    """key, samples, text, language -> key, words: the model gets clips of like length together.

    A batch padded to its longest clip has batch_samples at most, but for a single
    longer clip.  Clips are in order of length within a task, so no row is sent
    elsewhere, and a task holds the clips of held_samples (by default four batches)
    or of TEXT_BYTES of text, and one input batch at a time.  Times are rounded to four decimals, then cut to
    milliseconds; words of null times have none.
    """
    kind = clips.schema["key"].dataType.simpleString()
    most_held = held_samples or 4 * batch_samples
    ms = lambda t: None if t is None else int(round(t, 4) * 1e3)

    def judged(model: BatchAligner, table: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = table["n"].to_pylist()
        for a, b in batches_of(lengths, batch_samples):
            own = table.slice(a, b - a)
            audios = [x.values.to_numpy(zero_copy_only=False) for x in own["samples"]]
            found = model.align_batch(audios, own["text"].to_pylist(), own["language"].to_pylist(), rate)
            if len(found) != b - a:
                raise ValueError("the aligner gives a list of words for each clip")
            words = word_lists([[(w, ms(s), ms(e)) for w, s, e in one] for one in found])
            yield pa.record_batch([own["key"].combine_chunks(), words], ["key", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, total, text = make(), [], 0, 0
        for part, size in (x for batch in batches for x in portions(batch)):
            held.append(part)
            total += pc.sum(part["n"]).as_py() or 0
            text += size
            if total >= most_held or text >= TEXT_BYTES:
                yield from judged(model, pa.Table.from_batches(held))
                held, total, text = [], 0, 0
        if held:
            yield from judged(model, pa.Table.from_batches(held))

    rows = clips.select("key", F.coalesce("samples", F.array().cast("array<float>")).alias("samples"), "text", "language").withColumn("n", F.size("samples"))
    return rows.sortWithinPartitions("n").mapInArrow(run, f"key {kind}, words array<{ALIGNED_WORD}>")


def aligned(clips: DataFrame, make: Callable[[], Aligner]) -> DataFrame:
    """key, samples, text, sample_rate -> key, words; give it only the rows that are to be aligned.

    A task holds the words of TEXT_BYTES of text, or of one longer text, at a time.
    """
    kind = clips.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part, _ in (x for batch in batches for x in portions(batch)):
            rows = zip(part["samples"], part["text"].to_pylist(), part["sample_rate"].to_pylist(), strict=True)
            words = word_lists([model.align(x.values.to_numpy(zero_copy_only=False), t, r) for x, t, r in rows])
            yield pa.record_batch([part["key"], words], ["key", "words"])

    return clips.select("key", "samples", "text", "sample_rate").mapInArrow(run, f"key {kind}, words array<{ALIGNED_WORD}>")
