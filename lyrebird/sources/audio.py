"""WAV and FLAC files as rows of samples, and samples as WAV files."""

from __future__ import annotations

import io
import warnings
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.resample import Resampler
from lyrebird.sources.flac import flac_values

RATE = 44100


def quantized(value: Column) -> Column:
    """16-bit value of a sample: cut to -1 .. 1, times 32767, cut off toward zero."""
    return (F.least(F.greatest(value.cast("double"), F.lit(-1.0)), F.lit(1.0)) * F.lit(32767.0)).cast("smallint")


def planar(channels: pa.ListScalar) -> np.ndarray:
    """(channels, samples) of a list of lists of samples."""
    return np.stack([c.values.to_numpy(zero_copy_only=False).astype(np.float64) for c in channels.values]) if len(channels.values) else np.empty((0, 0))


def wav_file(channels: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of (channels, samples); one or two channels."""
    if channels.ndim != 2 or channels.shape[0] not in (1, 2):
        raise ValueError("one or two channels are needed")
    codes = (np.clip(channels.astype(np.float64), -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(codes.T.tobytes())
    return out.getvalue()


def pcm_values(raw: np.ndarray, floats: bool = False) -> np.ndarray:
    """Values of little-endian samples, a row of bytes each: PCM of one to four bytes, or floats of four or eight."""
    width = raw.shape[1]
    if floats:
        return np.ascontiguousarray(raw).view(f"<f{width}")[:, 0].astype(np.float64)
    if width == 1:
        return (raw[:, 0].astype(np.float64) - 128) / 128
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, 4 - width :] = raw
    return wide.view("<i4")[:, 0] / float(1 << 31)


def wav_samples(data: bytes, rate: int, skip_invalid: bool = True) -> np.ndarray:
    """(channels, samples) as 32-bit floats at the wanted rate; 8, 16, 24 and 32-bit PCM.

    Frames cut off at the end of a file are left out with a warning, or are an
    error without skip_invalid; a file without any sample is an error.  A FLAC file
    is read likewise, without the frames whose check sums are wrong.
    """
    if data[:4] == b"fLaC":
        values, own = flac_values(data, skip_invalid)
        return Resampler(own, rate)(values).astype(np.float32)
    with wave.open(io.BytesIO(data)) as w:
        width, n, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw, told = w.readframes(w.getnframes()), w.getnframes()
    whole = len(raw) // (width * n)
    if whole < told:
        if not skip_invalid:
            raise ValueError("the file ends in the middle of its data")
        warnings.warn("frames that are cut off are left out", stacklevel=2)
    raw = np.frombuffer(raw[: whole * width * n], np.uint8).reshape(-1, width)
    if not len(raw):
        raise ValueError("no samples")
    return Resampler(own, rate)(pcm_values(raw).reshape(-1, n).T).astype(np.float32)


def decode_wav(files: DataFrame, rate: int = RATE, skip_invalid: bool = True) -> DataFrame:
    """path, content -> clip_id, stem, channel, sample_rate, samples: a row for each channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                samples = wav_samples(data.as_py(), rate, skip_invalid)
                n = len(samples)
                yield pa.record_batch({
                    "clip_id": pa.array([path] * n, pa.string()), "stem": pa.array(["input"] * n, pa.string()), "channel": pa.array(range(n), pa.int32()),
                    "sample_rate": pa.array([rate] * n, pa.int32()), "samples": pa.array(list(samples), pa.list_(pa.float32())),
                })

    return files.select("path", "content").mapInArrow(run, "clip_id string, stem string, channel int, sample_rate int, samples array<float>")


def read_audio(spark: SparkSession, path: str, rate: int = RATE, skip_invalid: bool = True) -> DataFrame:
    return decode_wav(spark.read.format("binaryFile").load(path), rate, skip_invalid)


def encode_wav(audio: DataFrame, rate: int = RATE) -> DataFrame:
    """clip_id, channels (an array of sample arrays) -> clip_id, content."""
    kind = audio.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [wav_file(planar(c), rate) for c in batch["channels"]]
            yield pa.record_batch([batch["clip_id"], pa.array(files, pa.binary())], ["clip_id", "content"])

    return audio.select("clip_id", "channels").mapInArrow(run, f"clip_id {kind}, content binary")


def tap(folder: str | None):
    """A function that writes a table under a name and hands it on; without a folder it only hands it on."""

    def write(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        if folder is None:
            return df
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns)

    return write
