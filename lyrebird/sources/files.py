"""Audio and lyric files as Spark data sources: `wav` reads and writes, `lyrics` writes.

    register(spark)
    spark.read.format("wav").option("rate", 16000).load(folder)
    spark.read.format("wav").load(folder)

Reading cuts a file into ranges of bytes; a task reads the header and its own range,
and no file is one row or one task.  Writing goes to files of a task's own attempt,
which the driver moves into place when all tasks are done, and deletes otherwise: a
failed or repeated task leaves nothing.  Paths are local or of a store that pyarrow
opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lyrebird.functions.arrow import keyed_batches
from lyrebird.functions.resample import Resampler
from lyrebird.sources import audio
from lyrebird.sources.audio import RATE, pcm_values
from lyrebird.staging import staged

#: bytes of a range, samples of a batch of rows, and frames of a piece that is written
RANGE_BYTES, BATCH_ROWS, WRITE_FRAMES = 8 << 20, 1 << 16, 1 << 16
#: files that a task reads at most
FILES = 512
_THREADS = 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of the files with a suffix (whatever its case) in a folder and below, or of one file, in order."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(inner) :].split("/"))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(suffix) and not hidden(x.path))


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Header:
    tag: int  # 1 PCM, 3 IEEE float
    channels: int
    rate: int
    width: int  # bytes of a sample
    data: int  # where samples begin
    told: int  # frames by the header
    frames: int  # whole frames that are there

    @property
    def block(self) -> int:
        return self.channels * self.width


def wav_header(f, size: int) -> Header:
    """The header of an open WAV file of so many bytes."""
    f.seek(0)
    start = f.read(12)
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(length, 40))
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if tag == 0xFFFE and len(body) >= 26 else tag
            if (tag, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)) or not channels or not rate:
                raise ValueError(f"WAV of format {tag} with {bits} bits")
            form = tag, channels, rate, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            block = form[1] * form[3]
            # a length that was never written is 0 or all ones: then all there is
            length = size - at - 8 if length in (0, 0xFFFFFFFF) else length
            return Header(*form, at + 8, length // block, min(length, size - at - 8) // block)
        at += 8 + length + length % 2
    raise ValueError("no samples")


def wav_range(f, size: int, begin: int, end: int, rate: int, skip_invalid: bool = True) -> tuple[int, np.ndarray]:
    """The first index and the samples (channels, n) of the part of a file's bytes, at the wanted rate.

    A frame belongs to the range its first byte is in, and a sample at another rate
    to the range of the frame before its time; margins are read beyond the range.
    """
    h = wav_header(f, size)
    if h.frames < h.told and end >= size:
        if not skip_invalid:
            raise ValueError("the file ends in the middle of its data")
        warnings.warn("frames that are cut off are left out", stacklevel=2)
    if not h.frames:
        raise ValueError("no samples")
    first, last = (min(h.frames, max(0, -(-(x - h.data) // h.block))) for x in (begin, end))
    r = Resampler(h.rate, rate)
    reach = r.reach if h.rate != rate else 0
    low, high = max(0, first - reach), min(h.frames, last + reach)
    f.seek(h.data + low * h.block)
    raw = np.frombuffer(f.read((high - low) * h.block), np.uint8)
    values = pcm_values(raw.reshape(-1, h.width), h.tag == 3).reshape(-1, h.channels).T
    if h.rate == rate:
        return first, values
    return r.outputs(first), r.piece(values, low, r.outputs(first), r.outputs(last))


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes: path, size of the file, begin, end."""

    parts: list[tuple[str, int, int, int]]


def cut(files: list[tuple[str, int]], range_bytes: int) -> list[Ranges]:
    """Large files in ranges, small ones together, about so many bytes each, and FILES at most.

    Opening a file counts as a part of the bytes.
    """
    out, held, total = [], [], 0
    for path, size in files:
        for begin in range(0, max(size, 1), range_bytes):
            end = min(size, begin + range_bytes)
            held.append((path, size, begin, end))
            total += max(end - begin, range_bytes // FILES)
            if total >= range_bytes:
                out.append(Ranges(held))
                held, total = [], 0
    return out + ([Ranges(held)] if held else [])


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rate = int(options.get("rate", RATE))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.skip_invalid = str(options.get("skipinvalid", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return cut(listed(self.path, ".wav"), self.range_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return keyed_batches(self.pieces(partition), ["clip_id", "channel", "idx", "v"], BATCH_ROWS)

    def pieces(self, partition: Ranges) -> Iterator[tuple[str, list[np.ndarray]]]:
        store = opened(self.path)[0]
        for path, size, begin, end in partition.parts:
            with store.open_input_file(path) as f:
                first, samples = wav_range(f, size, begin, end, self.rate, self.skip_invalid)
            for channel, values in enumerate(samples):
                for a in range(0, len(values), BATCH_ROWS):
                    part = values[a : a + BATCH_ROWS].astype(np.float32)
                    n = len(part)
                    yield path, [np.full(n, channel, np.int32), np.arange(first + a, first + a + n), part]


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written, and their places once committed."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Writes the files of a task under its own attempt's folder; the driver moves or deletes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.options = dict(options)
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def named(self, key: str) -> str:
        raise NotImplementedError

    def bodies(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, Callable[[], bytes]]]:
        """Of each row its file's key, its bytes, and how the file's head is made."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = opened(self.path)
        folder = f"{inner}/{self.staging}/{uuid.uuid4().hex}"
        done: list[tuple[str, str]] = []
        key, out = None, None
        try:
            for batch in iterator:
                for own, body, head in self.bodies(batch):
                    if own != key:
                        if out is not None:
                            out.close()
                        name = self.named(own)
                        if any(final == name for _, final in done[-1:]) or (key is not None and own < key):
                            raise ValueError("rows of a file are to be together and in order")
                        if not done:
                            store.create_dir(folder, recursive=True)
                        out, key = store.open_output_stream(f"{folder}/{name}"), own
                        done.append((f"{folder}/{name}", name))
                        out.write(head())
                    out.write(body)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, inner = opened(self.path)
        moves = [m for message in messages if message is not None for m in message.files]
        if len({final for _, final in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two tasks wrote the same file")
        if self.overwrite:
            kept = f"{inner}/{self.staging}"
            old = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            for x in old:
                if not x.path.endswith(kept.rsplit("/", 1)[-1]):
                    store.delete_dir(x.path) if x.type == fs.FileType.Directory else store.delete_file(x.path)
        store.create_dir(inner, recursive=True)

        def moved(part: list[tuple[str, str]]) -> None:
            for source, name in part:
                store.move(source, f"{inner}/{name}")

        with ThreadPoolExecutor(_THREADS) as pool:
            list(pool.map(moved, (moves[k::_THREADS] for k in range(_THREADS))))
        self._clear(store, inner)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, inner: str) -> None:
        if store.get_file_info(f"{inner}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{inner}/{self.staging}")


def wav_head(frames: int, channels: int, rate: int) -> bytes:
    """The header of a 16-bit WAV file."""
    size = frames * channels * 2
    if size + 36 > 0xFFFFFFFF:
        raise ValueError("a WAV file has at most 4 GB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", size)


class WavWriter(FileWriter):
    """Rows (clip_id, piece, frames, channels, codes) in order of clip and piece."""

    def named(self, key: str) -> str:
        return f"{quote(key, safe='')}.wav"

    def bodies(self, batch):
        rate = int(self.options.get("rate", RATE))
        for clip, frames, channels, codes in zip(*(batch[c].to_pylist() for c in ("clip_id", "frames", "channels", "codes")), strict=True):
            yield clip, codes, lambda n=frames, k=channels: wav_head(n, k, rate)


class LyricWriter(FileWriter):
    """Rows (song_id, value) in order of song, one a song."""

    def named(self, key: str) -> str:
        return f"{quote(key, safe='')}{self.options.get('suffix', '.kara.lrc')}"

    def bodies(self, batch):
        for song, text in zip(batch["song_id"].to_pylist(), batch["value"].to_pylist(), strict=True):
            yield song, (text or "").encode(self.options.get("encoding", "utf-8")), bytes


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "clip_id string, channel int, idx long, v float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WavWriter(dict(self.options), overwrite)


class LyricFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lyrics"

    def schema(self) -> str:
        return "song_id string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LyricWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(WavFiles)
    spark.dataSource.register(LyricFiles)


def read_wav(spark: SparkSession, path: str, rate: int = RATE, skip_invalid: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """clip_id (the path in its store), channel, idx and v of all WAV files in a folder, at one rate."""
    register(spark)
    return spark.read.format("wav").option("rate", rate).option("skipInvalid", skip_invalid).option("rangeBytes", range_bytes).load(path)


def interleaved(samples: DataFrame, piece: int = WRITE_FRAMES) -> DataFrame:
    """Rows (clip_id, channel, idx, v) as 16-bit frames of the pieces of clips: clip_id, piece, frames and channels of the clip, codes.

    Channels are numbered from 0, one or two a clip, idx from 0 without gaps, the
    same in each channel; anything else is an error.  A piece is the most that is
    gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for row, channels in zip(batch["rows"], batch["channels"].to_pylist(), strict=True):
                order = [row.values.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
                n = len(order[0]) // channels
                if len(order[0]) != n * channels or not (order[1] == np.tile(np.arange(channels), n)).all() or not (np.diff(order[0][::channels]) == 1).all() or not (np.repeat(order[0][::channels], channels) == order[0]).all():
                    raise ValueError("channels of a clip differ in their samples")
                codes.append((np.clip(np.nan_to_num(order[2]), -1, 1) * 32767).astype("<i2").tobytes())
            yield pa.record_batch([*(batch[c] for c in ("clip_id", "piece", "frames", "channels")), pa.array(codes, pa.binary())], ["clip_id", "piece", "frames", "channels", "codes"])

    rows = samples.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("channel").cast("int").alias("channel"), F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    ends = rows.groupBy("clip_id").agg((F.max("idx") + 1).alias("frames"), (F.max("channel") + 1).alias("channels"), F.count("*").alias("n"))
    sound = F.when((F.col("n") == F.col("frames") * F.col("channels")) & F.col("channels").isin(1, 2), F.col("channels"))
    ends = ends.select("clip_id", "frames", F.coalesce(sound, F.raise_error(F.concat(F.lit("one or two whole channels are needed: "), "clip_id")).cast("int")).alias("channels"))
    pieces = rows.groupBy("clip_id", F.expr(f"idx div {piece}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("idx", "channel", "v"))).alias("rows"))
    return pieces.join(ends, "clip_id").mapInArrow(run, "clip_id string, piece long, frames long, channels int, codes binary")


def write_wav(samples: DataFrame, path: str, rate: int = RATE, mode: str = "overwrite", piece: int = WRITE_FRAMES) -> None:
    """A 16-bit WAV file of each clip of rows (clip_id, channel, idx, v); its name is the clip's, percent-encoded.

    Pieces are made side by side; a file is written by one task, a piece at a time.
    Files are dealt to as many tasks as a shuffle has, however few their bytes.
    """
    spark = samples.sparkSession
    register(spark)
    ordered = interleaved(samples, piece).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id").sortWithinPartitions("clip_id", "piece")
    ordered.write.format("wav").mode(mode).option("rate", rate).save(path)


def write_lyrics(songs: DataFrame, path: str, suffix: str = ".kara.lrc", mode: str = "overwrite", encoding: str = "utf-8") -> None:
    """A text file of each song of rows (song_id, value), one a song; its name is the song's, percent-encoded, and the suffix."""
    register(songs.sparkSession)
    rows = songs.select(F.col("song_id").cast("string").alias("song_id"), "value").sortWithinPartitions("song_id")
    rows.write.format("lyrics").mode(mode).option("suffix", suffix).option("encoding", encoding).save(path)


def tap(folder: str | None, audio_folder: str | None = None, rate: int = RATE):
    """A function that writes a table of samples under a name and hands it on.

    In folder it is Parquet; in audio_folder a WAV file a clip, and of lines (song_id,
    line_no, samples) one a line.  What goes on is the table as it was, not its 16
    bits.
    """
    write = audio.tap(folder)

    def dump(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        if audio_folder is None:
            return write(df, name, *partition_by)
        df = write(df, name, *partition_by) if folder else staged(df, "tap")
        rows = df
        if "samples" in df.columns:
            rows = df.select(F.concat_ws("/", "song_id", F.col("line_no").cast("string")).alias("clip_id"), F.posexplode("samples").alias("idx", "v"))
        write_wav(rows if "channel" in rows.columns else rows.withColumn("channel", F.lit(0)), f"{audio_folder}/{name}", rate)
        return df

    return dump
