"""Ranged reading, and files that appear whole or not at all."""

from __future__ import annotations

import io
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lyrebird.sources.audio import wav_file, wav_samples
from lyrebird.sources.files import LyricWriter, WavReader, Written, cut, interleaved, listed, read_wav, wav_head, wav_range, write_lyrics, write_wav

SAMPLES = "clip_id string, channel int, idx long, v double"


def rows_of(name: str, x: np.ndarray) -> list[tuple]:
    return [(name, c, i, float(v)) for c, own in enumerate(x) for i, v in enumerate(own)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, out = np.random.default_rng(5), tmp_path_factory.mktemp("audio")
    for name, channels, n, rate, width in (("a", 2, 5000, 44100, 2), ("b", 1, 1, 44100, 2), ("c", 2, 3001, 48000, 3), ("d", 1, 2000, 8000, 1), ("e", 1, 700, 44100, 4)):
        with wave.open(str(out / f"{name}.WAV" if name == "b" else out / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(rng.integers(0, 256, n * channels * width, np.uint8).tobytes())
    (out / "note.txt").write_text("no audio")
    (out / "_hidden.wav").write_bytes(b"")
    return out


@pytest.mark.parametrize("range_bytes", [100, 997, 1 << 20])
def test_ranges_are_the_whole(spark, folder, range_bytes):
    df = read_wav(spark, str(folder), range_bytes=range_bytes)
    got = {}
    for r in df.collect():
        got.setdefault((Path(r.clip_id).name[0], r.channel), []).append((r.idx, r.v))
    seen = set()
    for p in folder.glob("[a-e].*"):
        for channel, own in enumerate(wav_samples(p.read_bytes(), 44100)):
            mine = sorted(got[p.name[0], channel])
            assert [i for i, _ in mine] == list(range(len(own)))
            assert np.allclose([v for _, v in mine], own, rtol=0, atol=1e-6)
            seen.add((p.name[0], channel))
    assert seen == set(got)
    if range_bytes == 100:
        assert df.rdd.getNumPartitions() > 100


def test_cutting():
    files = [("x", 250), ("y", 10), ("z", 0), ("w", 90)]
    parts = [p.parts for p in cut(files, 100)]
    assert [[(n, b, e) for n, _, b, e in p] for p in parts] == [[("x", 0, 100)], [("x", 100, 200)], [("x", 200, 250), ("y", 0, 10), ("z", 0, 0), ("w", 0, 90)]]


def test_many_small_files(spark, tmp_path):
    """Their number counts, not only their bytes: in tasks that write and read them, and in batches."""
    clips = 1500
    df = spark.range(clips * 2).selectExpr("string(id div 2) AS clip_id", "0 AS channel", "id % 2 AS idx", "(id % 100) / 128D AS v")
    write_wav(df, str(tmp_path), 8000)
    back = read_wav(spark, str(tmp_path), 8000)
    assert back.rdd.getNumPartitions() == 3
    got = {(Path(r.clip_id).stem, r.channel, r.idx): r.v for r in back.collect()}
    assert got == {(str(i // 2), 0, i % 2): int(i % 100 / 128 * 32767) / 32768 for i in range(clips * 2)}
    reader = WavReader({"path": str(tmp_path), "rate": 8000})
    parts = reader.partitions()
    assert max(len(p.parts) for p in parts) == 512
    assert [[b.num_rows for b in reader.read(p)] for p in parts] == [[2 * len(p.parts)] for p in parts]


def test_broken_files(spark, tmp_path):
    data = wav_file(np.arange(20).reshape(2, 10) / 50, 44100)
    for size in (len(data) - 3, len(data) - 4, 44 + 1):
        cut_off = data[:size]
        if size > 48:
            with pytest.warns(UserWarning):
                first, x = wav_range(io.BytesIO(cut_off), size, 0, size, 44100)
            assert first == 0 and x.shape == (2, (size - 44) // 4)
        with pytest.raises(ValueError, match="middle of its data"):
            wav_range(io.BytesIO(cut_off), size, 0, size, 44100, skip_invalid=False)
    for bad in (b"RIFFxxxxWAVE", b"no file at all", wav_head(0, 1, 8000), data.replace(b"\x10\x00data", b"\x0c\x00data")):
        with pytest.raises(ValueError):
            wav_range(io.BytesIO(bad), len(bad), 0, len(bad), 44100)
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "none"), ".wav")
    assert read_wav(spark, str(tmp_path)).count() == 0


def test_written_files_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    clips = {"one/two": rng.uniform(-1.2, 1.2, (2, 333)), "mono é": rng.uniform(-1, 1, (1, 90)), "s": np.zeros((1, 1))}
    df = spark.createDataFrame([r for k, x in clips.items() for r in rows_of(k, x)], SAMPLES).repartition(7)
    out = tmp_path / "out"
    write_wav(df, str(out), 8000, piece=50)
    assert sorted(p.name for p in out.iterdir()) == ["mono%20%C3%A9.wav", "one%2Ftwo.wav", "s.wav"]
    for name, key in (("one%2Ftwo", "one/two"), ("mono%20%C3%A9", "mono é"), ("s", "s")):
        assert (out / f"{name}.wav").read_bytes() == wav_file(clips[key], 8000)
    back = read_wav(spark, f"file://{out}", 8000, range_bytes=64)
    assert back.count() == 2 * 333 + 90 + 1
    write_wav(df.where("clip_id = 's'"), str(out), 8000)
    assert [p.name for p in out.iterdir()] == ["s.wav"]
    write_wav(df.where("clip_id = 'mono é'"), str(out), 8000, mode="append")
    assert len(list(out.iterdir())) == 2


def test_wrong_samples(spark, tmp_path):
    for bad in ([("x", 0, 0, 0.0), ("x", 0, 2, 0.0)], rows_of("x", np.zeros((3, 2))), [("x", 0, 0, 0.0), ("x", 1, 1, 0.0)], [("x", 0, 0, 0.0)] * 2):
        with pytest.raises(PySparkException):
            write_wav(spark.createDataFrame(bad, SAMPLES), str(tmp_path / "bad"), 8000)
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    assert interleaved(spark.createDataFrame([], SAMPLES)).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    out = tmp_path / "songs"
    songs = spark.range(40).select(F.col("id").cast("string").alias("song_id"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise("text").alias("value")).repartition(4)
    with pytest.raises(PySparkException):
        write_lyrics(songs, str(out))
    assert not out.exists() or not list(out.rglob("*.lrc"))


def test_lyric_files(spark, tmp_path):
    out = tmp_path / "songs"
    songs = spark.createDataFrame([("a b", "[00:01.000]é"), ("c/d", "x\ny"), ("n", None)], "song_id string, value string")
    write_lyrics(songs, str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {"a%20b.kara.lrc": "[00:01.000]é".encode(), "c%2Fd.kara.lrc": b"x\ny", "n.kara.lrc": b""}
    with pytest.raises(PySparkException):
        write_lyrics(songs.union(songs), str(tmp_path / "twice"))
    assert not list((tmp_path / "twice").rglob("*.lrc"))


def test_abandoned_attempts_do_not_count(tmp_path):
    """Of two attempts of one task only what is committed appears."""
    import pyarrow as pa

    batch = pa.record_batch({"song_id": ["a"], "value": ["first"]})
    writer = LyricWriter({"path": str(tmp_path / "s")}, overwrite=False)
    writer.write(iter([batch]))
    second = writer.write(iter([pa.record_batch({"song_id": ["a"], "value": ["second"]})]))
    writer.commit([second, None])
    assert [(p.name, p.read_text()) for p in (tmp_path / "s").iterdir()] == [("a.kara.lrc", "second")]
    other = LyricWriter({"path": str(tmp_path / "s")}, overwrite=False)
    other.abort([other.write(iter([batch]))])
    assert len(list((tmp_path / "s").iterdir())) == 1
    with pytest.raises(ValueError, match="same file"):
        other.commit([Written([("x", "a")]), Written([("y", "a")])])
