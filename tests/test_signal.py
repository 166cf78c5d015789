"""Signal operators against NumPy and closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import signal
from lyrebird.sources.audio import decode_wav, encode_wav, quantized, tap, wav_file, wav_samples
from lyrebird.streaming.compress import compress_stream

SCHEMA = "clip_id string, channel int, idx long, v double"


def envelope(x, w):
    left = w // 2
    padded = np.concatenate([np.full(left, x[0]), x, np.full(w - left - 1, x[-1])]).astype(float)
    return np.sqrt([np.mean(padded[i : i + w] ** 2) for i in range(len(x))])


def compress(x, c):
    e, g, out = np.abs(x), 1.0, []
    t = c.wanted(e)
    for i in range(len(x)):
        if i:
            g += c.speed(c.attack_ms if e[i] > e[i - 1] else c.release_ms) * (t[i] - g)
        out.append(x[i] * g)
    return np.array(out)


def rows(clips):
    return [(k, c, i, float(v)) for k, channels in clips.items() for c, x in enumerate(channels) for i, v in enumerate(x)]


def values(df, column="v"):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.idx):
        out.setdefault((r.clip_id, r["channel"] if "channel" in r else 0), []).append(r[column])
    return out


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(3)
    return {"a": [rng.normal(size=90), rng.normal(size=90)], "one": [[0.5]], "flat": [np.full(40, -0.25)], "silent": [np.zeros(12)], "short": [[1.0, 2.0, 3.0]]}


@pytest.mark.parametrize("window", [1, 2, 9, 16, 100])
@pytest.mark.parametrize("piece", [16, 1000])
def test_envelope(spark, clips, window, piece):
    got = values(signal.sliding_rms(spark.createDataFrame(rows(clips), SCHEMA), window, piece=piece), "rms")
    for k, channels in clips.items():
        for c, x in enumerate(channels):
            assert np.allclose(got[k, c], envelope(np.array(x), window), atol=1e-9), (k, window)
    assert np.allclose(got["flat", 0], 0.25)


def test_loudness_is_joint_over_channels(spark, clips):
    got = values(signal.normalize_loudness(spark.createDataFrame(rows(clips), SCHEMA)))
    both = np.array(clips["a"])
    assert np.allclose([got["a", 0], got["a", 1]], both * 0.1 / np.sqrt((both**2).mean()))
    assert got["silent", 0] == [0.0] * 12


def test_vibrato_window_is_at_least_two_periods():
    assert signal.vibrato_window(5.0, 50.0, 44100) == 17640 == signal.vibrato_window(5.0, 10.0, 44100)
    assert signal.vibrato_window(0.0, 50.0, 44100) == 17640 and signal.vibrato_window(5.0, 900.0, 1000) == 900


def test_vibrato(spark, clips):
    got = values(signal.suppress_vibrato(spark.createDataFrame(rows(clips), SCHEMA), 7, piece=16))
    x = np.array(clips["a"][0])
    e = envelope(x, 7)
    assert np.allclose(got["a", 0], x / (e + 1e-10) * envelope(e, 7))


@pytest.mark.parametrize("piece", [4, 32, 1000])
def test_compressor_in_pieces(spark, clips, piece):
    c = signal.Compressor(attack_ms=5, release_ms=20, rate=1000)
    df = spark.createDataFrame(rows(clips), SCHEMA).where("channel = 0")
    got = values(signal.from_pieces(signal.compress_pieces(signal.to_pieces(df, piece=piece), c), piece=piece))
    for k, channels in clips.items():
        assert np.allclose(got[k, 0], compress(np.array(channels[0]), c)), k


def test_compressor_of_arrays(spark, clips):
    c = signal.Compressor(attack_ms=5, release_ms=20, rate=1000)
    df = spark.createDataFrame([(k, [float(v) for v in x[0]]) for k, x in clips.items()] + [("none", [])], "k string, v array<double>")
    got = {r.k: r.o for r in df.select("k", signal.compressed(F.col("v"), c).alias("o")).collect()}
    assert got.pop("none") == []
    for k, x in got.items():
        assert np.allclose(x, compress(np.array(clips[k][0]), c))
    assert df.select(signal.compressed(F.col("v"), signal.Compressor(ratio=1.0)).alias("o")).count() == len(clips) + 1


def test_knee_is_hard():
    c = signal.Compressor(threshold_dbfs=-20.0, ratio=4.0)
    assert np.allclose(c.wanted(np.array([0.0, 0.1, 0.5])), [0.0, 1.0, (0.1 + 0.4 / 4) / 0.5], atol=1e-8)


def test_stream_equals_batch(spark, clips, tmp_path):
    c = signal.Compressor(attack_ms=5, release_ms=20, rate=1000)
    df = spark.createDataFrame(rows(clips), SCHEMA).where("channel = 0")
    pieces = signal.to_pieces(df, piece=16).select("clip_id", F.col("piece").cast("long").alias("piece"), "samples")
    pieces.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "in"))
    run = compress_stream(stream, c).writeStream.format("memory").queryName("pressed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = values(signal.from_pieces(spark.table("pressed"), piece=16))
    for k, channels in clips.items():
        assert np.allclose(got[k, 0], compress(np.array(channels[0]), c)), k


def test_late_pieces_wait(spark, clips, tmp_path):
    """Pieces in falling order, one file and one batch each, of two clips."""
    c = signal.Compressor(attack_ms=5, release_ms=20, rate=1000)
    df = spark.createDataFrame(rows(clips), SCHEMA).where("channel = 0 AND clip_id IN ('a', 'flat')")
    pieces = signal.to_pieces(df, piece=20).select("clip_id", F.col("piece").cast("long").alias("piece"), "samples")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "in"))
    run = compress_stream(stream, c).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    seen = []
    for number in (3, 1, 0, 2, 4):
        pieces.where(F.col("piece") == number).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run.processAllAvailable()
        seen.append(spark.table("late").where("clip_id = 'a'").count())
    run.stop()
    assert seen == [0, 0, 2, 4, 5]
    got = values(signal.from_pieces(spark.table("late"), piece=20))
    for k in ("a", "flat"):
        assert np.allclose(got[k, 0], compress(np.array(clips[k][0]), c)), k


def test_config_gates(spark):
    df = spark.createDataFrame([("a", i, 0.5) for i in range(20)], "clip_id string, idx long, v double")
    off = signal.SignalConfig(normalize=False, suppress_vibrato=False)
    assert values(signal.preprocess(df, off))["a", 0] == [0.5] * 20
    assert np.allclose(values(signal.preprocess(df, signal.SignalConfig()))["a", 0], 0.1)


def test_peaks(spark, clips):
    got = signal.linked_peak(spark.createDataFrame(rows(clips), SCHEMA)).where("clip_id = 'a'").orderBy("idx").collect()
    assert np.allclose([r.peak for r in got], np.abs(clips["a"]).max(0))
    assert signal.first_channel(spark.createDataFrame(rows(clips), SCHEMA)).where("channel <> 0").count() == 0


def test_pcm(spark):
    xs = [-2.0, -1.0, -0.99999, -1e-6, 0.0, 1e-6, 0.5, 1.0, 3.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(quantized(F.col("x")).alias("q")).collect()
    assert [r.q for r in got] == [int(max(-1.0, min(1.0, x)) * 32767) for x in xs]


def test_wav(spark, tmp_path):
    x = np.array([[0.5, -0.25, 1.0, -1.0], [0.0, 0.1, 0.2, 0.3]])
    df = spark.createDataFrame([("f", x.tolist())], "clip_id string, channels array<array<double>>")
    data = encode_wav(df, 8000).first().content
    back = decode_wav(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"), 8000).orderBy("channel").collect()
    assert np.allclose([r.samples for r in back], x, atol=1e-4) and [r.channel for r in back] == [0, 1]
    with pytest.raises(ValueError):
        wav_file(np.zeros((3, 4)), 8000)
    with pytest.raises(ValueError):
        wav_samples(wav_file(np.zeros((1, 0)), 8000), 8000)
    with pytest.raises(ValueError):
        wav_samples(bytes(data)[:-3], 8000, skip_invalid=False)
    with pytest.warns(UserWarning):
        assert wav_samples(bytes(data)[:-3], 8000).shape == (2, 3)
    assert wav_samples(bytes(data), 16000).shape == (2, 8)
    assert tap(None)(df, "x") is df


def test_linked_compression(spark):
    rng = np.random.default_rng(6)
    c = signal.Compressor(-18.0, 4.0, 10.0, 100.0, 400)
    audio = {k: rng.normal(0, 0.4, (2, n)) for k, n in ((1, 700), (2, 1), (3, 64))}
    rows = [(k, ch, i, float(v)) for k, x in audio.items() for ch in (0, 1) for i, v in enumerate(x[ch])]
    out = signal.compress_linked(spark.createDataFrame(rows, "clip_id int, channel int, idx long, v double"), c, piece=50).collect()
    got = {(r.clip_id, r.channel, r.idx): r.v for r in out}
    for k, x in audio.items():
        e = np.abs(x).max(0)
        gain, wanted = 1.0, c.wanted(e)
        for i in range(x.shape[1]):
            if i:
                gain += (c.speed(10.0) if e[i] > e[i - 1] else c.speed(100.0)) * (wanted[i] - gain)
            assert all(abs(got[k, ch, i] - x[ch, i] * gain) < 1e-12 for ch in (0, 1))
    assert len(out) == len(rows)


def test_gains_in_blocks():
    rng = np.random.default_rng(1)
    for n, most in ((0, 0.5), (1, 0.5), (256, 0.64), (1000, 0.64), (5000, 0.01)):
        k = rng.uniform(0, most, n)
        kt = k * rng.uniform(0, 1, n)
        g, wanted = 0.7, []
        for a, b in zip(k, kt, strict=True):
            g += b - a * g
            wanted.append(g)
        assert np.allclose(signal.run_gains(k, kt, 0.7), wanted, rtol=1e-12, atol=1e-14)


def test_chain_over_channels(spark):
    """Joint loudness, vibrato by channel, one gain; against the steps in NumPy."""
    rng = np.random.default_rng(8)
    audio = {"a": rng.normal(0, 0.4, (2, 150)), "b": rng.normal(0, 0.2, (1, 7)), "c": np.zeros((2, 3))}
    config = signal.SignalConfig(vibrato_smooth_window_ms=450.0, compress=True, comp_attack_ms=200.0, comp_release_ms=2000.0)
    c = signal.Compressor(config.comp_threshold_dbfs, config.comp_ratio, 200.0, 2000.0, 20)
    got = values(signal.preprocess(spark.createDataFrame(rows(audio), SCHEMA).repartition(4), config, rate=20, piece=16))
    for name, x in audio.items():
        level = np.sqrt((x**2).mean())
        x = x * (0.1 / level) if level > 1e-10 else x
        for k, own in enumerate(x):
            e = envelope(own, 9)
            x[k] = own / (e + 1e-10) * envelope(e, 9)
        gains = compress(np.abs(x).max(0), c) / np.where(np.abs(x).max(0) > 0, np.abs(x).max(0), 1)
        for k, own in enumerate(x):
            assert np.allclose(got[name, k], own * gains), (name, k)
    assert len(got) == 5


def test_repeated_indices_are_an_error(spark):
    for bad in ([0, 0, 1], [0, 2]):
        df = spark.createDataFrame([("a", i, 0.5) for i in bad], "clip_id string, idx long, v double")
        with pytest.raises(Exception, match="repeat or have gaps"):
            signal.preprocess(df, signal.SignalConfig()).collect()


def test_vibrato_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", None, i, 0.5, f"x{i}") for i in range(30)], "clip_id string, channel int, idx long, v float, note string")
    out = signal.suppress_vibrato(df, 3, piece=4).orderBy("idx").collect()
    assert [r.note for r in out] == [f"x{i}" for i in range(30)] and np.allclose([r.v for r in out], 0.5)
