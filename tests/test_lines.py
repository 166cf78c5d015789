"""Eligibility, intervals, slices and word assembly against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators.assemble import assembled, moved_end
from lyrebird.operators.lines import aligned_interval, clip, clip_rows, eligible, line_intervals, line_text
from lyrebird.operators.models import EvenAligner, WholeMixAsVocals, aligned, aligned_batches, batches_of, even_words, separated, separated_rows
from lyrebird.operators.signal import SignalConfig
from lyrebird.plans.word_timing import word_timing
from lyrebird.schema import ALIGNED_WORD, WORD
from lyrebird.sources.audio import wav_samples


def fold(text, words, base):
    """The rules of the fold, one after the other."""
    out, cursor = [], 0
    for word, a, b in words:
        if a is None or b is None:
            continue
        j = text.find(word, cursor)
        if j < 0:
            continue
        if j > cursor:
            out.append((text[cursor:j], out[-1][2] if out else None, a + base))
        out.append((word, a + base, b + base))
        cursor = j + len(word)
    if text[cursor:]:
        out.append((text[cursor:], out[-1][2] if out else None, None))
    return out


def test_fold(spark):
    rng, rows = random.Random(7), []
    for i in range(300):
        letters = "ab 好😀"
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        words = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(len(text) + 1)
            word = text[a : a + rng.randrange(4)] if rng.random() < 0.8 else rng.choice(["zz", "", "b"])
            t = rng.choice([None, 0, rng.randrange(500)])
            words.append((word, t, None if t is None else rng.choice([t, t + 50])))
        rows.append((i, text, words, rng.choice([0, 1000])))
    df = spark.createDataFrame(rows, f"i int, s string, w array<{ALIGNED_WORD}>, b long")
    out = df.withColumn("o", assembled(F.col("s"), F.col("w"), F.col("b"))).withColumn("e", moved_end(F.col("o"), F.lit(99).cast("long"))[1])
    for r in out.collect():
        expected = fold(rows[r.i][1], rows[r.i][2], rows[r.i][3])
        assert [(w.content, w.start, w.end) for w in r.o] == expected, rows[r.i]
        assert r.e == (expected[-1][2] if expected and expected[-1][2] is not None else 99)


def test_intervals_see_every_line(spark):
    rows = [("s", 0, None, None), ("s", 1, 1000, 900), ("s", 2, 2000, None), ("s", 3, None, None), ("s", 4, 4000, 4500), ("t", 0, 5, 10)]
    got = line_intervals(spark.createDataFrame(rows, "song_id string, line_no int, start_ms long, end_ms long"), rate=1000).collect()
    spans = {(r.song_id, r.line_no): (r.start_sample, r.end_sample) for r in got}
    assert spans == {("s", 0): (0, 1000), ("s", 1): (1000, 900), ("s", 2): (2000, None), ("s", 3): (0, 4000), ("s", 4): (4000, None), ("t", 0): (5, None)}
    assert spark.range(1).select(aligned_interval(F.lit(5), F.lit(5)).alias("x")).first().x
    assert not spark.range(1).select(aligned_interval(F.lit(6), F.lit(5)).alias("x")).first().x


def test_eligible(spark):
    rows = [(["abc"], 0, 10, True), (["abc"], 5, 5, True), (["abc"], 6, 5, False), ([""], 0, 1, False), (["a", "b"], 0, 1, False), ([], 0, 1, False),
            (["漢"], 0, 1, False), (["5 4 3"], 0, 1, False), (["OP: x"], 0, 1, False), (["abc"], None, None, True)]
    data = [(i, [(w, None, None) for w in ws], a, b) for i, (ws, a, b, _) in enumerate(rows)]
    df = spark.createDataFrame(data, f"i int, c array<{WORD}>, a long, b long")
    got = df.select("i", eligible(line_text(F.col("c")), F.col("a"), F.col("b"), "en").alias("en"), eligible(line_text(F.col("c")), F.col("a"), F.col("b"), None).alias("any"))
    found = {r.i: (r.en, r["any"]) for r in got.collect()}
    assert [found[i][0] for i in range(len(rows))] == [r[3] for r in rows]
    assert found[7][1] and found[6][1] and not found[8][1]


def test_clip_and_range_join(spark):
    v = list(range(10))
    spans = [(0, 3), (4, None), (9, 20), (15, None), (5, 5), (7, 3), (0, None)]
    df = spark.createDataFrame([(v, a, b) for a, b in spans], "v array<int>, a long, b long")
    assert [r.x for r in df.select(clip(F.col("v"), F.col("a"), F.col("b")).alias("x")).collect()] == [v[a:b] for a, b in spans]
    samples = spark.createDataFrame([("c", i, float(i)) for i in v], "clip_id string, idx long, v double")
    intervals = spark.createDataFrame([("c", i, a, b) for i, (a, b) in enumerate(spans)], "clip_id string, k int, start_sample long, end_sample long")
    got: dict = {}
    for r in clip_rows(samples, intervals, seconds=1, rate=3).collect():
        got.setdefault(r.k, []).append(r.idx)
    assert {k: sorted(x) for k, x in got.items()} == {k: v[a:b] for k, (a, b) in enumerate(spans) if v[a:b]}


def test_even_words_is_the_stand_in(spark):
    text, ms = "one two  three", 1000
    row = spark.createDataFrame([(text,)], "s string").select(even_words(F.col("s"), F.lit(ms)).alias("w")).first()
    assert [tuple(w) for w in row.w] == EvenAligner().align(np.zeros(ms), text, 1000)


def test_separator(spark):
    audio = spark.createDataFrame([("a", 44100, [[0.5, 0.25], [0.0, 1.0]])], "clip_id string, sample_rate int, channels array<array<float>>")
    assert separated(audio, WholeMixAsVocals).first().channels == [[0.5, 0.25], [0.0, 1.0]]


def test_word_timing(spark, tmp_path):
    lines = [("s", 0, 0, None, "ab cd", 1), ("s", 1, 100, None, "作曲：x", 1), ("s", 2, 200, 290, "ef gh", 1), ("s", 3, 300, 350, "ij", 2)]
    rows = [(a, n, s, e, [(t, s, e)] * k, []) for a, n, s, e, t, k in lines]
    df = spark.createDataFrame(rows, f"song_id string, line_no int, start_ms long, end_ms long, content array<{WORD}>, reference_lines array<array<{WORD}>>")
    vocals = spark.createDataFrame([("s", c, i, 0.1) for c in (0, 1) for i in range(400)], "song_id string, channel int, idx long, v double")
    out = word_timing(df, vocals, EvenAligner, "en", SignalConfig(compress=True), rate=1000, folder=str(tmp_path)).orderBy("line_no").collect()
    assert [(w.content, w.start, w.end) for w in out[0].content] == [("ab", 0, 50), (" ", 50, 50), ("cd", 50, None)]
    assert out[0].end_ms == 100 and out[1].content[0].content == "作曲：x" and out[1].end_ms is None
    assert [(w.content, w.start, w.end) for w in out[2].content] == [("ef", 200, 245), (" ", 245, 245), ("gh", 245, None)] and out[2].end_ms == 290
    assert len(out[3].content) == 2
    assert {p.name for p in tmp_path.iterdir()} == {"01_vocal_stem", "02_normalized", "03_vibrato_suppressed", "04_compressed"}


def test_word_timing_of_a_mix(spark, tmp_path):
    from lyrebird.operators.models import WholeMixAsVocals

    rows = [(a, n, s, e, [(t, s, e)], []) for a, n, s, e, t in (("s", 0, 0, None, "ab cd"), ("s", 1, 100, 100, "xy z"), ("s", 2, 150, None, "ef"), ("mute", 0, 0, None, "no audio"))]
    df = spark.createDataFrame(rows, f"song_id string, line_no int, start_ms long, end_ms long, content array<{WORD}>, reference_lines array<array<{WORD}>>")
    mix = spark.createDataFrame([("s", c, i, 0.1 + c) for c in (0, 1) for i in range(400)], "song_id string, channel int, idx long, v double")
    found = word_timing(df, mix, EvenAligner, None, SignalConfig(), rate=1000, folder=str(tmp_path), make_separator=WholeMixAsVocals, tap_lines=True)
    out = {(r.song_id, r.line_no): r for r in found.collect()}
    assert [(w.content, w.start, w.end) for w in out["s", 0].content] == [("ab", 0, 50), (" ", 50, 50), ("cd", 50, None)]
    assert [(w.content, w.start, w.end) for w in out["s", 1].content] == [("xy", 100, 100), (" ", 100, 100), ("z", 100, None)]  # an empty interval is aligned
    assert out["s", 2].end_ms == 400 and out["mute", 0].content[0].content == "no audio"
    assert {p.name for p in tmp_path.iterdir()} == {"00_input", "01_vocal_stem", "02_normalized", "03_vibrato_suppressed", "05_line"}
    lines = spark.read.parquet(f"{tmp_path}/05_line")
    assert {(r.line_no, len(r.samples)) for r in lines.collect()} == {(0, 100), (2, 250)}


@pytest.mark.parametrize(("chunk", "overlap"), [(12, 3), (12, 6), (12, 0), (1, 0), (2, 1), (5, 2)])
def test_separation_in_chunks(spark, chunk, overlap):
    class Halves:
        """A separator that doubles a mono mix to two channels and counts what it gets."""

        sample_rate = 8

        def separate(self, audio):
            assert audio.shape[1] <= 12
            return {"vocals": np.concatenate([audio * 0.5, audio * 2]) if len(audio) == 1 else audio}

    rng = np.random.default_rng(1)
    audio = {"one": rng.normal(size=(1, 50)), "two": rng.normal(size=(2, 12)), "short": rng.normal(size=(2, 1))}
    rows = [(k, c, i, float(v)) for k, x in audio.items() for c, own in enumerate(x) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "clip_id string, channel int, idx long, v double").repartition(5)
    got = {(r.clip_id, r.channel, r.idx): r.v for r in separated_rows(df, Halves, chunk, overlap).collect()}
    audio["one"] = np.concatenate([audio["one"] * 0.5, audio["one"] * 2])
    wanted = {(k, c, i): v for k, x in audio.items() for c, own in enumerate(x) for i, v in enumerate(own)}
    assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-5 for k in wanted)


def test_wrong_chunks(spark):
    df = spark.createDataFrame([("x", 0, 0, 0.0), ("x", 0, 1, 0.0), ("x", 1, 1, 0.0)], "clip_id string, channel int, idx long, v double")
    with pytest.raises(Exception, match="differ in their samples"):
        separated_rows(df, WholeMixAsVocals, 8, 2).collect()
    with pytest.raises(ValueError, match="half of their length"):
        separated_rows(df, WholeMixAsVocals, 8, 5)


@pytest.mark.parametrize("held", [None, 1, 10_000])
def test_alignment_in_batches(spark, held):
    class Bounded(EvenAligner):
        def align_batch(self, audios, texts, languages, sample_rate):
            sizes = [len(a) for a in audios]
            assert sizes == sorted(sizes) and (len(sizes) == 1 or len(sizes) * max(sizes) <= 100)
            assert languages == [None if t == "" else t[:2] for t in texts]
            return [[(t, None, None)] if not t else [(t, len(a) / sample_rate + 0.00004, 1.00001)] for a, t in zip(audios, texts, strict=True)]

    rng = np.random.default_rng(4)
    data = [(i, [0.0] * int(n), f"w{i}") for i, n in enumerate(rng.integers(0, 60, 150))] + [(200, [0.0] * 500, "long"), (201, None, "no"), (202, [0.0], "")]
    df = spark.createDataFrame([(k, x, t, t[:2] or None) for k, x, t in data], "key int, samples array<float>, text string, language string").repartition(3)
    got = {r.key: [tuple(w) for w in r.words] for r in aligned_batches(df, Bounded, 100, 10, held).collect()}
    assert got == {k: [(t, int(round(len(x or []) / 10 + 0.00004, 4) * 1e3), 1000)] if t else [("", None, None)] for k, x, t in data}


@pytest.mark.parametrize("batched", [False, True])
def test_words_of_few_texts_are_held(spark, batched):
    class Word(str):
        living = 0

        def __init__(self, _):
            Word.living += 1

        def __del__(self):
            Word.living -= 1

    class Counting:
        def align(self, audio, text, sample_rate):
            assert Word.living < 80_000
            return [(Word(w), 1, 2) for w in text.split(" ")]

        def align_batch(self, audios, texts, languages, sample_rate):
            return [self.align(None, t, sample_rate) for t in texts]

    # clips without samples fill no batch
    df = spark.range(4000).selectExpr("id AS key", "array_repeat(float(0), 0) AS samples", "concat(id, repeat(' some', 59)) AS text", "10 AS sample_rate", "string(null) AS language").coalesce(1)
    got = aligned_batches(df, Counting, 1000, 10) if batched else aligned(df, Counting)
    assert {r.key: (r.n, r.word) for r in got.selectExpr("key", "size(words) AS n", "words[0].word AS word").collect()} == {i: (60, str(i)) for i in range(4000)}


def test_batches_are_bounded():
    assert list(batches_of([], 10)) == []
    assert list(batches_of([1, 2, 3, 5, 11], 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(batches_of([0, 0, 0], 10)) == [(0, 3)]


def test_batched_word_timing_and_audio_taps(spark, tmp_path):
    rows = [(a, n, s, e, [(t, s, e)], []) for a, n, s, e, t in (("s", 0, 0, None, "ab cd"), ("s", 1, 100, 100, "xy z"), ("s", 2, 150, None, "ef"), ("mute", 0, 0, None, "no audio"))]
    df = spark.createDataFrame(rows, f"song_id string, line_no int, start_ms long, end_ms long, content array<{WORD}>, reference_lines array<array<{WORD}>>")
    mix = spark.createDataFrame([("s", c, i, 0.1 + c / 2) for c in (0, 1) for i in range(400)], "song_id string, channel int, idx long, v double")
    one = word_timing(df, mix, EvenAligner, rate=1000, make_separator=WholeMixAsVocals)
    two = word_timing(df, mix, EvenAligner, rate=1000, make_separator=WholeMixAsVocals, batch_seconds=0.3, chunk_seconds=0.1, tap_lines=True, audio_folder=str(tmp_path))
    as_rows = lambda d: sorted(map(str, d.collect()))
    assert as_rows(one) == as_rows(two)
    files = {str(p.relative_to(tmp_path)): wav_samples(p.read_bytes(), 1000).shape for p in tmp_path.rglob("*.wav")}
    assert files == {"00_input/s.wav": (2, 400), "01_vocal_stem/s.wav": (2, 400), "02_normalized/s.wav": (1, 400), "03_vibrato_suppressed/s.wav": (1, 400), "05_line/s%2F0.wav": (1, 100), "05_line/s%2F2.wav": (1, 250)}
