"""Word-level timing of line-level lyrics: the whole plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.text import detect_lang
from lyrebird.functions.units import RATE
from lyrebird.operators.assemble import assembled, moved_end
from lyrebird.operators.lines import aligned_interval, clip_rows, eligible, line_intervals, line_text
from lyrebird.operators.models import Aligner, BatchAligner, StemSeparator, aligned, aligned_batches, separated_rows
from lyrebird.operators.signal import SignalConfig, first_channel, preprocess
from lyrebird.schema import WORD
from lyrebird.sources.files import tap
from lyrebird.staging import staged


def with_words(lines: DataFrame, words: Column) -> DataFrame:
    """lines with content put together from the aligned words; lines without any keep theirs."""
    made = assembled(line_text(F.col("content")), words, F.coalesce("start_ms", F.lit(0)))
    lines = lines.withColumn("_made", F.when(words.isNotNull(), made))
    content, end = moved_end(F.col("_made"), F.col("end_ms"))
    lines = lines.withColumn("end_ms", F.when(F.col("_made").isNotNull(), end).otherwise(F.col("end_ms")))
    return lines.withColumn("content", F.when(F.col("_made").isNotNull(), content).otherwise(F.col("content")).cast(f"array<{WORD}>")).drop("_made")


def word_timing(
    lines: DataFrame,
    audio: DataFrame,
    make_aligner: Callable[[], Aligner | BatchAligner],
    target_lang: str | None = None,
    config: SignalConfig = SignalConfig(),
    rate: int = RATE,
    folder: str | None = None,
    make_separator: Callable[[], StemSeparator] | None = None,
    tap_lines: bool = False,
    audio_folder: str | None = None,
    chunk_seconds: float = 10.0,
    overlap: float = 0.25,
    batch_seconds: float | None = None,
) -> DataFrame:
    """lines with word times.

    audio has song_id, channel, idx and v; with a separator it is a mix, of which
    the vocals are taken, else it is the vocals.  Its first channel goes on.  Lines
    that are not eligible, and those of songs without audio, stay as they are, and
    the aligner sees none of them.  Samples meet their lines in a range join; a
    line's own samples, and the separator's chunks of some seconds that overlap by a
    part, are the most that is gathered.  With a folder the stages are written there,
    00_input only with a separator, and with tap_lines each line's samples under
    05_line/line_no=...  With an audio_folder they are there as WAV files, one a song
    (and line).  With batch_seconds the aligner is one of batches, of so many seconds
    padded, and gets each line's language.
    """
    dump = tap(folder, audio_folder, rate)
    samples = audio.withColumnRenamed("song_id", "clip_id")
    if make_separator:
        chunk = max(2, round(chunk_seconds * rate))
        samples = separated_rows(dump(samples, "00_input"), make_separator, chunk, min(chunk // 2, round(overlap * chunk)))
    # the first channel alone goes on
    samples = first_channel(dump(samples, "01_vocal_stem")).drop("channel")
    # written once: the lines' intervals, their samples and the songs with audio all come from it
    samples = staged(preprocess(samples, config, rate, dump if folder or audio_folder else None), "word-timing")
    timed = line_intervals(lines, rate=rate)
    wanted = eligible(line_text(F.col("content")), F.col("start_ms"), F.col("end_ms"), target_lang)
    chosen = timed.where(wanted & aligned_interval(F.col("start_sample"), F.col("end_sample")))
    chosen = chosen.join(samples.select(F.col("clip_id").alias("song_id")).distinct(), "song_id", "left_semi")
    intervals = chosen.select(F.col("song_id").alias("clip_id"), "line_no", "start_sample", "end_sample")
    rows = clip_rows(samples, intervals, rate=rate).groupBy(F.col("clip_id").alias("song_id"), "line_no")
    heard = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda r: r["v"].cast("float")).alias("samples"))
    heard = dump(heard, "05_line", "line_no") if tap_lines else heard
    clips = chosen.join(heard, ["song_id", "line_no"], "left").select(
        F.to_json(F.struct("song_id", "line_no")).alias("key"),
        F.coalesce("samples", F.array().cast("array<float>")).alias("samples"),
        line_text(F.col("content")).alias("text"),
        F.lit(rate).alias("sample_rate"),
        F.lit(target_lang).cast("string").alias("language") if target_lang else detect_lang(line_text(F.col("content"))).alias("language"),
    )
    words = aligned_batches(clips, make_aligner, max(1, round(batch_seconds * rate)), rate) if batch_seconds else aligned(clips, make_aligner)
    words = words.withColumn("id", F.from_json("key", "struct<song_id:string,line_no:int>"))
    found = words.select(F.col("id.song_id").alias("song_id"), F.col("id.line_no").alias("line_no"), "words")
    joined = timed.join(found, ["song_id", "line_no"], "left").drop("start_sample", "end_sample")
    return with_words(joined, F.col("words")).drop("words")
