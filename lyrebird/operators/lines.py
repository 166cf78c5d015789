"""Which lines are aligned, and the interval of audio that belongs to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import detect_lang, is_metadata_line
from lyrebird.functions.units import RATE, ms_to_sample


def line_text(content: Column) -> Column:
    """The text of a line that is one word so far, else null."""
    return F.when(F.size(content) == 1, content[0]["content"])


def eligible(text: Column, start: Column, end: Column, target_lang: str | None) -> Column:
    """Whether a line is to be aligned: one word that is not empty, of the wanted language, no credits, not inverted."""
    wanted = F.lit(True) if target_lang is None else detect_lang(text).eqNullSafe(F.lit(target_lang))
    inverted = F.coalesce(start > end, F.lit(False))
    return F.coalesce(text.isNotNull() & (text != "") & wanted & ~is_metadata_line(text) & ~inverted, F.lit(False))


def line_intervals(lines: DataFrame, song: str = "song_id", order: str = "line_no", rate: int = RATE) -> DataFrame:
    """lines with start_sample and end_sample.

    The end is the line's own, else the next line's start; of the last line it is
    null, whether or not it has an end of its own.  All lines count as
    neighbours, so this comes before any filter.  A song is one group of lines.
    """
    window = Window.partitionBy(song).orderBy(order)
    last = F.lead(F.lit(1)).over(window).isNull()
    start = ms_to_sample(F.coalesce("start_ms", F.lit(0)), rate)
    end = F.coalesce(F.col("end_ms"), F.lead("start_ms").over(window))
    return lines.withColumn("start_sample", start).withColumn("end_sample", F.when(~last, ms_to_sample(end, rate)))


def aligned_interval(start: Column, end: Column) -> Column:
    """False for an interval that ends before it starts; an empty one is aligned."""
    return end.isNull() | (start <= end)


def clip(samples: Column, start: Column, end: Column) -> Column:
    """samples[start:end], half open and cut to what there is; a null end means all the rest."""
    n = F.size(samples)
    begin = F.least(start, n)
    return F.slice(samples, (begin + 1).cast("int"), F.greatest(F.least(F.coalesce(end, n), n) - begin, F.lit(0)).cast("int"))


def clip_rows(samples: DataFrame, intervals: DataFrame, clip_id: str = "clip_id", seconds: int = 60, rate: int = RATE) -> DataFrame:
    """Rows (clip_id, idx, v) joined with the intervals (clip_id, start_sample, end_sample) they fall into.

    A range join by equality on buckets of some seconds: an interval is repeated
    for each bucket it touches, a sample is in one.  An interval without an end
    goes to the clip's last sample.
    """
    width = seconds * rate
    last = samples.groupBy(clip_id).agg(F.max("idx").alias("_last"))
    spans = intervals.join(last, clip_id).withColumn("_end", F.least(F.coalesce("end_sample", F.col("_last") + 1), F.col("_last") + 1))
    spans = spans.where("_end > start_sample")
    buckets = F.sequence(F.floor(F.col("start_sample") / width), F.floor((F.col("_end") - 1) / width))
    spans = spans.withColumn("_bucket", F.explode(buckets)).drop("_last")
    rows = samples.withColumn("_bucket", F.floor(F.col("idx") / width))
    return rows.join(spans, [clip_id, "_bucket"]).where("idx >= start_sample AND idx < _end").drop("_bucket", "_end")
