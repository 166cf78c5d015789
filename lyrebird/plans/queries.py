"""The library's operators as queries over the given tables, each with its SQL for DuckDB.

The tables have no lyrics and no audio, so users and conversations stand for
songs, their events and turns for lines, and vectors or event values for clips.
Texts get script characters and credits by their ids, since none has any.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import METADATA_KEYWORDS, detect_lang, is_metadata_line, script_count
from lyrebird.functions.units import db_to_linear, job_id, linear_to_db, ms_to_sample, round4, sample_to_ms, seconds_to_ms, wall_ms
from lyrebird.operators import signal
from lyrebird.operators.lines import clip, clip_rows, eligible, line_intervals, line_text
from lyrebird.operators.models import EvenAligner, WholeMixAsVocals, aligned_batches, even_words
from lyrebird.plans.word_timing import with_words, word_timing
from lyrebird.schema import ALIGNED_WORD, WORD
from lyrebird.sources.alignment import batch_request, case_words, service_words
from lyrebird.sources.audio import decode_wav, encode_wav, quantized
from lyrebird.sources.files import read_wav, write_lyrics, write_wav
from lyrebird.sources.lrc import lines_of_json, ms_tag, parse_lrc, read_lrc, read_lrc_any, render_lrc, song_json, song_metadata
from lyrebird.staging import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RATE = 44100
#: window of the envelope over event values
WINDOW = 9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text

_SALTED = (
    "concat(text, CASE doc_id % 5 WHEN 1 THEN repeat('かな', CAST(length(text) AS INT)) WHEN 2 THEN repeat('漢', CAST(length(text) AS INT)) "
    "WHEN 3 THEN repeat('カ漢', CAST(length(text) AS INT)) ELSE '・ー㐀é' END)"
)
_SALTED_SQL = _SALTED.replace("CAST(length(text) AS INT)", "length(text)")
_COUNTS = """
    SELECT doc_id, s, length(regexp_replace(s, '[^\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}]+', '', 'g')) AS ja,
           length(regexp_replace(s, '[^\\x{4E00}-\\x{9FFF}]+', '', 'g')) AS zh, length(regexp_replace(s, '[^A-Za-z]+', '', 'g')) AS en
    FROM (SELECT doc_id, """ + _SALTED_SQL + """ AS s FROM documents)"""


@query(f"""
WITH c AS ({_COUNTS})
SELECT doc_id, CASE WHEN greatest(ja, zh, en) = 0 THEN NULL WHEN ja >= zh AND ja >= en THEN 'ja' WHEN zh >= en THEN 'zh' ELSE 'en' END AS lang_found,
       CAST(ja AS BIGINT) AS n_ja, CAST(zh AS BIGINT) AS n_zh, CAST(en AS BIGINT) AS n_en FROM c""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SALTED).alias("s"))
    counts = [script_count(F.col("s"), k).cast("long").alias(f"n_{k}") for k in ("ja", "zh", "en")]
    return docs.select("doc_id", detect_lang(F.col("s")).alias("lang_found"), *counts)


_CREDITS = ("'作词：'", "'OP: '", "concat('编曲', chr(12288), '：')", "'STOP: '", "'作曲'", "'pv:'", "'演唱: '")
_SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SALTED_LINE = "concat(CASE (doc_id + line_no) % 9 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CREDITS)) + " ELSE '' END, line)"


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_matches({_SALTED_LINE}, '({"|".join(METADATA_KEYWORDS)}){_SPACE_SQL}*[：:][^\\n]') AS is_metadata FROM l""")
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    salted = F.expr(_SALTED_LINE.replace("chr(12288)", "'　'"))
    return lines.select("doc_id", "line_no", is_metadata_line(salted).alias("is_metadata"))


# ---------------------------------------------------------------- units


@query("""
SELECT event_id, CAST(trunc(ms * 44100 / 1000) AS BIGINT) AS sample, CAST(trunc((n / 44100) * 1000) AS BIGINT) AS ms_of_sample,
       CAST(trunc(value * 1e3) AS BIGINT) AS ms_of_seconds
FROM (SELECT event_id, value, epoch_us(ts) // 1000 % 86400000 AS ms, event_id * 7919 AS n FROM events)""")
def time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day_ms = wall_ms(F.col("ts")) % 86_400_000
    return events.select(
        "event_id",
        ms_to_sample(day_ms).alias("sample"),
        sample_to_ms(F.col("event_id") * 7919).alias("ms_of_sample"),
        seconds_to_ms(F.col("value")).alias("ms_of_seconds"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(pow(10.0, (-l_quantity) / 20.0), 9) AS linear, round(20.0 * log10(greatest(abs(l_discount - l_tax), 1e-10)), 6) AS db
FROM lineitem""")
def decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    db = linear_to_db(F.col("l_discount") - F.col("l_tax"))
    return items.select("l_orderkey", "l_linenumber", F.round(db_to_linear(-F.col("l_quantity")), 9).alias("linear"), F.round(db, 6).alias("db"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7.0, 4) AS seconds FROM lineitem")
def service_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", round4(F.col("l_extendedprice") / 7.0).alias("seconds"))


@query("SELECT event_id, concat(user_id, '-', event_id) AS job FROM events")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    slashes = F.repeat(F.lit("/"), (F.col("event_id") % 3).cast("int"))
    location = F.concat(F.lit("http://host:8765/transcriptions/"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"), slashes)
    return events.select("event_id", job_id(location).alias("job"))


# ---------------------------------------------------------------- lines

_OWN_END = "CASE event_id % 5 WHEN 0 THEN start_ms + 1500 WHEN 1 THEN start_ms - 10 END"


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    rows = events.join(first, "user_id").withColumn("start_ms", wall_ms(F.col("ts")) - wall_ms(F.col("t0")))
    rows = rows.withColumn("end_ms", F.expr(_OWN_END)).withColumn("start_ms", F.when(F.col("event_id") % 11 != 0, F.col("start_ms")))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.withColumn("line_no", F.row_number().over(order) - 1)


_EVENT_LINES = f"""
    SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no,
           CASE WHEN event_id % 11 <> 0 THEN start_ms END AS start_ms, {_OWN_END} AS end_ms
    FROM (SELECT *, epoch_us(ts) // 1000 - epoch_us(min(ts) OVER (PARTITION BY user_id)) // 1000 AS start_ms FROM events)"""


@query(f"""
WITH l AS ({_EVENT_LINES}),
n AS (SELECT *, lead(start_ms) OVER w AS next_ms, lead(1) OVER w IS NULL AS last FROM l WINDOW w AS (PARTITION BY user_id ORDER BY line_no))
SELECT user_id, CAST(line_no AS INT) AS line_no, CAST(trunc(coalesce(start_ms, 0) * 44100 / 1000) AS BIGINT) AS start_sample,
       CASE WHEN NOT last THEN CAST(trunc(coalesce(end_ms, next_ms) * 44100 / 1000) AS BIGINT) END AS end_sample FROM n""")
def intervals_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_intervals(_event_lines(spark, sf_dir), "user_id", "line_no", RATE)
    return lines.select("user_id", "line_no", "start_sample", "end_sample")


_TURN_TEXT = (
    "CASE turn % 6 WHEN 0 THEN concat('作曲：', text) WHEN 1 THEN '' WHEN 2 THEN concat(text, repeat('漢字', CAST(length(text) AS INT))) ELSE text END"
)


@query(f"""
WITH t AS (SELECT conv_id, turn, {_TURN_TEXT.replace("CAST(length(text) AS INT)", "length(text)")} AS s, turn * 4000 AS a,
                  CASE turn % 4 WHEN 3 THEN turn * 4000 - 1 WHEN 2 THEN turn * 4000 + 900 END AS b, turn % 7 <> 5 AS one FROM conversations),
c AS (SELECT *, length(regexp_replace(s, '[^\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}]+', '', 'g')) AS ja,
             length(regexp_replace(s, '[^\\x{{4E00}}-\\x{{9FFF}}]+', '', 'g')) AS zh, length(regexp_replace(s, '[^A-Za-z]+', '', 'g')) AS en FROM t),
f AS (SELECT *, one AND s <> '' AND NOT regexp_matches(s, '({"|".join(METADATA_KEYWORDS)}){_SPACE_SQL}*[：:][^\\n]') AND NOT coalesce(a > b, false) AS fits FROM c)
SELECT conv_id, turn, fits AS eligible_any, fits AND greatest(ja, zh, en) > 0 AND en > zh AND en > ja AS eligible_en FROM f""")
def eligible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN_TEXT).alias("s"), (F.col("turn") * 4000).alias("a"))
    end = F.when(F.col("turn") % 4 == 3, F.col("a") - 1).when(F.col("turn") % 4 == 2, F.col("a") + 900)
    word = F.struct(F.col("s").alias("content"), F.col("a").alias("start"), end.alias("end")).cast(WORD)
    text = line_text(F.when(F.col("turn") % 7 == 5, F.array(word, word)).otherwise(F.array(word)))
    return turns.select("conv_id", "turn", eligible(text, F.col("a"), end, None).alias("eligible_any"), eligible(text, F.col("a"), end, "en").alias("eligible_en"))


@query("""
WITH s AS (SELECT vec_id, embedding[vec_id % 70 + 1 : CASE WHEN vec_id % 3 = 0 THEN 64 ELSE vec_id % 70 + label END] AS part FROM embeddings)
SELECT vec_id, CAST(len(part) AS INT) AS n, round(coalesce(list_sum(list_transform(part, lambda x: CAST(x AS DOUBLE))), 0), 6) AS total FROM s""")
def slices_of_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    start = F.col("vec_id") % 70
    part = clip(F.col("embedding"), start, F.when(F.col("vec_id") % 3 != 0, start + F.col("label")))
    total = F.aggregate("part", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select("vec_id", part.alias("part")).select("vec_id", F.size("part").alias("n"), F.round(total, 6).alias("total"))


@query(f"""
WITH l AS ({_EVENT_LINES}), i AS (SELECT user_id, line_no, line_no AS a, CASE WHEN line_no % 2 = 0 THEN line_no + 4 END AS b FROM l WHERE line_no % 3 = 0)
SELECT i.user_id, CAST(i.line_no AS INT) AS line_no, count(*) AS n, round(sum(l.value), 4) AS total
FROM i JOIN l ON l.user_id = i.user_id AND l.line_no >= i.a AND (i.b IS NULL OR l.line_no < i.b) GROUP BY 1, 2""")
def slices_by_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _event_lines(spark, sf_dir)
    spans = lines.where("line_no % 3 = 0").select(
        "user_id", "line_no", F.col("line_no").alias("start_sample"), F.when(F.col("line_no") % 2 == 0, F.col("line_no") + 4).alias("end_sample")
    )
    rows = clip_rows(lines.select("user_id", F.col("line_no").alias("idx"), "value"), spans, "user_id", seconds=1, rate=16)
    return rows.groupBy("user_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---------------------------------------------------------------- signals


def _event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("clip_id"), "event_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("value").alias("v")
    )


_SAMPLES = "SELECT user_id AS clip_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events"
_NORMAL = (
    "SELECT clip_id, event_id, idx, CASE WHEN r < 1e-10 THEN v ELSE v * pow(10.0, (-20.0 - 20 * log10(greatest(r, 1e-10))) / 20.0) END AS v "
    "FROM (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY clip_id)) AS r FROM s)"
)


def _rms_sql(source: str, name: str, w: int = WINDOW) -> str:
    """A column rms of the source's column v, by a plain frame with the end values repeated."""
    left, right = w // 2, w - w // 2 - 1
    return (
        f"{name} AS (SELECT *, sqrt(greatest(inside + greatest({left} - idx, 0) * f * f + greatest({right} - (n - 1 - idx), 0) * l * l, 0) / {w}) AS rms FROM ("
        f"SELECT *, sum(v * v) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) AS inside, "
        "first_value(v) OVER p AS f, last_value(v) OVER p AS l, count(*) OVER (PARTITION BY clip_id) AS n "
        f"FROM {source} WINDOW p AS (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"
    )


@query(f"WITH s AS ({_SAMPLES}) SELECT clip_id, event_id, round(v, 6) AS v FROM ({_NORMAL})")
def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.normalize_loudness(_event_samples(spark, sf_dir))
    return out.select("clip_id", "event_id", F.round("v", 6).alias("v"))


def _vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.expr("vec_id div 2").alias("clip_id"), (F.col("vec_id") % 2).alias("channel"), F.posexplode("embedding").alias("idx", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


_VECTOR_SAMPLES = (
    "SELECT vec_id // 2 AS clip_id, vec_id % 2 AS channel, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
)


@query(f"SELECT clip_id, CAST(idx AS INT) AS idx, round(max(abs(v)), 9) AS peak FROM ({_VECTOR_SAMPLES}) GROUP BY 1, 2")
def peaks_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.linked_peak(_vector_samples(spark, sf_dir)).select("clip_id", "idx", F.round("peak", 9).alias("peak"))


@query(f"SELECT clip_id, CAST(idx AS INT) AS idx, round(v, 9) AS v FROM ({_VECTOR_SAMPLES}) WHERE channel = 0")
def vocal_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.first_channel(_vector_samples(spark, sf_dir)).select("clip_id", "idx", F.round("v", 9).alias("v"))


@query(f"WITH s AS ({_SAMPLES}), {_rms_sql('s', 'e')} SELECT clip_id, event_id, round(rms, 6) AS rms FROM e")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.sliding_rms(_event_samples(spark, sf_dir), WINDOW, ("clip_id",), piece=16)
    return out.select("clip_id", "event_id", F.round("rms", 6).alias("rms"))


_VIBRATO = (
    f"{_rms_sql('{0}', '{1}e')}, {{1}}d AS (SELECT clip_id, event_id, idx, v AS x, rms AS v FROM {{1}}e), {_rms_sql('{1}d', '{1}f')}, "
    "{1} AS (SELECT clip_id, event_id, idx, x / (v + 1e-10) * rms AS v FROM {1}f)"
)


@query(f"WITH s AS ({_SAMPLES}), {_VIBRATO.format('s', 'z')} SELECT clip_id, event_id, round(v, 6) AS v FROM z")
def steady_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.suppress_vibrato(_event_samples(spark, sf_dir), WINDOW, ("clip_id",), piece=16)
    return out.select("clip_id", "event_id", F.round("v", 6).alias("v"))


#: the compressor in the queries: threshold, ratio, and attack and release in samples at this rate
_COMPRESSOR = signal.Compressor(-18.0, 4.0, 10.0, 100.0, 400)
_T, _A, _R = _COMPRESSOR.threshold, _COMPRESSOR.speed(10.0), _COMPRESSOR.speed(100.0)


def _gain_sql(source: str) -> str:
    """Recursive tables g of the source's rows (clip_id, idx, v) with their gain."""
    return (
        f"x AS MATERIALIZED (SELECT clip_id, idx, v, abs(v) AS e, (CASE WHEN abs(v) > {_T!r} THEN {_T!r} + (abs(v) - {_T!r}) / 4.0 ELSE abs(v) END) / (abs(v) + 1e-10) AS t FROM {source}), "
        "g AS (SELECT clip_id, idx, v, e, CAST(1.0 AS DOUBLE) AS gain FROM x WHERE idx = 0 UNION ALL "
        f"SELECT x.clip_id, x.idx, x.v, x.e, g.gain + (CASE WHEN x.e > g.e THEN {_A!r} ELSE {_R!r} END) * (x.t - g.gain) FROM g JOIN x ON x.clip_id = g.clip_id AND x.idx = g.idx + 1)"
    )


_ONE_VECTOR = "SELECT vec_id AS clip_id, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


@query(f"WITH RECURSIVE s AS ({_ONE_VECTOR}), {_gain_sql('s')} SELECT clip_id AS vec_id, round(sum(v * gain), 6) AS total, round(max(abs(v * gain)), 6) AS peak FROM g GROUP BY 1")
def compressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", signal.compressed(F.col("embedding"), _COMPRESSOR).alias("out"))
    total = F.aggregate("out", F.lit(0.0), lambda s, x: s + x)
    return vectors.select("vec_id", F.round(total, 6).alias("total"), F.round(F.array_max(F.transform("out", F.abs)), 6).alias("peak"))


@query(f"WITH RECURSIVE s AS ({_SAMPLES}), {_gain_sql('s')} SELECT clip_id, CAST(idx AS BIGINT) AS idx, round(v * gain, 5) AS v FROM g")
def compressed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = signal.to_pieces(_event_samples(spark, sf_dir), piece=16)
    out = signal.from_pieces(signal.compress_pieces(pieces, _COMPRESSOR), piece=16)
    return out.select("clip_id", "idx", F.round("v", 5).alias("v"))


@query(f"""
WITH RECURSIVE s AS ({_SAMPLES}), n AS ({_NORMAL}), {_VIBRATO.format('n', 'z')}, {_gain_sql('z')}
SELECT clip_id, CAST(idx AS BIGINT) AS idx, round(v * gain, 5) AS v FROM g""")
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at 20 samples a second the vibrato window of 450 ms has 9 samples; 400 ms is the least
    config = signal.SignalConfig(vibrato_smooth_window_ms=450.0, compress=True, comp_attack_ms=200.0, comp_release_ms=2000.0)
    out = signal.preprocess(_event_samples(spark, sf_dir), config, rate=20, piece=32)
    return out.select("clip_id", "idx", F.round("v", 5).alias("v"))


_LINKED = (
    f"p AS ({_VECTOR_SAMPLES}), s AS (SELECT clip_id, idx, max(abs(v)) AS v FROM p GROUP BY 1, 2), {_gain_sql('s')} "
    "SELECT p.clip_id, CAST(channel AS BIGINT) AS channel, CAST(p.idx AS BIGINT) AS idx, round(p.v * gain, 6) AS v FROM p JOIN g ON p.clip_id = g.clip_id AND p.idx = g.idx"
)


@query(f"WITH RECURSIVE {_LINKED}")
def compressed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels under one gain."""
    samples = _vector_samples(spark, sf_dir).withColumn("idx", F.col("idx").cast("long"))
    out = signal.compress_linked(samples, _COMPRESSOR, piece=16)
    return out.select("clip_id", "channel", "idx", F.round("v", 6).alias("v"))


_LOUD_VECTORS = (
    "SELECT clip_id * 2 + channel AS clip_id, idx AS event_id, idx, CASE WHEN r < 1e-10 THEN v ELSE v * pow(10.0, (-20.0 - 20 * log10(greatest(r, 1e-10))) / 20.0) END AS v "
    f"FROM (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY clip_id)) AS r FROM ({_VECTOR_SAMPLES}))"
)


@query(f"""
WITH RECURSIVE n AS ({_LOUD_VECTORS}), {_VIBRATO.format('n', 'z')}, s AS (SELECT clip_id // 2 AS clip_id, idx, max(abs(v)) AS v FROM z GROUP BY 1, 2), {_gain_sql('s')}
SELECT z.clip_id // 2 AS clip_id, z.clip_id % 2 AS channel, CAST(z.idx AS BIGINT) AS idx, round(z.v * gain, 5) AS v FROM z JOIN g ON z.clip_id // 2 = g.clip_id AND z.idx = g.idx""")
def preprocessed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over two channels: loudness together, vibrato of each, one gain."""
    config = signal.SignalConfig(vibrato_smooth_window_ms=450.0, compress=True, comp_attack_ms=200.0, comp_release_ms=2000.0)
    out = signal.preprocess(_vector_samples(spark, sf_dir), config, rate=20, piece=32)
    return out.select("clip_id", "channel", "idx", F.round("v", 5).alias("v"))


@query(f"""
SELECT clip_id AS vec_id, CAST(idx AS INT) AS idx, CAST(trunc(least(greatest(v * 5, -1.0), 1.0) * 32767.0) AS SMALLINT) AS pcm FROM ({_ONE_VECTOR})""")
def pcm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    return vectors.select("vec_id", "idx", quantized(F.col("v").cast("double") * 5).alias("pcm"))


@query(f"""
SELECT clip_id, CAST(channel AS INT) AS channel, count(*) AS n, CAST(sum(CAST(trunc(least(greatest(v, -1.0), 1.0) * 32767.0) AS BIGINT)) AS BIGINT) AS total
FROM ({_VECTOR_SAMPLES}) GROUP BY 1, 2""")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.groupBy(F.expr("CAST(vec_id div 2 AS STRING)").alias("clip_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]).alias("channels")
    )
    files = encode_wav(pairs.where(F.size("channels") == 2), 8000).select(F.col("clip_id").alias("path"), "content")
    back = decode_wav(files, 8000)
    codes = F.transform("samples", lambda x: F.round(x.cast("double") * 32768).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select(F.col("clip_id").cast("long").alias("clip_id"), "channel", F.size("samples").cast("long").alias("n"), total.alias("total"))


@query(f"""
SELECT clip_id, CAST(channel AS INT) AS channel, count(*) AS n, CAST(sum(CAST(trunc(least(greatest(v, -1.0), 1.0) * 32767.0) AS BIGINT)) AS BIGINT) AS total
FROM ({_VECTOR_SAMPLES}) WHERE idx < 64 - 1 - clip_id % 5 GROUP BY 1, 2""")
def cut_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files that end in the middle of a frame: the whole frames before are read."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.groupBy(F.expr("CAST(vec_id div 2 AS STRING)").alias("clip_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]).alias("channels")
    )
    files = encode_wav(pairs.where(F.size("channels") == 2), 8000)
    kept = F.octet_length("content") - 1 - 4 * (F.col("clip_id").cast("int") % 5)  # a frame has four bytes
    back = decode_wav(files.select(F.col("clip_id").alias("path"), F.substring("content", F.lit(1), kept).alias("content")), 8000)
    codes = F.transform("samples", lambda x: F.round(x.cast("double") * 32768).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select(F.col("clip_id").cast("long").alias("clip_id"), "channel", F.size("samples").cast("long").alias("n"), total.alias("total"))


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: pairs of vectors, one behind the other, as the channels of eight files
_FILE_SAMPLES = f"SELECT clip_id % 8 AS clip_id, channel, clip_id // 8 * 64 + idx AS idx, v * 3 AS v FROM ({_VECTOR_SAMPLES}) WHERE clip_id * 2 + 1 IN (SELECT vec_id FROM embeddings)"


@query(f"""
SELECT clip_id, CAST(channel AS INT) AS channel, CAST(idx AS BIGINT) AS idx, CAST(trunc(least(greatest(v, -1.0), 1.0) * 32767.0) AS BIGINT) AS code FROM ({_FILE_SAMPLES})""")
def ranged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight WAV files of pairs of vectors, written piece by piece and read in ranges of 4,096 bytes."""
    folder = _own_folder(spark, "clips")
    whole = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("clip_id"))
    pairs = _vector_samples(spark, sf_dir).join(whole, "clip_id", "left_semi")
    samples = pairs.select((F.col("clip_id") % 8).alias("clip_id"), "channel", (F.expr("clip_id div 8") * 64 + F.col("idx")).alias("idx"), (F.col("v") * 3).alias("v"))
    write_wav(samples, folder, 8000, piece=1000)
    back = read_wav(spark, folder, 8000, range_bytes=4096)
    clip_id = F.regexp_extract("clip_id", r"([0-9]+)\.wav$", 1).cast("long")
    return back.select(clip_id.alias("clip_id"), "channel", "idx", F.round(F.col("v").cast("double") * 32768).cast("long").alias("code"))


@query("""
WITH w AS (SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS word, len(p) AS n
           FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS p FROM conversations))
SELECT conv_id, turn, CAST(i AS INT) AS word_no, word, i * (1000 + turn % 7 * 100) // n AS start_ms, (i + 1) * (1000 + turn % 7 * 100) // n AS end_ms FROM w""")
def batched_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of seven lengths, aligned in batches of like length."""
    turns = table(spark, sf_dir, "conversations")
    samples = F.transform(F.sequence(F.lit(1), (10 + F.col("turn") % 7).cast("int")), lambda x: x.cast("float"))
    clips = turns.select(F.struct("conv_id", "turn").alias("key"), samples.alias("samples"), "text", detect_lang(F.col("text")).alias("language"))
    found = aligned_batches(clips.withColumn("key", F.to_json("key")), EvenAligner, 100, 10)
    key = F.from_json("key", "struct<conv_id:bigint,turn:bigint>")
    rows = found.select(key.alias("k"), F.posexplode("words").alias("word_no", "w"))
    return rows.select("k.conv_id", "k.turn", "word_no", "w.word", "w.start_ms", "w.end_ms")


_INPUT = "00_input"


@query(f"""
WITH p AS (SELECT clip_id, channel, count(*) AS n, CAST(sum(CAST(trunc(least(greatest(v, -1.0), 1.0) * 32767.0) AS BIGINT)) AS BIGINT) AS total FROM ({_VECTOR_SAMPLES}) GROUP BY 1, 2)
SELECT stage, clip_id, CAST(channel AS INT) AS channel, n, CASE stage WHEN '00_input' THEN total END AS total
FROM p, (SELECT unnest(['00_input', '01_vocal_stem', '02_normalized', '03_vibrato_suppressed', '04_compressed']) AS stage) WHERE channel = 0 OR stage IN ('00_input', '01_vocal_stem')""")
def tapped_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of word timing as WAV files, read back: how long each channel of each clip is, and the sum of the input's codes."""
    folder = _own_folder(spark, "taps")
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    word = F.struct(F.col("text").alias("content"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end")).cast(WORD)
    lines = turns.select(
        F.col("conv_id").cast("string").alias("song_id"), F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
        F.array(word).alias("content"), F.array().cast(f"array<array<{WORD}>>").alias("reference_lines"),
    )
    mix = _vector_samples(spark, sf_dir).select(F.col("clip_id").cast("string").alias("song_id"), "channel", F.col("idx").cast("long").alias("idx"), "v")
    word_timing(lines, mix, EvenAligner, config=signal.SignalConfig(compress=True), rate=_SONG_RATE, make_separator=WholeMixAsVocals, audio_folder=folder)
    # a clip's path names its stage
    back = read_wav(spark, folder, _SONG_RATE).groupBy(F.col("clip_id").alias("path"), "channel")
    sums = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("v").cast("double") * 32768).cast("long")).alias("total"))
    stage = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    clip_id = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("long")
    return sums.select(stage.alias("stage"), clip_id.alias("clip_id"), "channel", "n", F.when(stage == _INPUT, F.col("total")).alias("total"))


# ---------------------------------------------------------------- alignment

_WORDS_SQL = """
SELECT event_id, CAST(i AS INT) AS word_no, concat(event_type, i) AS word,
       {a} AS start_ms, {b} AS end_ms
FROM (SELECT event_id, event_type, value, unnest(range(3)) AS i FROM events)"""


def _words(bodies: DataFrame, words: Column) -> DataFrame:
    rows = bodies.select("event_id", F.posexplode(words).alias("word_no", "w"))
    return rows.select("event_id", "word_no", "w.word", "w.start_ms", "w.end_ms")


@query(_WORDS_SQL.format(a="CAST(trunc((value + i) * 1e3) AS BIGINT)", b="CAST(trunc((value + i + 0.7) * 1e3) AS BIGINT)"))
def service_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.struct(F.concat("event_type", i.cast("string")).alias("text"), (F.col("value") + i).alias("start_time"), (F.col("value") + i + 0.7).alias("end_time"))
    body = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), word).alias("words")))
    bodies = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return _words(bodies, service_words(F.col("body")))


@query(_WORDS_SQL.format(
    a="CASE WHEN (event_id + i) % 4 <> 0 THEN CAST(trunc((value + i) * 1e3) AS BIGINT) END",
    b="CASE WHEN (event_id + i) % 4 <> 0 THEN CAST(trunc((value + i + 0.7) * 1e3) AS BIGINT) END",
))
def case_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def word(i: Column) -> Column:
        found = (F.col("event_id") + i) % 4 != 0
        return F.struct(
            F.concat("event_type", i.cast("string")).alias("word"), F.when(found, "success").otherwise("not-found-in-audio").alias("case"),
            F.when(found, F.col("value") + i).alias("start"), F.when(found, F.col("value") + i + 0.7).alias("end"),
        )

    body = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), word).alias("words")))
    bodies = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return _words(bodies, case_words(F.col("body")))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS item, concat('clip', turn) AS audio, text,
       CASE WHEN conv_id % 2 = 0 THEN 'Chinese' ELSE role END AS language FROM conversations""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    songs = turns.groupBy("conv_id").agg(ordered.alias("t"))
    languages = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("Chinese"))).otherwise(F.transform("t", lambda r: r["role"]))
    request = batch_request(F.transform("t", lambda r: F.concat(F.lit("clip"), r["turn"].cast("string"))), F.transform("t", lambda r: r["text"]), languages)
    return songs.select("conv_id", F.posexplode(request).alias("item", "r")).select("conv_id", "item", "r.audio", "r.text", "r.language")


def _timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of 5 seconds and the words a poor aligner would give: some missed, some wrong."""
    turns = table(spark, sf_dir, "conversations")
    start = F.when(F.col("turn") % 5 != 4, F.col("turn") * 5000)
    end = F.when(F.col("turn") % 2 == 0, F.col("turn") * 5000 + 4500)
    word = F.struct(F.col("text").alias("content"), start.alias("start"), end.alias("end")).cast(WORD)
    lines = turns.select("conv_id", "turn", "text", start.alias("start_ms"), end.alias("end_ms"), F.array(word).alias("content"))

    def worse(w: Column, i: Column) -> Column:
        times = [F.when((F.col("turn") + i) % 7 != 3, w[t]).alias(t) for t in ("start_ms", "end_ms")]
        return F.struct(F.when((F.col("turn") + i) % 5 == 1, F.lit("#")).otherwise(w["word"]).alias("word"), *times)

    words = F.transform(even_words(F.col("text"), F.lit(4000)), worse).cast(f"array<{ALIGNED_WORD}>")
    return lines.withColumn("words", words)


_FOLD_WORDS = """
WITH RECURSIVE l AS (
    SELECT conv_id, turn, text, CASE WHEN turn % 5 <> 4 THEN turn * 5000 END AS start_ms, CASE WHEN turn % 2 = 0 THEN turn * 5000 + 4500 END AS end_ms,
           list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations),
w AS (SELECT conv_id, turn, i, CASE WHEN (turn + i) % 5 = 1 THEN '#' ELSE ws[i + 1] END AS word,
             CASE WHEN (turn + i) % 7 <> 3 THEN i * 4000 // len(ws) + coalesce(start_ms, 0) END AS a,
             CASE WHEN (turn + i) % 7 <> 3 THEN (i + 1) * 4000 // len(ws) + coalesce(start_ms, 0) END AS b
      FROM (SELECT *, unnest(range(len(ws))) AS i FROM l)),"""
#: the fold of the words w into the lines l; what comes of it is in z
_FOLD_LINES = """
f AS (
    SELECT conv_id, turn, text, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS prev, CAST('' AS VARCHAR) AS out FROM l
    UNION ALL
    SELECT f.conv_id, f.turn, f.text, f.i + 1,
           CASE WHEN hit THEN pos + gap + length(word) ELSE pos END, CASE WHEN hit THEN b ELSE prev END,
           CASE WHEN hit THEN out || CASE WHEN gap > 0 THEN coalesce(CAST(prev AS VARCHAR), '-') || ',' || a || ',' || substr(f.text, pos + 1, gap) || ';' ELSE '' END
                              || a || ',' || b || ',' || word || ';' ELSE out END
    FROM (SELECT f.*, w.word, w.a, w.b, instr(substr(f.text, pos + 1), w.word) - 1 AS gap,
                 w.a IS NOT NULL AND instr(substr(f.text, pos + 1), w.word) > 0 AS hit
          FROM f JOIN w ON w.conv_id = f.conv_id AND w.turn = f.turn AND w.i = f.i) f),
e AS (SELECT f.*, l.end_ms FROM f JOIN l ON l.conv_id = f.conv_id AND l.turn = f.turn WHERE f.i = len(l.ws)),
t AS (SELECT *, substr(text, pos + 1) AS tail FROM e),
z AS (SELECT conv_id, turn,
       CASE WHEN length(tail) > 0 THEN out || coalesce(CAST(prev AS VARCHAR), '-') || ',-,' || tail || ';'
            WHEN prev IS NULL THEN out ELSE regexp_replace(out, '^((?:.|\\n)*),' || prev || ',((?:.|\\n)*?)$', '\\1,-,\\2') END AS words,
       CASE WHEN length(tail) > 0 OR prev IS NULL THEN end_ms ELSE prev END AS end_ms FROM t)"""
_FOLD = f"{_FOLD_WORDS}{_FOLD_LINES} SELECT * FROM z"


def _shown(content: Column) -> Column:
    """start,end,content; of each word, - for null."""
    time = lambda w, k: F.coalesce(w[k].cast("string"), F.lit("-"))
    return F.array_join(F.transform(content, lambda w: F.concat(time(w, "start"), F.lit(","), time(w, "end"), F.lit(","), w["content"], F.lit(";"))), "")


@query(_FOLD)
def assembled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table is a small file, one task, and the fold is long
    lines = with_words(_timed_turns(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), F.col("words"))
    return lines.select("conv_id", "turn", _shown(F.col("content")).alias("words"), "end_ms")


#: samples a second of the vectors that stand for songs
_SONG_RATE = 4
_SONG_LINES = "CASE WHEN turn % 6 = 5 THEN concat('作曲：', text) ELSE text END"


@query(f"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, {_SONG_LINES} AS text, CASE WHEN turn % 5 <> 4 THEN turn * 4000 END AS start_ms,
           CASE WHEN turn % 4 = 2 THEN turn * 4000 + 3000 WHEN turn % 8 = 3 THEN turn * 4000 END AS end_ms FROM conversations),
n AS (SELECT *, lead(start_ms) OVER o AS next_ms, lead(1) OVER o IS NULL AS last FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, CAST(trunc(coalesce(start_ms, 0) * {_SONG_RATE} / 1000) AS BIGINT) AS p, CASE WHEN NOT last THEN CAST(trunc(coalesce(end_ms, next_ms) * {_SONG_RATE} / 1000) AS BIGINT) END AS q FROM n),
k AS (SELECT *, conv_id IN (SELECT vec_id // 2 FROM embeddings WHERE vec_id % 2 = 0) AND turn % 6 <> 5 AND (q IS NULL OR p <= q) AS chosen FROM i),
l AS (SELECT *, greatest(least(coalesce(q, 64), 64) - least(p, 64), 0) * 1000 // {_SONG_RATE} AS ms, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM k WHERE chosen),
w AS (SELECT conv_id, turn, i, ws[i + 1] AS word, i * ms // len(ws) + coalesce(start_ms, 0) AS a, (i + 1) * ms // len(ws) + coalesce(start_ms, 0) AS b
      FROM (SELECT *, unnest(range(len(ws))) AS i FROM l)),{_FOLD_LINES}
SELECT conv_id, turn, words, end_ms FROM z UNION ALL
SELECT conv_id, turn, coalesce(CAST(start_ms AS VARCHAR), '-') || ',' || coalesce(CAST(end_ms AS VARCHAR), '-') || ',' || text || ';', end_ms FROM k WHERE NOT chosen""")
def word_timed_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: conversations are songs and turns their lines, pairs of vectors their two channels; stand-ins separate and align."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SONG_LINES).alias("text"))
    start = F.when(F.col("turn") % 5 != 4, F.col("turn") * 4000)
    end = F.when(F.col("turn") % 4 == 2, F.col("turn") * 4000 + 3000).when(F.col("turn") % 8 == 3, F.col("turn") * 4000)
    word = F.struct(F.col("text").alias("content"), start.alias("start"), end.alias("end")).cast(WORD)
    lines = turns.select(
        F.col("conv_id").cast("string").alias("song_id"), F.col("turn").cast("int").alias("line_no"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
        F.array(word).alias("content"), F.array().cast(f"array<array<{WORD}>>").alias("reference_lines"),
    )
    mix = _vector_samples(spark, sf_dir).select(F.col("clip_id").cast("string").alias("song_id"), "channel", F.col("idx").cast("long").alias("idx"), "v")
    timed = word_timing(lines, mix, EvenAligner, config=signal.SignalConfig(compress=True), rate=_SONG_RATE, make_separator=WholeMixAsVocals)
    return timed.select(F.col("song_id").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("turn"), _shown(F.col("content")).alias("words"), "end_ms")


# ---------------------------------------------------------------- lyric files

_PLAIN = "regexp_replace(text, '[<>:\\\\s\\\\[\\\\]]+', ' ')"
_PLAIN_SQL = "regexp_replace(text, '[<>:\\s\\[\\]]+', ' ', 'g')"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lyric file of each conversation: two metadata lines, a line a turn, in falling order, with every feature of the grammar."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_PLAIN).alias("s"))
    at = (F.col("turn") * 10_000).cast("long")
    tag = lambda ms: ms_tag(F.col("turn").cast("long") * 10_000 + ms)
    body = (
        F.when(F.col("turn") % 4 == 1, F.concat(tag(0), tag(3000), F.col("s")))
        .when(F.col("turn") % 4 == 2, F.concat(tag(0), F.col("s"), F.lit("<"), F.substring(tag(500), 2, 9), F.lit(">"), F.lit("two"), tag(900)))
        .when(F.col("turn") % 4 == 3, F.concat(tag(0), F.col("s"), F.lit("\n"), tag(0), F.lit("same start"), F.lit("\n\nloose")))
        .otherwise(F.concat(ms_tag(at), F.col("s")))
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn"), body.alias("line"))), asc=False)
    songs = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("text"))
    head = F.concat(F.lit("[ti:Song "), F.col("conv_id").cast("string"), F.lit("]\n[offset:0]\n\n"))
    return songs.select(F.col("conv_id").cast("string").alias("song_id"), F.concat(head, "text").alias("value"))


_PARSED = f"""
WITH t AS (SELECT conv_id, turn, {_PLAIN_SQL} AS s FROM conversations),
l AS (SELECT conv_id, turn, s, turn * 10000 AS a, CASE WHEN turn % 4 = 2 THEN turn * 10000 + 900 END AS own FROM t
      UNION ALL SELECT conv_id, turn, s, turn * 10000 + 3000, NULL FROM t WHERE turn % 4 = 1),
o AS (SELECT *, row_number() OVER w - 1 AS line_no, coalesce(own, lead(a) OVER w) AS b FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY a))
SELECT CAST(conv_id AS VARCHAR) AS song_id, CAST(line_no AS INT) AS line_no, a AS start_ms, b AS end_ms,
       CASE WHEN turn % 4 = 2 THEN a || ',' || (a + 500) || ',' || s || ';' || (a + 500) || ',' || b || ',two;'
            ELSE a || ',' || coalesce(CAST(b AS VARCHAR), '-') || ',' || s || ';' END AS words,
       CASE WHEN turn % 4 = 3 THEN 'same start|loose' ELSE '' END AS refs FROM o"""


def _shown_lines(lines: DataFrame) -> DataFrame:
    refs = F.array_join(F.transform("reference_lines", lambda r: F.array_join(F.transform(r, lambda w: w["content"]), "")), "|")
    return lines.select("song_id", "line_no", "start_ms", "end_ms", _shown(F.col("content")).alias("words"), refs.alias("refs"))


@query(_PARSED)
def parsed_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_lines(parse_lrc(_files(spark, sf_dir)))


@query("SELECT CAST(conv_id AS VARCHAR) AS song_id, concat('Song ', conv_id) AS title, '0' AS shift, CAST(2 AS INT) AS n FROM conversations GROUP BY conv_id")
def lyric_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = song_metadata(_files(spark, sf_dir))
    return meta.select("song_id", F.col("metadata")["ti"].alias("title"), F.col("metadata")["offset"].alias("shift"), F.size("metadata").alias("n"))


@query(_PARSED)
def rendered_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text and read again; the open last line stays open."""
    return _shown_lines(parse_lrc(render_lrc(parse_lrc(_files(spark, sf_dir)))))


@query(_PARSED)
def lyrics_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as JSON and read again."""
    songs = _files(spark, sf_dir)
    return _shown_lines(lines_of_json(song_json(parse_lrc(songs), song_metadata(songs))))


_ODD = f"""
WITH t AS (SELECT conv_id, turn, {_PLAIN_SQL} AS s, turn * 10000 + CAST(rpad(substr('1234567', 1, CAST(turn % 6 + 1 AS INT)), 3, '0')[1:3] AS BIGINT) AS a FROM conversations),
o AS (SELECT *, row_number() OVER w - 1 AS line_no, lead(a) OVER w AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY a))
SELECT CAST(conv_id AS VARCHAR) AS song_id, CAST(line_no AS INT) AS line_no, a AS start_ms, b AS end_ms,
       a || ',' || coalesce(CAST(b AS VARCHAR), '-') || ',' || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'two  blanks   and ' || s ELSE s END || ';' AS words, '' AS refs FROM o"""


def _odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lyric file of each conversation with fractions of one to six digits, lines without text and runs of blanks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_PLAIN).alias("s"))
    fraction = F.substring(F.lit("1234567"), F.lit(1), (F.col("turn") % 6 + 1).cast("int"))
    tag = F.concat(F.substring(ms_tag(F.col("turn").cast("long") * 10_000), 1, 7), fraction, F.lit("]"))
    body = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.concat(F.lit("two  blanks   and "), "s")).otherwise(F.col("s"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat(tag, body).alias("line"))))
    songs = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\r\n\n").alias("value"))
    return songs.select(F.col("conv_id").cast("string").alias("song_id"), "value")


@query(_ODD)
def odd_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_lines(parse_lrc(_odd_files(spark, sf_dir)))


@query(_ODD)
def lyric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from text files, one a song."""
    folder = _own_folder(spark, "lyrics")
    write_lyrics(_odd_files(spark, sf_dir), folder, ".lrc")
    songs = read_lrc(spark, f"{folder}/*.lrc").withColumn("song_id", F.regexp_extract("song_id", r"([0-9]+)\.lrc$", 1))
    return _shown_lines(parse_lrc(songs))


@query(_PARSED)
def written_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs parsed, written as one .kara.lrc file each, and read again."""
    folder = _own_folder(spark, "kara")
    write_lyrics(render_lrc(parse_lrc(_files(spark, sf_dir))), folder)
    songs = read_lrc(spark, f"{folder}/*.kara.lrc").withColumn("song_id", F.regexp_extract("song_id", r"([0-9]+)\.kara\.lrc$", 1))
    return _shown_lines(parse_lrc(songs))


#: a phrase in front of each line, whose characters an encoding has, and the encoding
_SCRIPTS = (("これは日本語の歌です", "shift_jis"), ("这是一首中文的歌", "gb18030"), ("ünï cödé 漢字", "utf-8"), ("ünï かな", "utf-16"))
_SCRIPT = "CASE conv_id % 4 " + " ".join(f"WHEN {i} THEN '{text}'" for i, (text, _) in enumerate(_SCRIPTS)) + " END"
_ASCII = "regexp_replace({0}, '[^ -~]+', ''{1})"


@query(f"""
WITH t AS (SELECT conv_id, turn * 1000 AS a, {_SCRIPT} || ' ' || {_ASCII.format(_PLAIN_SQL, ", 'g'")} AS s FROM conversations),
o AS (SELECT *, row_number() OVER w - 1 AS line_no, lead(a) OVER w AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY a))
SELECT CAST(conv_id AS VARCHAR) AS song_id, CAST(line_no AS INT) AS line_no, a AS start_ms, b AS end_ms, a || ',' || coalesce(CAST(b AS VARCHAR), '-') || ',' || s || ';' AS words, '' AS refs FROM o""")
def encoded_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyric files in four encodings, told apart file by file."""
    folder = _own_folder(spark, "encoded")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"{_SCRIPT} || ' ' || {_ASCII.format(_PLAIN, '')}").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat(ms_tag(F.col("turn").cast("long") * 1000), "s").alias("line"))))
    songs = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("value"))
    for i, (_, encoding) in enumerate(_SCRIPTS):
        write_lyrics(songs.where(F.col("conv_id") % 4 == i).select(F.col("conv_id").alias("song_id"), "value"), f"{folder}/{i}", ".lrc", encoding=encoding)
    read = read_lrc_any(spark, f"{folder}/*/*.lrc").withColumn("song_id", F.regexp_extract("song_id", r"([0-9]+)\.lrc$", 1))
    return _shown_lines(parse_lrc(read))
