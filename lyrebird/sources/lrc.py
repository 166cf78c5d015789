"""Timed lyrics: text files to lines with words, and lines to text or JSON.

[mm:ss.f] in front of a line is its start, several repeat it; a tag at its end is
its end; tags within, in [] or <>, part its words.  A line without tags is a
reference line of the one before, and so is a line that starts with an earlier
line.  Fractions have one to six digits, of which three count.  A line ends where
the next one starts; the last one is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.schema import SONG_JSON, WORD

_TIME = r"\d+:\d{1,2}(?:[.:]\d{1,6})?"
_LEADING = rf"^\s*((?:\[{_TIME}\])+)"
_INNER = rf"[\[<]{_TIME}[\]>]"
_META = r"^\s*\[([A-Za-z][^:\]]*):([^\]]*)\]\s*$"


def read_lrc(spark: SparkSession, path: str) -> DataFrame:
    """song_id (the file's path) and value (its text, read as UTF-8)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("song_id"), "value")


#: encodings that texts without a mark are tried in, besides UTF-8
ENCODINGS = ("gb18030", "shift_jis")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _likeliness(text: str, encoding: str) -> float:
    """How common the characters beyond ASCII are for an encoding, from -1 to 1."""
    table, total, n = ("gb2312", (0xB0, 0xD7)) if encoding == "gb18030" else ("shift_jis", (0x88, 0x97)), 0.0, 0
    for c in text:
        if c < "\x80":
            continue
        n += 1
        try:
            code = c.encode(table[0])
        except UnicodeEncodeError:
            total -= 1
            continue
        if len(code) == 1:  # half-width kana, rare in Japanese and frequent in other texts read as such
            total -= 0.5
        elif code[0] < table[1][0] or code[0] <= table[1][1]:
            total += 1  # marks, kana, and the more frequent half of the ideographs
        else:
            total += 0.2
    return total / n if n else 0.0


def decoded(data: bytes) -> str:
    """The text of a lyric file of unknown encoding.

    A byte-order mark decides, and goes; else UTF-8 where it is valid; else UTF-16
    where bytes of one parity are often zero; else the one of ENCODINGS that can read
    it and whose characters are likelier, the first of equal ones.  What none can read
    is UTF-8 with replacement characters.
    """
    for mark, encoding in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    zeros = [data[k::2].count(0) * 4 > len(data) for k in (0, 1)]
    if len(data) % 2 == 0 and zeros[0] != zeros[1]:
        return data.decode("utf-16-le" if zeros[1] else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    read = []
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        read.append((_likeliness(text, encoding), text))
    return max(read, key=lambda r: r[0])[1] if read else data.decode("utf-8", "replace")


def read_lrc_any(spark: SparkSession, path: str) -> DataFrame:
    """song_id (the file's path) and value (its text) of files each in an encoding of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(x.as_buffer().to_pybytes()) for x in batch["content"]]
            yield pa.record_batch([batch["path"], pa.array(texts, pa.string())], ["song_id", "value"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "song_id string, value string")


def tag_ms(tag: Column) -> Column:
    """Milliseconds of a tag with or without its brackets."""
    part = lambda i: F.regexp_extract(tag, r"(\d+):(\d{1,2})(?:[.:](\d{1,6}))?", i)
    return part(1).cast("long") * 60000 + part(2).cast("long") * 1000 + F.substring(F.rpad(part(3), 3, "0"), 1, 3).cast("long")


def raw_lines(songs: DataFrame) -> DataFrame:
    """song_id, raw_no, raw of the lines that are not blank."""
    return songs.select("song_id", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("raw_no", "raw")).where(F.trim("raw") != "")


def song_metadata(songs: DataFrame) -> DataFrame:
    """song_id, metadata: a map of text to text, the last of equal keys."""
    rows = raw_lines(songs).where(F.col("raw").rlike(_META)).select(
        "song_id", "raw_no", F.regexp_extract("raw", _META, 1).alias("key"), F.regexp_extract("raw", _META, 2).alias("value")
    )
    last = rows.groupBy("song_id", "key").agg(F.max_by("value", "raw_no").alias("value"))
    return last.groupBy("song_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def parse_lrc(songs: DataFrame) -> DataFrame:
    """song_id, line_no, start_ms, end_ms, content, reference_lines of songs (song_id, value).

    Lines of equal start are ordered as in the file; a line before any tagged one
    is dropped; a song of no tagged line has no rows.  A song is one group.
    """
    raw = raw_lines(songs).where(~F.col("raw").rlike(_META))
    leading = F.regexp_extract("raw", _LEADING, 1)
    raw = raw.withColumn("leading", leading).withColumn("tagged", leading != "")
    raw = raw.withColumn("body", F.when(F.col("tagged"), F.regexp_replace("raw", _LEADING, "")).otherwise(F.col("raw")))
    raw = raw.withColumn("tags", F.transform(F.regexp_extract_all("body", F.lit(f"({_INNER})")), tag_ms))
    raw = raw.withColumn("texts", F.split("body", _INNER, -1))
    closed = (F.size("tags") > 0) & (F.element_at("texts", -1) == "")
    raw = raw.withColumn("own_end", F.when(closed, F.element_at("tags", -1)))
    raw = raw.withColumn("texts", F.when(closed, F.slice("texts", 1, F.size("texts") - 1)).otherwise(F.col("texts")))

    own = F.array_distinct(F.transform(F.regexp_extract_all("leading", F.lit(rf"(\[{_TIME}\])")), tag_ms))
    # a line without tags goes where the last tagged one before it goes; all is dealt out by song once
    so_far = Window.partitionBy("song_id").orderBy("raw_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.last(F.when(F.col("tagged"), own), ignorenulls=True).over(so_far)
    timed = raw.select("song_id", "raw_no", "own_end", "texts", "tags", starts.alias("starts")).withColumn("start_ms", F.explode("starts"))
    found = F.array_sort(F.collect_list(F.struct("raw_no", "own_end", "texts", "tags")))
    lines = timed.groupBy("song_id", "start_ms").agg(found.alias("found"))

    order = Window.partitionBy("song_id").orderBy("start_ms")
    lines = lines.withColumn("main", F.col("found")[0]).withColumn("line_no", F.row_number().over(order) - 1)
    lines = lines.withColumn("end_ms", F.coalesce("main.own_end", F.lead("start_ms").over(order)))
    texts, tags, none = F.col("main.texts"), F.col("main.tags"), F.lit(None).cast("long")
    begin = F.concat(F.array("start_ms"), tags)
    words = F.transform(
        texts, lambda t, i: F.struct(t.alias("content"), F.get(begin, i).alias("start"), F.when(i + 1 < F.size(texts), F.get(begin, i + 1)).otherwise(F.col("end_ms")).alias("end"))
    ).cast(f"array<{WORD}>")
    # an empty piece in front of the first inner tag is no word
    words = F.when(F.size(texts) > 1, F.filter(words, lambda w, i: (i > 0) | (w["content"] != ""))).otherwise(words)
    plain = lambda ref: F.transform(ref["texts"], lambda t: F.struct(t.alias("content"), none.alias("start"), none.alias("end")))
    refs = F.transform(F.slice("found", 2, F.size("found")), plain).cast(f"array<array<{WORD}>>")
    return lines.select("song_id", F.col("line_no").cast("int").alias("line_no"), "start_ms", "end_ms", words.alias("content"), refs.alias("reference_lines"))


def ms_tag(ms: Column, left: str = "[", right: str = "]") -> Column:
    """[mm:ss.fff] of milliseconds; nothing for null."""
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    minutes, rest = F.floor(ms / 60000), ms % 60000
    tag = F.concat(F.lit(left), two(minutes), F.lit(":"), two(F.floor(rest / 1000)), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit(right))
    return F.coalesce(tag, F.lit(""))


def render_line(start: Column, end: Column, content: Column, bracket: bool = True) -> Column:
    """One line of text: its start, its words with tags between them, and its end if it has one and any text."""
    left, right = ("[", "]") if bracket else ("<", ">")
    word = F.transform(content, lambda w, i: F.concat(F.when(i > 0, ms_tag(w["start"], left, right)).otherwise(F.lit("")), w["content"]))
    text = F.array_join(word, "")
    return F.concat(ms_tag(start), text, F.when(text != "", ms_tag(end, left, right)).otherwise(F.lit("")))


def render_lrc(lines: DataFrame, bracket: bool = True) -> DataFrame:
    """song_id, value: the text of each song, its reference lines below their lines without tags."""
    refs = F.transform("reference_lines", lambda r: F.array_join(F.transform(r, lambda w: w["content"]), ""))
    text = F.concat_ws("\n", render_line(F.coalesce("start_ms", F.lit(0)), F.col("end_ms"), F.col("content"), bracket), refs)
    rows = lines.select("song_id", "line_no", text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return rows.groupBy("song_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("value"))


def song_json(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """song_id, value: each song as JSON with lines and metadata, nulls written."""
    line = F.struct("line_no", F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "content", "reference_lines").alias("line"))
    songs = lines.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"]).alias("lines"))
    if metadata is None:
        songs = songs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    else:
        songs = songs.join(metadata, "song_id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return songs.select("song_id", F.to_json(F.struct("lines", "metadata"), {"ignoreNullFields": "false"}).alias("value"))


def lines_of_json(songs: DataFrame) -> DataFrame:
    """The lines of songs (song_id, value as song_json writes it)."""
    lines = F.posexplode(F.from_json("value", f"struct<{SONG_JSON.replace('lines array', 'lines:array').replace('metadata map', 'metadata:map')}>")["lines"])
    rows = songs.select("song_id", lines.alias("line_no", "line"))
    return rows.select("song_id", "line_no", F.col("line.start").alias("start_ms"), F.col("line.end").alias("end_ms"), "line.content", "line.reference_lines")
