"""Script detection, credits and units against plain Python."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lyrebird.functions import text, units

CASES = ["", "123 !?", "・", "ー", "ｶﾅ", "㐀", "é", "Ａ", "漢あ", "あ漢a", "漢a", "あa", "漢漢a", "hello", "日本語の歌", "纯中文", "あ😀b c", "漢字kana", None]


def lang(s: str) -> str | None:
    n = {
        "ja": sum(0x3040 <= ord(c) <= 0x30FF for c in s),
        "zh": sum(0x4E00 <= ord(c) <= 0x9FFF for c in s),
        "en": sum(c.isascii() and c.isalpha() for c in s),
    }
    best = max(n, key=n.get)
    return best if n[best] else None


def test_detect_lang(spark):
    got = spark.createDataFrame([(c,) for c in CASES], "s string").select("s", text.detect_lang(F.col("s")).alias("l")).collect()
    for row in got:
        assert row.l == (lang(row.s) if row.s is not None else None), row.s


@pytest.mark.parametrize("space", ["", " ", "　", "\x1c", "\x85", "\xa0", "\t"])
@pytest.mark.parametrize("colon", [":", "：", ""])
@pytest.mark.parametrize("after", ["x", "", "\n", "\r", " ", "\nx"])
def test_metadata_lines(spark, space, colon, after):
    pattern = re.compile(f"({'|'.join(text.METADATA_KEYWORDS)})\\s*[：:].+")
    lines = [f"{k}{space}{colon}{after}" for k in ("作词", "呗", "OP", "STOP", "op", "x")]
    rows = spark.createDataFrame([(c,) for c in lines], "s string").select("s", text.is_metadata_line(F.col("s")).alias("m")).collect()
    assert {r.s: r.m for r in rows} == {c: bool(pattern.search(c)) for c in lines}


def test_keywords():
    assert len(text.METADATA_KEYWORDS) == len(set(text.METADATA_KEYWORDS)) == 28


def test_units(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400_000), rng.random() * 1000) for _ in range(2000)] + [(0, 1.001), (399_999, 0.0015)]
    got = spark.createDataFrame(rows, "n long, t double").select(
        "n", "t", units.ms_to_sample(F.col("n")).alias("a"), units.sample_to_ms(F.col("n")).alias("b"), units.seconds_to_ms(F.col("t")).alias("c"),
        units.round4(F.col("t")).alias("d"),
    ).collect()
    for r in got:
        assert (r.a, r.b, r.c, r.d) == (int(r.n * 44100 / 1000), int(r.n / 44100 * 1000), int(r.t * 1e3), round(r.t, 4))


def test_decibels_and_job_ids(spark):
    row = spark.range(1).select(
        units.db_to_linear(F.lit(-20.0)).alias("a"), units.linear_to_db(F.lit(0.0)).alias("b"), units.linear_to_db(F.lit(-0.5)).alias("c"),
        units.job_id(F.lit("http://h/x/abc//")).alias("d"),
    ).first()
    assert math.isclose(row.a, 0.1) and math.isclose(row.b, -200) and math.isclose(row.c, 20 * math.log10(0.5)) and row.d == "abc"


def test_wall_ms_ignores_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-02-29 23:59:59.999999' AS t")
    expected = 1709251199999
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.select(units.wall_ms(F.col("t")).alias("m")).first().m == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
