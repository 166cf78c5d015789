"""Classification of lyric lines by script and by metadata keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of credit lines.
METADATA_KEYWORDS = (
    "作词", "作曲", "编曲", "演唱", "专辑", "歌手", "制作人", "和声", "混音", "录音", "监制", "策划", "封面设计", "文案",
    "出品", "OP", "SP", "翻译", "PV", "母带", "调教", "调校", "曲绘", "原曲", "編曲", "作詞", "唄", "呗",
)

#: characters of each script, as regular expression classes
SCRIPTS = {"ja": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}", "zh": r"\x{4E00}-\x{9FFF}", "en": "A-Za-z"}

#: Unicode white space, spelled out: engines differ in what \s takes in
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
METADATA_PATTERN = f"({'|'.join(METADATA_KEYWORDS)}){SPACE}*[：:][^\\n]"


def script_count(text: Column, script: str) -> Column:
    """Code points of a script in a text."""
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]+", ""))


def detect_lang(text: Column) -> Column:
    """The script with most code points, ja before zh before en on a tie; null if there are none."""
    ja, zh, en = (script_count(text, s) for s in ("ja", "zh", "en"))
    return (
        F.when(F.greatest(ja, zh, en) == 0, F.lit(None))
        .when((ja >= zh) & (ja >= en), F.lit("ja"))
        .when(zh >= en, F.lit("zh"))
        .when(en > 0, F.lit("en"))
    )


def is_metadata_line(text: Column) -> Column:
    """Whether a credit keyword, a colon and one more character of the same line stand anywhere in the text."""
    return text.rlike(METADATA_PATTERN)
