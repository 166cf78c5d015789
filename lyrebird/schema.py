"""Types of timed text and audio tables.

Rows have no order of their own, so every table has an ordinal: line_no, raw_no,
idx.  Times are whole milliseconds.
"""

from __future__ import annotations

WORD = "struct<content:string,start:bigint,end:bigint>"
ALIGNED_WORD = "struct<word:string,start_ms:bigint,end_ms:bigint>"
LINES = f"song_id string, line_no int, start_ms bigint, end_ms bigint, content array<{WORD}>, reference_lines array<array<{WORD}>>"
SONG_JSON = f"lines array<struct<start:bigint,end:bigint,content:array<{WORD}>,reference_lines:array<array<{WORD}>>>>, metadata map<string,string>"
AUDIO = "clip_id string, stem string, channel int, sample_rate int, samples array<float>"
