"""Words of a line from its text and the aligner's words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions.columns import once

_WORD = "struct<content:string,start:bigint,end:bigint>"


def assembled(text: Column, words: Column, base: Column) -> Column:
    """array of words (content, start, end) of a line.

    words (word, start_ms, end_ms) are looked for in the text one after the
    other.  A word without times, or not found behind the one before, is passed
    over.  Text between found words becomes a word from the end before to the
    start after; text behind the last one has no end.  Without found words the
    whole text is one word without times.  Times are moved by base.
    """
    nothing, zero = F.lit(None).cast("long"), F.lit(0)

    def word(content: Column, start: Column, end: Column) -> Column:
        return F.struct(content.alias("content"), start.cast("long").alias("start"), end.cast("long").alias("end")).cast(_WORD)

    def step(state: Column, item: Column) -> Column:
        """The cursor, and of each word its place from 1, or 0; no text is built here."""
        known = item["start_ms"].isNotNull() & item["end_ms"].isNotNull() & item["word"].isNotNull()
        cursor = state["cursor"]
        place = F.when(known, F.when(item["word"] == "", cursor).otherwise(F.call_function("locate", item["word"], text, cursor))).otherwise(zero)
        behind = lambda at: F.when(at > 0, at + F.length(item["word"])).otherwise(cursor)
        return once(place, lambda at: F.struct(behind(at).cast("int").alias("cursor"), F.concat(state["places"], F.array(at)).alias("places")))

    def build(found: Column) -> Column:
        """found: word, start, end, at and behind (where the text goes on) of the words in the text, in order."""
        before = lambda i, k: F.when(i > 0, F.get(found, i - 1)[k])
        gap = lambda h, i: F.substr(text, F.coalesce(before(i, "behind"), F.lit(1)), h["at"] - F.coalesce(before(i, "behind"), F.lit(1)))
        pieces = F.flatten(F.transform(found, lambda h, i: F.array(word(gap(h, i), before(i, "end"), h["start"]), word(h["word"], h["start"], h["end"]))))
        last = F.get(found, F.size(found) - 1)
        tail = word(F.substr(text, F.coalesce(last["behind"], F.lit(1))), last["end"], nothing)
        # gaps stand at even places, the tail at the end; empty ones are none
        return F.filter(F.concat(pieces, F.array(tail)), lambda w, i: (i % 2 == 1) | (w["content"] != ""))

    def finish(state: Column) -> Column:
        at = lambda i: F.get(state["places"], i)
        hit = lambda w, i: F.struct(
            w["word"].alias("word"), (w["start_ms"] + base).alias("start"), (w["end_ms"] + base).alias("end"), at(i).alias("at"), (at(i) + F.length(w["word"])).alias("behind")
        )
        return once(F.filter(F.transform(words, hit), lambda h: h["at"] > 0), build)

    start = F.struct(F.lit(1).cast("int").alias("cursor"), F.array().cast("array<int>").alias("places"))
    return F.aggregate(words, start, step, finish)


def moved_end(words: Column, line_end: Column) -> tuple[Column, Column]:
    """The words with the last one's end taken off, and that end as the line's; both as they are if it has none."""
    last = F.get(words, F.size(words) - 1)
    has = (F.size(words) > 0) & last["end"].isNotNull()
    cut = F.struct(last["content"].alias("content"), last["start"].alias("start"), F.lit(None).cast("long").alias("end")).cast(_WORD)
    shorter = F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(cut))
    return F.when(has, shorter).otherwise(words), F.when(has, last["end"]).otherwise(line_end)
