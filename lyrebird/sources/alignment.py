"""Requests and responses of alignment services as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions.units import seconds_to_ms

#: response of the batch service
SERVICE_RESPONSE = "struct<words:array<struct<text:string,start_time:double,end_time:double>>>"
#: response of the transcript aligner
CASE_RESPONSE = "struct<words:array<struct<word:string,case:string,start:double,end:double>>>"


def _word(word: Column, start: Column, end: Column) -> Column:
    return F.struct(word.alias("word"), start.alias("start_ms"), end.alias("end_ms"))


def service_words(body: Column) -> Column:
    """Words with milliseconds from a JSON body with text, start_time and end_time."""
    return F.transform(F.from_json(body, SERVICE_RESPONSE)["words"], lambda w: _word(w["text"], seconds_to_ms(w["start_time"]), seconds_to_ms(w["end_time"])))


def case_words(body: Column) -> Column:
    """Words with milliseconds from a JSON body with word, case, start and end; no times unless the case is success."""
    found = lambda w, t: F.when(w["case"] == "success", seconds_to_ms(w[t]))
    return F.transform(F.from_json(body, CASE_RESPONSE)["words"], lambda w: _word(w["word"], found(w, "start"), found(w, "end")))


def batch_request(audios: Column, texts: Column, languages: Column) -> Column:
    """One struct (audio, text, language) for each audio; one language serves all.

    Unequal numbers of audios and texts are an error; numbers of languages are
    not compared, and missing ones are null.
    """
    n = F.size(audios)
    shared = F.when(F.size(languages) == 1, F.array_repeat(languages[0], n)).otherwise(languages)
    zipped = F.transform(audios, lambda a, i: F.struct(a.alias("audio"), F.get(texts, i).alias("text"), F.get(shared, i).alias("language")))
    return F.when(n == F.size(texts), zipped).otherwise(F.raise_error(F.lit("numbers of audios and texts differ")))
