"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of 10 words.  A window is the set of its 3-word
shingles, and since a document must contain the whole window, one shingle of it
is a sufficient prefix: the rarest, by how often the corpus has it.  Documents
meet windows on that shingle; the length bound drops windows longer than the
document, the positional bound fixes where the window would start, and the words
there are then compared one by one.  A benchmark of bounded size is broadcast;
a larger one is joined by a shuffle, in which each document sends only the places
of prefixes, with the words around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lyrebird.llm.prefilter import among, bitmap
from lyrebird.llm.words import ALNUM, gram_ids, signed, word_blocks
from lyrebird.staging import free_name, staged, table

WINDOW = 10
SHINGLE = 3
#: windows that are sent to all tasks; more are joined by a shuffle
BLOCK_WINDOWS = 250_000


def _item_windows(window: int):
    """item_id, text -> item_id and the word ids of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                ids, at, words = signed(block.ids), [], []
                for row in range(block.rows):
                    a, b = block.bounds[row], block.bounds[row + 1]
                    for start in range(a, max(b - window + 1, a + (b > a))):
                        at.append(block.first_row + row)
                        words.append(ids[start : min(start + window, b)])
                items = batch["item_id"].take(pa.array(at, pa.int64())).cast(pa.string())
                yield pa.record_batch({"item_id": items, "words": pa.array(words, pa.list_(pa.int64()))})

    return run


class _Windows:
    """Windows, with the shingles that lead to them."""

    def __init__(self, words: list[np.ndarray], items: list[list[str]], shingle: int):
        self.items = items
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = np.concatenate(words).view(np.uint64) if words else np.empty(0, np.uint64)
        self.sizes = sorted({min(shingle, len(w)) for w in words})
        # of each shingle size: shingle, its window, its place there
        self.shingles = {}
        for k in self.sizes:
            own = [i for i, w in enumerate(words) if min(shingle, len(w)) == k]
            grams = [gram_ids(words[i].view(np.uint64), k) for i in own]
            self.shingles[k] = (
                np.concatenate(grams),
                np.repeat(np.array(own), [len(g) for g in grams]),
                np.concatenate([np.arange(len(g)) for g in grams]),
            )

    def distinct(self, k: int) -> np.ndarray:
        return np.unique(self.shingles[k][0])

    def prefixes(self, k: int, count: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rarest shingle of each window: sorted shingles, windows, places."""
        gram, window, place = self.shingles[k]
        often = np.array([count.get(int(g), 0) for g in gram.tolist()], np.int64)
        order = np.lexsort((place, gram, often, window))
        first = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])]
        first = first[often[first] > 0]  # no document has the others
        first = first[np.argsort(gram[first], kind="stable")]
        return gram[first], window[first], place[first]


def _bits(values: np.ndarray, width: int = 22) -> np.ndarray:
    out = np.zeros(1 << width, bool)
    out[values >> np.uint64(64 - width)] = True
    return out


def _present(grams: np.ndarray, bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of grams that are among the sorted values."""
    at = np.flatnonzero(bits[grams >> np.uint64(64 - 22)])
    if not len(at) or not len(values):
        return at[:0]
    place = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
    return at[values[place] == grams[at]]


def _shingle_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: _Windows = shared.value
        values = {k: windows.distinct(k) for k in windows.sizes}
        bits = {k: _bits(v) for k, v in values.items()}
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                for k in windows.sizes:
                    grams = gram_ids(block.ids, k)
                    # a gram over a row's end is counted too; the order stays the same for all
                    found, n = np.unique(grams[_present(grams, bits[k], values[k])], return_counts=True)
                    yield pa.record_batch({"shingle": pa.array(signed(found)), "n": pa.array(n)})

    return run


def _find(shared, schema: pa.Schema):
    """Rows with their words and hits; schema has the columns to keep before n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        bits = {k: _bits(p[0]) for k, p in prefixes.items()}
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                hits = [_matches(block, windows, k, prefixes[k], bits[k]) for k in windows.sizes]
                where, what = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, int),) * 2
                row = np.searchsorted(block.bounds, where, side="right") - 1
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(block.rows + 1))
                spans, items = [], []
                for r in range(block.rows):
                    own = order[cuts[r] : cuts[r + 1]]
                    start = where[own] - block.bounds[r]
                    spans.append(np.stack([start, start + windows.lengths[what[own]]], 1).ravel() if len(own) else [])
                    items.append(sorted({i for w in set(what[own].tolist()) for i in windows.items[w]}))
                kept = [batch[c].slice(block.first_row, block.rows) for c in schema.names[:-3]]
                yield pa.record_batch(
                    [*kept, pa.array(block.counts), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    schema=schema,
                )

    return run


def _matches(block, windows: _Windows, k: int, prefix, bits) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in the block where windows occur, and the windows."""
    gram, window, place = prefix
    grams = gram_ids(block.ids, k)
    at = _present(grams, bits, gram)
    low, high = np.searchsorted(gram, grams[at], "left"), np.searchsorted(gram, grams[at], "right")
    n = high - low
    at = np.repeat(at, n)
    which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else low
    start, window = at - place[which], window[which]
    row = np.searchsorted(block.bounds, at, side="right") - 1
    length = windows.lengths[window]
    fits = (start >= block.bounds[row]) & (start + length <= block.bounds[row + 1])
    start, window, length = start[fits], window[fits], length[fits]
    same = np.ones(len(start), bool)
    for j in range(int(length.max(initial=0))):
        live = np.flatnonzero(same & (length > j))
        same[live] = block.ids[start[live] + j] == windows.words[windows.offsets[window[live]] + j]
    return start[same], window[same]


def _window_shingles(shingle: int):
    """words, items -> words, items, and each shingle with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_ids(np.array(w, np.int64).view(np.uint64), min(shingle, len(w))) for w in batch["words"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            yield pa.record_batch(
                {
                    "words": batch["words"].take(at),
                    "items": batch["items"].take(at),
                    "gram": pa.array(signed(np.concatenate(grams)) if grams else np.empty(0, np.int64)),
                    "place": pa.array(np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)),
                }
            )

    return run


def _marked_counts(shared, sizes: list[int]):
    """How often each block has the shingles whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                for k in sizes:
                    grams = gram_ids(block.ids, k)
                    found, n = np.unique(grams[among(grams, bits)], return_counts=True)
                    yield pa.record_batch({"gram": pa.array(signed(found)), "n": pa.array(n)})

    return run


_PLACES = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64()), ("lead", pa.int64()), ("around", pa.list_(pa.int64()))]))


def _prefix_places(shared, sizes: list[int], window: int, schema: pa.Schema):
    """Rows with their words and the places whose shingle's bit is set, each with the words that a window there can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                found = []
                for k in sizes:
                    grams = gram_ids(block.ids, k)
                    at = np.flatnonzero(among(grams, bits))
                    row = np.searchsorted(block.bounds, at, side="right") - 1
                    inside = at + k <= block.bounds[row + 1]
                    at, row = at[inside], row[inside]
                    low = np.maximum(block.bounds[row], at - (window - k))
                    found.append((row, at, low, np.minimum(block.bounds[row + 1], at + window), grams[at]))
                row, at, low, high, gram = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                row, at, low, high, gram = (x[order] for x in (row, at, low, high, gram))
                ends = np.concatenate([[0], np.cumsum(high - low)])
                word = np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)
                around = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(block.ids[word])))
                places = [pa.array(signed(gram)), pa.array(at - block.bounds[row]), pa.array(at - low), around]
                cuts = pa.array(np.searchsorted(row, np.arange(block.rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(places, fields=list(_PLACES.value_type)))
                kept = [batch[c].slice(block.first_row, block.rows) for c in schema.names[:-2]]
                yield pa.record_batch([*kept, pa.array(block.counts), lists], schema=schema)

    return run


def _joined(docs: DataFrame, found: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs by number, with n_words, and the hits by number of row; neither side of the join is broadcast here.

    The documents are read twice, however many windows there are: to count the
    windows' shingles, and to find the places of the rarest.
    """
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in found.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())  # one to shingle
    shingles = found.select("words", "items").mapInArrow(
        _window_shingles(shingle), "words array<long>, items array<string>, gram long, place long"
    )
    shingles = staged(shingles, "benchmark-shingles")
    marks = spark.sparkContext.broadcast(np.packbits(bitmap(shingles.select("gram"))))
    counts = docs.select("text").mapInArrow(_marked_counts(marks, sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    prefixes = (
        shingles.join(counts, "gram")
        .groupBy("words")
        .agg(F.min(F.struct("n", "gram", "place")).alias("least"), F.first("items").alias("items"))
        .select("least.gram", "least.place", "words", "items")
    )
    prefixes = staged(prefixes, "benchmark-prefixes")
    marks = spark.sparkContext.broadcast(np.packbits(bitmap(prefixes.select("gram"), 64)))
    own = [f for f in docs.schema.fields if f.name != "text"]
    schema = pa.schema(
        [("row", pa.int64()), *((f.name, to_arrow_type(f.dataType)) for f in own), ("n_words", pa.int64()), ("places", _PLACES)]
    )
    ddl = ", ".join(["row long", *(f"{f.name} {f.dataType.simpleString()}" for f in own), "n_words long"])
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _prefix_places(marks, sizes, window, schema), f"{ddl}, places array<struct<gram: long, at: long, lead: long, around: array<long>>>"
    )
    numbered = staged(numbered, "benchmark-places")
    hits = (
        numbered.select("row", F.explode("places").alias("p"))
        .select("row", "p.*")
        .join(prefixes, "gram")
        .where("lead >= place AND slice(around, int(lead - place) + 1, size(words)) = words")
        .select("row", (F.col("at") - F.col("place")).alias("start"), F.size("words").cast("long").alias("length"), "items")
    )
    return numbered.drop("places"), hits


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans, items: one row for each of docs.

    spans has start and end (in words) of every occurrence of a window, one after
    the other; items the ids, as strings, of the items that occur, sorted.  A
    null or empty text has no words and no hits; items without words have no
    window; of repeated items each id counts.  Rows without an item_id are passed
    over.  Windows that several items share are looked for once.  Ids may repeat or
    be null.  Up to block_windows windows go to all tasks; more are joined on
    their prefixes by a shuffle, with the same rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = next(f for f in docs.schema.fields if f.name == "doc_id").dataType
    found, n = _benchmark_windows(benchmark, window)
    if n <= block_windows:
        schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        ddl = f"doc_id {kind.simpleString()}, n_words long, spans array<long>, items array<string>"
        return docs.mapInArrow(_find(_shared_windows(docs, found, shingle), schema), ddl)
    rows, hits = _joined(docs, found, window, shingle)
    hits = hits.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return rows.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))), F.array().cast("array<long>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The windows with their items, and how many there are."""
    found = (
        benchmark.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_windows(window), "item_id string, words array<long>")
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    found = staged(found, "benchmark-windows")
    return found, found.count()


def _shared_windows(docs: DataFrame, found: DataFrame, shingle: int):
    """The windows, a bounded number, and their prefixes, broadcast."""
    spark = docs.sparkSession
    rows = found.sort("words").toArrow()
    words, items = rows["words"].combine_chunks(), rows["items"].combine_chunks()
    windows = _Windows([w.values.to_numpy() for w in words], [i.as_py() for i in items], shingle)
    counts = docs.select("text").mapInArrow(_shingle_counts(spark.sparkContext.broadcast(windows)), "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    often = dict(zip(counts["shingle"].to_numpy().view(np.uint64).tolist(), counts["n"].to_numpy().tolist(), strict=True))
    return spark.sparkContext.broadcast((windows, {k: windows.prefixes(k, often) for k in windows.sizes}))


def hit_words() -> Column:
    """Number of words in the union of the column spans."""
    pairs = "array_sort(transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[2 * i] AS a, spans[2 * i + 1] AS b)))"
    union = (
        f"aggregate({pairs}, struct(0L AS n, 0L AS e), "
        "(s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.e)) AS n, greatest(s.e, x.b) AS e), s -> s.n)"
    )
    return F.when(F.size("spans") > 0, F.expr(union)).otherwise(F.lit(0).cast("long"))


def _without_hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        bits = {k: _bits(p[0]) for k, p in prefixes.items()}
        for batch in batches:
            for block in word_blocks(batch["text"], ALNUM):
                clean = np.ones(block.rows, bool)
                for k in windows.sizes:
                    start = _matches(block, windows, k, prefixes[k], bits[k])[0]
                    clean[np.searchsorted(block.bounds, start, side="right") - 1] = False
                yield batch.slice(block.first_row, block.rows).filter(pa.array(clean))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of the benchmark occurs.

    Null and empty texts have no windows and stay; texts of any length are judged
    whole.  Each row is judged by itself, so rows that repeat an id or a text share a
    text's fate and null ids change nothing.  Null items have no windows; without
    windows all rows stay; an empty table gives no rows.  Beyond block_windows
    windows, rows are told by the digest of their text.
    """
    found, n = _benchmark_windows(benchmark, window)
    if n <= block_windows:
        return docs.mapInArrow(_without_hits(_shared_windows(docs, found, shingle)), docs.schema)
    digest = free_name("_digest", docs.columns)
    marked = docs.withColumn(digest, F.sha2(F.col("text").cast("string"), 256))
    rows, hits = _joined(marked.select(F.col(digest).alias("digest"), F.col("text").cast("string").alias("text")), found, window, shingle)
    texts = rows.join(hits.select("row").distinct(), "row", "left_semi").select(F.col("digest").alias(digest)).distinct()
    return marked.join(texts, digest, "left_anti").drop(digest)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
i AS (SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS window_text
      FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM i)),
h AS MATERIALIZED (SELECT DISTINCT doc_id, pos, g.k, item_id FROM g JOIN i ON g.k = i.k AND array_to_string(ws[pos:pos + g.k - 1], ' ') = i.window_text),
p AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS w FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
