"""Removal of repeated passages with automata of repeated phrases.

Every window of 50 words is represented by one phrase of half its words: the one
with the least hash.  Equal windows have equal phrases, so a window can recur
only where its phrase does; and so long a phrase seldom recurs by chance.

1. Confirm: phrases that represent windows of two documents or more recur.
2. Compile: the recurring phrases are dealt to shards, a phrase to the shard of
   the first piece of text that has it; that document gives its words, and each
   shard is one Aho-Corasick automaton of bounded size.
3. Locate: a document is cut into pieces of some thousand windows, and every piece
   is streamed through the automata of all shards that have a phrase of one of its
   windows, in as many tasks for a shard as its pieces ask for.  The automata find
   where the phrases stand, word for word.  A window starts in one piece, which
   has all its words, and comes forth from the one shard that has its phrase, so
   none is lost and none comes twice.
4. The windows around the places found are compared by 128-bit hashes, and a
   word goes if a window over it also starts in a document with a smaller id.

Documents equal word for word are settled first, by the digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.prefilter import likely_in
from lyrebird.llm.words import PLAIN, Block, gram_ids, mix, signed, word_blocks
from lyrebird.staging import staged, table

WINDOW = 50
#: phrases of a shard's automaton, about; those of one piece of a document are together
SHARD_PHRASES = 10_000
#: windows that start in a piece
PIECE_WINDOWS = 8192
#: bytes of text that one task streams through a shard's automaton; it compiles its own
PART_BYTES = 16 << 20


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _row_words(block: Block, row: int) -> list[bytes]:
    return block.raw[block.offsets[row] : block.offsets[row + 1]].tobytes().split()


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every span consecutive values."""
    if len(values) < span:
        return values[:0]
    least, have = values, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    over = span - have
    return np.minimum(least[: len(least) - over], least[over:]) if over else least


def least_phrases(ids: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each window that of its least."""
    grams = gram_ids(ids, phrase)
    return grams, _sliding_least(grams, window - phrase + 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, key, n_words, text."""
    for batch in batches:
        words = [t.split() for t in pc.fill_null(batch["text"].cast(pa.binary()), b"").to_pylist()]
        keys = pa.array(np.frombuffer(b"".join(_digest(w)[:8] for w in words), np.int64))
        yield pa.record_batch([batch["doc_id"], keys, pa.array([len(w) for w in words], pa.int64()), batch["text"]], ["doc_id", "key", "n_words", "text"])


def _survey(window: int, phrase: int, size: int):
    """doc_id, text -> a row for the document, and one for each phrase of the windows of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch["text"], PLAIN):
                doc = batch["doc_id"].slice(block.first_row, block.rows)
                digests = [_digest(_row_words(block, row)) for row in range(block.rows)]
                keys = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                yield pa.record_batch({
                    "phrase": pa.nulls(block.rows, pa.int64()), "piece": pa.nulls(block.rows, pa.int32()), "doc_id": doc, "key": pa.array(keys), "n_words": pa.array(block.counts),
                    "sha256": pa.array([d.hex() for d in digests], pa.string()),
                })
                least = least_phrases(block.ids, window, phrase)[1]
                at = np.arange(len(least))
                row = np.searchsorted(block.bounds, at, side="right") - 1
                inside = at + window <= block.bounds[row + 1]
                row, at, least = row[inside], at[inside], least[inside]
                if not len(row):
                    continue
                piece = (at - block.bounds[row]) // size
                order = np.lexsort((least, piece, row))
                row, piece, least = row[order], piece[order], least[order]
                first = np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])])
                row, piece, least = row[first], piece[first], least[first]
                yield pa.record_batch({
                    "phrase": pa.array(signed(least)), "piece": pa.array(piece.astype(np.int32)), "doc_id": doc.take(pa.array(row)), "key": pa.array(keys[row]),
                    "n_words": pa.nulls(len(row), pa.int64()), "sha256": pa.nulls(len(row), pa.string()),
                })

    return run


def _phrase_words(phrase: int):
    """Documents with the recurring phrases that they are the first to have, and their shards -> shard and words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch["text"], PLAIN):
                own = batch.slice(block.first_row, block.rows)
                shards, texts = [], []
                for row, known in enumerate(own["phrases"]):
                    named, shard = (known.values.field(c).to_numpy() for c in ("phrase", "shard"))
                    order = np.argsort(named.view(np.uint64))
                    named, shard = named.view(np.uint64)[order], shard[order]
                    words, grams = _row_words(block, row), gram_ids(block.ids[block.bounds[row] : block.bounds[row + 1]], phrase)
                    wanted = np.flatnonzero(np.isin(grams, named))
                    once = wanted[np.unique(grams[wanted], return_index=True)[1]]
                    texts += [b" ".join(words[p : p + phrase]) for p in once.tolist()]
                    shards += shard[np.searchsorted(named, grams[once])].tolist()
                yield pa.record_batch({"shard": pa.array(shards, pa.int32()), "phrase": pa.array(texts, pa.binary())})

    return run


def _pieces(window: int, size: int):
    """Documents with the pieces asked for -> doc_id, key, shard, piece and the piece's words, with those of its last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch["text"].cast(pa.binary())):
                asked = batch["asked"][row].values
                shard, piece = asked.field("shard"), asked.field("piece")
                numbers = np.unique(piece.to_numpy())
                words = text.as_py().split()
                texts = pa.array([b" ".join(words[p * size : (p + 1) * size + window - 1]) for p in numbers.tolist()], pa.binary())
                own = np.searchsorted(numbers, piece.to_numpy())
                for a in range(0, len(own), 64):
                    part = own[a : a + 64]
                    same = pa.array(np.full(len(part), row))
                    yield pa.record_batch(
                        [batch["doc_id"].take(same), batch["key"].take(same), shard.slice(a, 64), piece.slice(a, 64), texts.take(pa.array(part))],
                        ["doc_id", "key", "shard", "piece", "text"],
                    )

    return run


def _automaton(phrases: Iterable[bytes]):
    """Finds the phrases in words with one space between them and at both ends."""
    out = ahocorasick.Automaton()
    for words in phrases:
        out.add_word(f" {words.decode('latin-1')} ", len(words))
    out.make_automaton()
    return out


def _located(automaton, words: list[bytes]) -> np.ndarray:
    """The words at which phrases start."""
    found = [end - size for end, size in automaton.iter(f" {b' '.join(words).decode('latin-1')} ")]
    starts = np.concatenate([[1], 1 + np.cumsum([len(w) + 1 for w in words])])
    return np.searchsorted(starts, np.array(found, np.int64))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch, pa.RecordBatch]]:
    """Of each shard and part in a batch its phrases and then its documents."""
    shard, part = (batch[c].to_numpy() for c in ("shard", "part"))
    edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
    edges = [0, *edges.tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = batch.slice(a, b - a)
        phrases = own["phrase"].is_valid()
        yield (int(shard[a]), int(part[a])), own.filter(phrases), own.filter(pc.invert(phrases))


def _windows(window: int, phrase: int, size: int):
    """Phrases and pieces of documents of each shard and part, phrases first -> doc_id, key, start and 128-bit hash of each window to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, phrases, automaton = None, set(), None
        for batch in batches:
            for where, new, documents in _runs(batch) if batch.num_rows else ():
                if where != here:
                    here, phrases, automaton = where, set(), None
                phrases.update(new["phrase"].to_pylist())
                if not documents.num_rows or not phrases:
                    continue
                automaton = automaton or _automaton(phrases)
                for block in word_blocks(documents["text"], PLAIN):
                    yield from _block_windows(documents.slice(block.first_row, block.rows), block, automaton, window, phrase, size)

    return run


def _block_windows(documents: pa.RecordBatch, block: Block, automaton, window: int, phrase: int, size: int = 0) -> Iterator[pa.RecordBatch]:
    """Windows of documents, or of their pieces of so many windows."""
    before = documents["piece"].to_numpy().astype(np.int64) * size if size else np.zeros(block.rows, np.int64)
    at, start, one, two = [], [], [], []
    for row in range(block.rows):
        places = _located(automaton, _row_words(block, row))
        if not len(places):
            continue
        ids = block.ids[block.bounds[row] : block.bounds[row + 1]]
        grams, least = least_phrases(ids, window, phrase)
        found = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
        found[places] = grams[places]
        # windows whose least phrase is one that the automaton has found
        here = np.flatnonzero(_sliding_least(found, window - phrase + 1) == least)
        if len(here):
            one.append(gram_ids(ids, window)[here])
            two.append(gram_ids(mix(ids + np.uint64(0x5851F42D4C957F2D)), window)[here])
            at.append(np.full(len(here), row))
            start.append(before[row] + here)
    if at:
        where = pa.array(np.concatenate(at))
        yield pa.record_batch({
            "doc_id": documents["doc_id"].take(where), "key": documents["key"].take(where), "start": pa.array(np.concatenate(start).astype(np.int32)),
            "w1": pa.array(signed(np.concatenate(one))), "w2": pa.array(signed(np.concatenate(two))),
        })


def _removal(window: int, spans: bool):
    """Documents with the starts of windows to remove -> digest of what is left, and the kept text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "kept_sha256": []} | ({"kept": []} if spans else {})
            for text, starts in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.minimum(np.array(starts) + window, len(words)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(_digest(kept).hex())
                if spans:
                    out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
            types = {"n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
            yield pa.record_batch([batch["doc_id"], batch["key"], *(pa.array(v, types[k]) for k, v in out.items())], ["doc_id", "key", *out])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, phrase: int | None = None, kept: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs; with kept also the kept text where words went.

    phrase is the number of words that stand for a window, from one to all of
    them; half of them if none is named.  It changes the cost, not the result.

    docs has doc_id (a whole number) and text.  A null or empty text has no words.
    Rows of a null doc_id lose nothing and cost no other row anything.  Rows that
    repeat a doc_id are each judged by their own text; equal ids are not smaller
    ones.  Texts shorter than a window lose nothing.  An empty table gives no
    rows.  Other columns are left alone.
    """
    phrase = phrase or max(1, window // 2)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = PIECE_WINDOWS
    survey = docs.mapInArrow(_survey(window, phrase, size), "phrase long, piece int, doc_id long, key long, n_words long, sha256 string")
    survey = staged(survey, "repeats-survey")
    base = survey.where(F.col("n_words").isNotNull()).select("doc_id", "key", "n_words", "sha256")
    owners = staged(
        base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("sha256").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("sha256", "owner"),
        "repeats-owners",
    )
    copies = staged(base.join(owners, "sha256").where("doc_id > owner").select("doc_id", "key").distinct(), "repeats-copies")

    places = survey.where(F.col("phrase").isNotNull() & F.col("doc_id").isNotNull()).select("phrase", "doc_id", "key", "piece")
    places = staged(places.join(copies, ["doc_id", "key"], "left_anti"), "repeats-phrases")
    recurring = places.groupBy("phrase").agg(F.min(F.struct("doc_id", "piece", "key")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    recurring = staged(recurring.select("phrase", "first"), "repeats-recurring")
    shards = max(1, -(-recurring.count() // SHARD_PHRASES))
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    routes = staged(places.join(recurring.select("phrase", "shard"), "phrase").select("doc_id", "key", "piece", "shard").distinct(), "repeats-routes")
    compiled = recurring.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    compiled = compiled.agg(F.collect_list(F.struct("phrase", "shard")).alias("phrases"))

    # the documents that hold recurring phrases; of each the pieces that do, once for each shard that has one
    asked = routes.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("piece", "shard"))).alias("asked"))
    holders = staged(asked.join(compiled, ["doc_id", "key"], "left"), "repeats-holders")
    held = likely_in(docs, holders, then=_keyed, schema="doc_id long, key long, n_words long, text string").join(holders, ["doc_id", "key"])
    held = staged(held.dropDuplicates(["doc_id", "key"]), "repeats-held")
    number = F.greatest(F.lit(1), F.ceil((F.col("n_words") - window + 1) / size))
    lengths = held.select("doc_id", "key", (F.octet_length("text") / number).alias("bytes")).join(routes, ["doc_id", "key"])
    sizes = staged(lengths.groupBy("shard").agg(F.ceil(F.sum("bytes") / PART_BYTES).cast("int").alias("parts")), "repeats-sizes")
    phrases = held.where("phrases IS NOT NULL").select("text", "phrases").mapInArrow(_phrase_words(phrase), "shard int, phrase binary")
    phrases = staged(phrases, "repeats-phrase-words").join(sizes, "shard")
    phrases = phrases.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = held.select("doc_id", "key", "text", "asked")
    pieces = pieces.mapInArrow(_pieces(window, size), "doc_id long, key long, shard int, piece int, text binary")
    pieces = pieces.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.col("parts")).cast("int"))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in {"doc_id": "long", "key": "long", "piece": "int", "text": "binary", "phrase": "binary"}.items()}
    stream = phrases.select("shard", "part", none["doc_id"], none["key"], none["piece"], "phrase", none["text"]).union(
        pieces.select("shard", "part", "doc_id", "key", "piece", none["phrase"], "text")
    )
    stream = stream.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("doc_id").asc_nulls_first())
    windows = stream.mapInArrow(_windows(window, phrase, size), "doc_id long, key long, start int, w1 long, w2 long")
    windows = staged(windows, "repeats-windows")
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = staged(firsts.select("w1", "w2", "first"), "repeats-firsts")
    starts = windows.join(firsts, ["w1", "w2"]).where("doc_id > first").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    cut = held.select("doc_id", "key", "text").join(starts, ["doc_id", "key"])
    cut = cut.mapInArrow(_removal(window, kept), "doc_id long, key long, n_removed long, kept_sha256 string" + ", kept string" * kept)

    nothing = hashlib.sha256().hexdigest()
    copied = F.col("copied") & (F.col("n_words") >= window)
    out = base.join(cut, ["doc_id", "key"], "left").join(copies.withColumn("copied", F.lit(True)), ["doc_id", "key"], "left")
    columns = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept")] if kept else []))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM d WHERE len(ws) >= 50),
w AS MATERIALIZED (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 49], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM w JOIN f USING (h) WHERE doc_id > first),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
