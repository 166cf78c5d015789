"""Runs of words that repeat with a period, by enumeration of maximal pairs.

A run of period q and length n is a stretch whose words q apart are identical and
that no neighbouring word extends.  It shows as a maximal pair: the same words
stand at its start and q words on, n - q of them, with different words to the
left and to the right of both.

1. Suffixes of a text whose first words recur in it are sorted by prefix
   doubling; longest common prefixes of neighbours follow from the ranks kept of
   each doubling.
2. The LCP-interval tree is walked bottom-up.  An interval's list has the places
   of its suffixes in order, each with its left word, which is its class.  Where
   two lists of one interval meet, places of different classes are maximal pairs.
3. A run needs a distance of at most a part of the common length, so only places
   that near are looked at.  Occurrences so near each other lie in one arithmetic
   progression, and all but its first have one left word; so the classes near a
   place are told from the first place to either side, and only pairs are visited
   that come forth.  The number of those is linear in the text.
4. Pairs at a multiple of the period have the run's start and length; the least
   distance is the period.  Nothing is extended or verified afterwards.

A text is worked on whole; several short ones share a block.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lyrebird.llm.words import PLAIN, Block, gram_ids, word_blocks
from lyrebird.staging import free_name, table

#: a run has at least so many words, and so many times its period
LEAST_WORDS, LEAST_EXPONENT = 6, 4

Run = tuple[int, int, int]  # start, length, period


def least_match(least_words: int, least_exponent: int) -> int:
    """Words that the two places of a run's maximal pair have in common, at least."""
    return min(max((least_exponent - 1) * d, least_words - d) for d in range(1, least_words + 1))


def recurring_suffixes(ids: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first seed words recur in their row, in order of their suffixes, and common prefixes with the one before.

    Rows are one after the other in ids; a suffix ends with its row.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    ends = bounds[1:][row]
    grams = gram_ids(ids, seed)
    whole = np.flatnonzero(np.arange(len(grams)) + seed <= ends[: len(grams)])
    keys = grams[whole] + row[whole].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    mine = whole[again]
    if not len(mine):
        return none
    after = mine + seed
    places = np.union1d(mine, after[after < ends[mine]])
    index = np.full(len(ids) + 1, -1, np.int32)
    index[places] = np.arange(len(places))
    end = ends[places]

    def word(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.where(at < stop, ids[np.minimum(at, len(ids) - 1)], np.uint64(0))

    # ranks by the first seed words: the first slot of each class in sorted order
    columns = [word(places + j, end) for j in range(seed)]
    order = np.lexsort([*columns[::-1], row[places]])
    fresh = row[places][order][1:] != row[places][order][:-1]
    for c in columns:
        fresh |= c[order][1:] != c[order][:-1]
    heads = np.concatenate([[True], fresh])
    rank = np.empty(len(places), np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(len(places)), 0))
    kept, h = [], seed
    while True:
        size = np.bincount(rank, minlength=len(places))
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        kept.append((h, rank.copy()))
        on = places[open_] + h
        second = np.where(on < end[open_], rank[index[np.minimum(on, len(ids))]], -1)
        order = np.lexsort([second, rank[open_]])
        first, second = rank[open_][order], second[order]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        starts = np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        heads = group | np.concatenate([[True], second[1:] != second[:-1]])
        slots = first + np.arange(len(order)) - starts
        rank[open_[order]] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))]
        h *= 2

    inner = index[mine]
    sa = mine[np.argsort(rank[inner], kind="stable")]
    left, right = sa[:-1], sa[1:]
    stop = np.where(row[left] == row[right], ends[left], 0), ends[right]
    common = np.zeros(len(left), np.int64)
    for h, ranks in reversed(kept):
        a, b = left + common, right + common
        ok = np.flatnonzero((a < stop[0]) & (b < stop[1]))
        x, y = index[a[ok]], index[b[ok]]
        ok = ok[(x >= 0) & (y >= 0) & (ranks[x] == ranks[y])]
        common[ok] += h
    go = np.flatnonzero(stop[0] > 0)
    while len(go):
        a, b = left[go] + common[go], right[go] + common[go]
        inside = (a < stop[0][go]) & (b < stop[1][go])
        go = go[inside]
        go = go[ids[a[inside]] == ids[b[inside]]]
        common[go] += 1
    return sa, np.concatenate([[0], common])


def _near_groups(sa: np.ndarray, common: np.ndarray, seed: int, factor: int) -> np.ndarray:
    """Of each entry of sa whether two places of its outermost interval are near enough for the longest prefix in it."""
    group = np.cumsum(common < seed) - 1
    inner = np.where(common < seed, 0, common)
    longest = np.maximum.reduceat(inner, np.flatnonzero(common < seed))
    order = np.lexsort([sa, group])
    gap = np.diff(sa[order])
    within = group[order][1:] == group[order][:-1]
    least = np.full(len(longest), np.iinfo(np.int64).max // factor)
    np.minimum.at(least, group[order][1:][within], gap[within])
    return (factor * least <= longest)[group]


def maximal_pairs(sa: list[int], common: list[int], left: dict[int, int | None], seed: int, factor: int) -> Iterator[Run]:
    """(first place, distance, common length) of the maximal pairs of at least seed words with factor times the distance at most their length."""

    def met(big: list[int], small: list[int], length: int) -> list[int]:
        """Lists of two children of an interval become one; pairs between them come forth."""
        if len(big) < len(small):
            big, small = small, big
        reach, n = length // factor, len(big)
        for p in small:
            own, k = left[p], bisect_left(big, p - reach)
            if k < n and big[k] < p:
                if left[big[k]] != own:
                    found.append((big[k], p - big[k], length))
                k = bisect_left(big, p, k)
            if k < n and big[k] - p <= reach and left[big[k]] != own:
                while k < n and big[k] - p <= reach:
                    found.append((p, big[k] - p, length))
                    k += 1
        if len(small) == 1:
            insort(big, small[0])
        else:
            big += small
            big.sort()
        return big

    found: list[Run] = []
    stack: list[tuple[int, list[int]]] = []
    node: list[int] = []
    for place, length in zip(sa, common, strict=True):
        while stack and stack[-1][0] > length:
            inner, places = stack.pop()
            node = met(places, node, inner)
        if stack and stack[-1][0] == length:
            stack[-1] = length, met(stack[-1][1], node, length)
        elif length >= seed and node:
            stack.append((length, node))
        if found:
            yield from found
            found = []
        node = [place]
    while stack:
        inner, places = stack.pop()
        node = met(places, node, inner)
    yield from found


def runs_of_rows(ids: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> dict[int, list[Run]]:
    """Row -> its runs in order of start and period; ids are of the rows' words, one row after the other."""
    seed, factor = least_match(least_words, least_exponent), least_exponent - 1
    sa, common = recurring_suffixes(ids, bounds, seed)
    if not len(sa):
        return {}
    near = _near_groups(sa, common, seed, factor)
    sa, common = sa[near], common[near]  # whole intervals go, so prefixes of neighbours stay
    if not len(sa):
        return {}
    inside = ~np.isin(sa, bounds)
    before = dict.fromkeys(sa.tolist())
    before.update(zip(sa[inside].tolist(), ids[sa[inside] - 1].tolist(), strict=True))
    found: dict[tuple[int, int], int] = {}
    for start, distance, length in maximal_pairs(sa.tolist(), common.tolist(), before, seed, factor):
        stretch = start, length + distance
        if stretch[1] >= least_words:
            found[stretch] = min(found.get(stretch, distance), distance)
    out: dict[int, list[Run]] = {}
    if found:
        starts = np.array([s for s, _ in found])
        rows = np.searchsorted(bounds, starts, side="right") - 1
        for row, offset, ((start, length), period) in zip(rows.tolist(), bounds[rows].tolist(), found.items(), strict=True):
            out.setdefault(row, []).append((start - offset, length, period))
        for runs in out.values():
            runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that a run has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that each word of a text becomes where its tail is made to repeat; None where it is left as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _rows_of(block: Block, doc: pa.Array, sources: Callable | None, limits: tuple[int, int]) -> Iterator[tuple[int, list[bytes], list[Run]]]:
    """Of each row of a block its number, its words and its runs."""
    ids, maps = block.ids, {}
    if sources:
        ids = ids.copy()
        for row, doc_id in enumerate(doc.to_pylist()):
            a, n = block.bounds[row], int(block.counts[row])
            at = sources(doc_id, n)
            if at is not None:
                maps[row] = at
                ids[a : a + n] = block.ids[a + at]
    runs = runs_of_rows(ids, block.bounds, *limits)
    for row in range(block.rows):
        words = block.raw[block.offsets[row] : block.offsets[row + 1]].tobytes().split()
        if row in maps:
            words = [words[i] for i in maps[row].tolist()]
        yield row, words, runs.get(row, [])


def _joined(words: list[bytes], runs: list[Run]) -> bytes:
    if runs:
        words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]
    return b" ".join(words)


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def periodic_runs(
    docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = "collapsed_text",
    least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """docs with the runs of each text and the text without what runs repeat.

    runs is an array of (start, length, period) in words, in order of start and
    period.  collapsed, left out if None, has the words that stay, one space
    between them; a text without runs has all its words so.  A null text has no
    runs and a null collapsed text; an empty one has no runs and stays empty.
    Rows are judged each by itself, so repeated rows and ids have equal results;
    an empty table gives no rows.  Columns of the names asked for are replaced
    (whatever their case), others stay.  least_exponent is 3 or more.
    """
    if least_exponent < 3:
        raise ValueError("runs shorter than three periods have no single arithmetic progression of places")
    new = {c.lower() for c in (runs, collapsed) if c}
    rest = [f for f in docs.schema.fields if f.name.lower() not in new]
    body = free_name("_text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in _RUN]))
        for batch in batches:
            for block in word_blocks(batch[body], PLAIN):
                own = batch.slice(block.first_row, block.rows)
                known = own[body].is_valid().to_pylist()
                found, texts = [], []
                for row, words, of_row in _rows_of(block, own[body], None, (least_words, least_exponent)):
                    found.append([dict(zip(_RUN.names, r, strict=True)) for r in of_row])
                    texts.append(_joined(words, of_row).decode() if known[row] else None)
                columns = {f.name: own[f.name] for f in rest} | {runs: pa.array(found, kind)}
                yield pa.record_batch(columns | ({collapsed: pa.array(texts, pa.string())} if collapsed else {}))

    fields = [*rest, StructField(runs, ArrayType(_RUN))] + ([StructField(collapsed, StringType())] if collapsed else [])
    return docs.withColumn(body, docs[text].cast("string")).mapInArrow(run, StructType(fields))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> number of runs, the longest one and digests, after tails of some texts are made to repeat."""
    for batch in batches:
        for block in word_blocks(batch["text"], PLAIN):
            doc = batch["doc_id"].slice(block.first_row, block.rows)
            n_runs, longest, of_runs, of_words = [], [], [], []
            for _, words, runs in _rows_of(block, doc, planted_period, (LEAST_WORDS, LEAST_EXPONENT)):
                n_runs.append(len(runs))
                longest.append(min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3))
                of_runs.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                of_words.append(hashlib.sha256(_joined(words, runs)).hexdigest())
            start, length, period = zip(*longest, strict=True)
            yield pa.record_batch({
                "doc_id": doc.cast(pa.int64()), "n_runs": pa.array(n_runs, pa.int64()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "period": pa.array(period, pa.int64()),
                "exponent_milli": pa.array([n and 1000 * n // q for n, q in zip(length, period, strict=True)], pa.int64()),
                "runs_sha256": pa.array(of_runs, pa.string()), "collapsed_sha256": pa.array(of_words, pa.string()),
            })


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row the number of runs, the longest run and digests of the runs and of the collapsed text.

    Takes doc_id and text.  The tail of about a tenth of the texts, told by the CRC
    of doc_id, is first made to repeat (planted_period); a null doc_id leaves its
    text as it is.  A null text has no words.  Repeated rows give equal rows.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(_digests, schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


#: runs are stretches of equal words at one distance, found by a join of equal 5-word grams
SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
plain AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS c FROM numbered),
hashed AS (SELECT r, doc_id, w, len(w) AS n, coalesce(xor(c, 4294967295), 1) AS h FROM plain),
tails AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tails),
places AS (SELECT r, n, a, p, w, unnest(range(n)) AS i FROM periods),
words AS (SELECT r, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM places),
grams AS (SELECT r, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, min(i) AS start, count(*) + 4 + q AS length, q FROM islands GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= 6 AND length >= 4 * q GROUP BY r, start, length),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
digests AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
longest AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(g.n_runs, 0)::BIGINT AS n_runs, l.start::BIGINT AS start, l.length::BIGINT AS length, l.period::BIGINT AS period,
  (1000 * l.length // l.period)::BIGINT AS exponent_milli, sha256(coalesce(g.listed, '')) AS runs_sha256, sha256(coalesce(k.body, '')) AS collapsed_sha256
FROM numbered d LEFT JOIN digests g USING (r) LEFT JOIN longest l USING (r) LEFT JOIN kept k USING (r)
"""
