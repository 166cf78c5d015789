"""N-gram Jaccard join with R-trees of count vectors.

1. Each document becomes the set of its 5-word shingles; documents with equal
   sets form one class, of which the smallest id goes on.
2. Sets that share enough are brought together: every set names its rarest
   fifth of shingles, and sets that name a common shingle form a cell.  (A ball
   of similarity 0.8 is wide against the spread of counts, so one tree over the
   whole corpus would have to be walked nearly whole for every document.)
3. The shingles are hashed into groups, more for larger sets; a cell's sets are
   points of group counts in an R-tree, which is walked with the sum of
   coordinate minima as the bound of the overlap.  A first walk stops at pairs
   that join sets not yet joined; a last one takes every pair of sets that are
   not in one component.
4. The pairs that survive are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.components import connected_components
from lyrebird.llm.prefilter import likely_in
from lyrebird.llm.rtree import LEAF, CountTree
from lyrebird.llm.words import LOWER, mix, shingle_sets, signed, word_blocks
from lyrebird.staging import free_name, staged, table

SHINGLE = 5
#: groups of a set, a power of two that grows with the set and lies between these
GROUPS = (64, 1 << 16)
#: a shingle is frequent if this share of documents has it; at most (shingles a document) / share are
FREQUENT = 0.0005
#: frequent shingles that are broadcast at most, the most frequent; the others are ordered like rare ones
LISTED = 1 << 20
#: shingles of which the frequent ones are picked together
PICKED = 3_000_000
#: documents that share a shingle and are not gathered in one task, but dealt out as they are
HOT_ROWS = 50_000
#: sets of a cell that are in one tree; larger cells are banded by size and taken in parts
TREE_ROWS = 4096
#: rows of shingles that a task looks at together, and those of one shingle more
CELL_ROWS = 500_000

_FULL = np.iinfo(np.uint16).max


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> the size and a 128-bit sum of each set; shingles that are frequent among those of some blocks."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        for block in word_blocks(batch["text"], LOWER):
            sets, bounds = shingle_sets(block, SHINGLE)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(salt)))]) for salt in (1, 2)]
            one, two = (signed(s[bounds[1:]] - s[bounds[:-1]]) for s in sums)
            ids = batch["doc_id"].slice(block.first_row, block.rows)
            yield pa.record_batch({"n": pa.array(np.diff(bounds)), "doc_id": ids, "one": pa.array(one), "two": pa.array(two)})
            held.append(sets)
            rows += block.rows
            if sum(map(len, held)) > PICKED:
                yield _frequent(held, rows)
                held, rows = [], 0
    if held:
        yield _frequent(held, rows)


def _frequent(sets: list[np.ndarray], rows: int) -> pa.RecordBatch:
    ordered = np.concatenate(sets)
    ordered.sort()
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    often = np.diff(np.append(at, len(ordered)))
    kept = often >= max(4, FREQUENT * rows)
    many = signed(ordered[at[kept]])
    return pa.record_batch({"n": pa.array(-often[kept]), "doc_id": pa.nulls(len(many), pa.int64()), "one": pa.array(many), "two": pa.array(many)})


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of counts (one, often) that are as frequent as a bound asks, at most most of them.

    The bound is of 16 steps for each doubling, so that a sum over some hundred steps
    finds it.  Any order of shingles that all sets share is right for prefixes: what is
    left out makes cells larger and loses no pair.
    """
    step = F.floor(16 * F.log2("often"))
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in steps:
        total += n
        if total > most:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.limit(0)


def _prefix_length(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n, in one order for all, of which sets of similarity 0.8 share one."""
    return n - (4 * n + 4) // 5 + 1


def _named(shared, most: int):
    """doc_id, text -> a row for each shingle that a set names; those of more than most documents are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = shared.value
        for batch in batches:
            for block in word_blocks(batch["text"], LOWER):
                sets, bounds = shingle_sets(block, SHINGLE)
                sizes = np.diff(bounds)
                often = np.zeros(len(sets), np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
                    often = np.where(frequent[place] == sets, count[place], 0)
                row = np.repeat(np.arange(block.rows), sizes)
                mixed = np.flatnonzero(np.bincount(row, often > 0, block.rows))
                for r in mixed.tolist():  # rare shingles first
                    own = slice(bounds[r], bounds[r + 1])
                    order = np.lexsort((sets[own], often[own]))
                    sets[own], often[own] = sets[own][order], often[own][order]
                named = np.flatnonzero(np.arange(len(sets)) - bounds[row] < _prefix_length(sizes)[row])
                hot = often[named] > most
                doc = batch["doc_id"].slice(block.first_row, block.rows).take(pa.array(row[named]))
                where = np.where(hot, np.arange(len(named)).astype(np.uint64), sets[named])
                yield pa.record_batch({
                    "route": pa.array(signed(where)), "shingle": pa.array(signed(sets[named])), "doc_id": doc,
                    "n": pa.array(sizes[row[named]].astype(np.int32)), "hot": pa.array(hot),
                })

    return run


def _cells(most: int, together: int):
    """Rows of shingles, in order of shingle -> cell, doc_id, n of sets that share one; cells of the same sets in a task are given once.

    Rows of a hot shingle stay as they are, and so do those of one with more than most rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, large = 0, None
        for batch in batches:
            hot = batch["hot"].to_numpy(zero_copy_only=False)
            if hot.any():
                own = batch.filter(pa.array(hot))
                yield pa.record_batch([own["shingle"], own["doc_id"], own["n"]], ["cell", "doc_id", "n"])
            held.append(tuple(batch[c].to_numpy(zero_copy_only=False)[~hot] for c in ("shingle", "n", "doc_id")))
            count += len(held[-1][0])
            if count <= together:
                continue
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            if large is not None and whole[0][0] != large:
                large = None
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last shingle may go on
            if large is not None:  # a shingle that has begun to be given as it is
                cut_large = int(np.searchsorted(whole[0], large, side="right"))
                yield _as_they_are(*(c[:cut_large] for c in whole))
                whole, cut = tuple(c[cut_large:] for c in whole), max(0, cut - cut_large)
            if cut:
                yield from _named_cells(*(c[:cut] for c in whole))
            rest = tuple(c[cut:] for c in whole)
            if len(rest[0]) > most:
                large = rest[0][0]
                yield _as_they_are(*rest)
                rest = tuple(c[:0] for c in rest)
            held, count = [rest], len(rest[0])
        if count:
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            if large is not None:
                own = int(np.searchsorted(whole[0], large, side="right"))
                yield _as_they_are(*(c[:own] for c in whole))
                whole = tuple(c[own:] for c in whole)
            yield from _named_cells(*whole)

    return run


def _as_they_are(shingle: np.ndarray, n: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"cell": pa.array(shingle), "doc_id": pa.array(doc), "n": pa.array(n.astype(np.int32))})


def _named_cells(shingle: np.ndarray, n: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of whole shingles."""
    _, at, often = np.unique(shingle, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(often[at] > 1)
    shingle, n, doc = shingle[kept], n[kept].astype(np.int64), doc[kept]
    order = np.lexsort((doc, n, shingle))
    shingle, n, doc = shingle[order], n[order], doc[order]
    if not len(doc):
        return
    # sizes too far apart part a cell
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (5 * n[:-1] < 4 * n[1:])])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(doc)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(doc.view(np.uint64) + np.uint64(11)))])
    cell = mix(sums[begin + length] - sums[begin])
    _, once = np.unique(cell, return_index=True)
    once = once[length[once] > 1]
    rows = np.repeat(begin[once] - np.concatenate([[0], np.cumsum(length[once])[:-1]]), length[once]) + np.arange(length[once].sum()) if len(once) else begin[:0]
    for a in range(0, len(rows), 100_000):
        r = rows[a : a + 100_000]
        names = np.repeat(signed(cell[once]), length[once])[a : a + 100_000]
        yield pa.record_batch({"cell": pa.array(names), "doc_id": pa.array(doc[r]), "n": pa.array(n[r].astype(np.int32))})


def _group_count(n: np.ndarray) -> np.ndarray:
    """Groups enough for the counts of unrelated sets of n to be told from those of similar ones.

    Over g groups the counts of two such sets differ by about 1.13 sqrt(n g) in
    all, give or take a few sqrt(n); sets of similarity 0.8 by 2 n / 9 at most.
    """
    enough = 1.5 * (0.197 * np.sqrt(n) + 4.5) ** 2
    return np.clip(1 << np.ceil(np.log2(enough)).astype(np.int64), *GROUPS)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, size and group counts."""
    for batch in batches:
        for block in word_blocks(batch["text"], LOWER):
            sets, bounds = shingle_sets(block, SHINGLE)
            sizes = np.diff(bounds)
            groups = _group_count(sizes)
            row = np.repeat(np.arange(block.rows), sizes)
            base = np.concatenate([[0], np.cumsum(groups)])
            place = base[row] + (mix(sets) & (groups[row] - 1).astype(np.uint64)).astype(np.int64)
            counts = np.minimum(np.bincount(place, minlength=base[-1]), _FULL).astype(np.uint16)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(block.first_row, block.rows), "n": pa.array(sizes.astype(np.int32)),
                "counts": pa.array([counts[a:b].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)], pa.binary()),
            })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id and the shingles."""
    for batch in batches:
        for block in word_blocks(batch["text"], LOWER):
            sets, bounds = shingle_sets(block, SHINGLE)
            shingles = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch["doc_id"].slice(block.first_row, block.rows), "shingles": pa.array(shingles, pa.binary())})


class _Forest:
    """R-trees of one cell, one for each number of groups that its sets have.

    Sets of similar size have equal numbers of groups or neighbouring ones.  The
    tree of g groups holds the sets of g and, folded, those of 2 g.  A cell that
    fits in one leaf has no nodes above it.
    """

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray, tags: np.ndarray):
        self.rows, self.sizes, self.tags = rows, sizes, tags
        self.width = np.array([len(r) for r in rows])
        self.full = np.array([r.max() == _FULL for r in rows])  # counts at their largest value tell nothing
        self.trees = {}
        for g in np.unique(self.width).tolist() if len(rows) > LEAF else ():
            own = np.flatnonzero((self.width == g) | (self.width == 2 * g))
            points = np.stack([self.folded(i, g) for i in own.tolist()])
            points = points.astype(np.uint16) if points.max() <= _FULL else points
            self.trees[g] = own, CountTree(points, sizes[own], tags[own]), bool(self.full[own].any())

    def folded(self, i: int, groups: int) -> np.ndarray:
        row = self.rows[i]
        return row if len(row) == groups else row.reshape(-1, groups).sum(0, dtype=np.uint32)

    def probe(self, i: int) -> np.ndarray:
        """Sets of the cell, of other tags, that may be similar to set i."""
        if not self.trees:
            return self._in_leaf(i)
        found = []
        for g in (int(self.width[i]), int(self.width[i]) // 2):
            if g in self.trees:
                own, tree, full = self.trees[g]
                near = own[tree.probe(self.folded(i, g), self.sizes[i], self.tags[i], full)]
                found.append(near if g == self.width[i] else near[self.width[near] == g])
        return np.concatenate(found)

    def _in_leaf(self, i: int) -> np.ndarray:
        size = self.sizes[i]
        near = np.flatnonzero((5 * self.sizes >= 4 * size) & (4 * self.sizes <= 5 * size) & (self.tags != self.tags[i]))
        kept = []
        for j in near.tolist():
            g = int(min(self.width[i], self.width[j]))
            shared = int(np.minimum(self.folded(i, g), self.folded(j, g)).sum(dtype=np.int64))
            if 9 * shared >= 4 * (size + self.sizes[j]) or self.full[i] or self.full[j]:
                kept.append(j)
        return np.array(kept, np.int64)


def _by_cell(batches: Iterator[pa.RecordBatch], tag: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """doc_id, size, counts and tag of the rows of each cell and part, of batches sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ["cell", "part", "doc_id", "n", *([tag] if tag else [])]
        new = [batch[c].to_numpy().astype(np.int64) for c in names], [np.frombuffer(c, np.uint16) for c in batch["counts"].to_pylist()]
        columns, counts = new if held is None else ([np.concatenate(x) for x in zip(held[0], new[0], strict=True)], held[1] + new[1])
        edges = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        edges = [0, *edges.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield columns[2][a:b], columns[3][a:b], counts[a:b], columns[4][a:b] if tag else np.arange(b - a)
        held = [c[edges[-1] :] for c in columns], counts[edges[-1] :]
    if held:
        yield held[0][2], held[0][3], held[1], held[0][4] if tag else np.arange(len(held[1]))


def _walk(every: bool):
    """Cells with their points -> pairs whose overlap may be large enough.

    every: all pairs of sets of different components; else from set to set, in
    order of id, the pairs of each set that no earlier one has reached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for doc, size, counts, tag in _by_cell(batches, "component" if every else None):
            if len(doc) < 2:
                continue
            trees = _Forest(counts, size, tag)
            largest = None
            if every:  # the other side of each pair is walked from
                names, number = np.unique(tag, return_counts=True)
                largest = names[number.argmax()]
            reached = np.zeros(len(doc), bool)
            for i in np.argsort(doc, kind="stable").tolist():
                if (every and tag[i] == largest) or (not every and reached[i]):
                    continue
                found = trees.probe(i)
                if not every:
                    found = found[~reached[found]]
                    reached[found] = reached[i] = True
                found = found[doc[found] != doc[i]]
                if len(found):
                    a.append(np.minimum(doc[i], doc[found]))
                    b.append(np.maximum(doc[i], doc[found]))
            if sum(map(len, a)) > 50_000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    return run


def _pairs(a: list, b: list) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.empty((0, 2), np.int64)
    return pa.record_batch({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets -> pairs with 100 * intersection >= 80 * union."""
    for batch in batches:
        good, both = [], []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            both.append(shared)
            good.append(100 * shared >= 80 * (len(one) + len(two) - shared))
        yield pa.record_batch([batch["a"], batch["b"], pa.array(both, pa.int64())], ["a", "b", "shared"]).filter(pa.array(good, pa.bool_()))


def _banded(cells: DataFrame) -> DataFrame:
    """cells, with those of more than TREE_ROWS sets dealt to bands of size; similar sets are in one band or in neighbouring ones, and a set is in two."""
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    large = staged(sizes.where(F.col("rows") > TREE_ROWS).select("cell", F.lit(True).alias("large")), "jaccard-wide")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26)))  # similar sizes differ by a factor of 1.25 at most
    names = F.when(F.col("large"), F.transform(F.array(band, band + 1), lambda b: F.xxhash64("cell", b))).otherwise(F.array("cell"))
    return cells.join(large, "cell", "left").withColumn("cell", F.explode(names)).drop("large")


def _walked(cells: DataFrame, points: DataFrame, every: bool) -> DataFrame:
    """Pairs of doc_ids, each once; cells has cell, doc_id, n and, with every, component.

    A large cell is taken in parts of TREE_ROWS.  The first walk takes each part
    alone.  The last one has no pairs to find within the cell's largest
    component: the other sets, in their own parts, meet each other and the parts
    of the largest.
    """
    cells = _banded(cells)
    parts = lambda rows: F.ceil(rows / TREE_ROWS).cast("long")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1).cast("long")))
    if every:
        counts = cells.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("own"))
        large = counts.groupBy("cell").agg(F.sum("own").alias("rows"), F.max(F.struct("own", "component")).alias("most")).where(F.col("rows") > TREE_ROWS)
        large = large.select("cell", F.col("most.component").alias("most"), parts(F.col("most.own")).alias("p"), parts(F.col("rows") - F.col("most.own")).alias("q"))
        rows = cells.join(staged(large, "jaccard-large"), "cell", "left")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        among = F.transform(upto(F.col("q")), lambda k: F.least(k, own(F.col("q"))) * F.col("q") + F.greatest(k, own(F.col("q"))))
        across = F.transform(upto(F.col("p")), lambda k: F.col("q") * F.col("q") + own(F.col("q")) * F.col("p") + k)
        back = F.transform(upto(F.col("q")), lambda k: F.col("q") * F.col("q") + k * F.col("p") + own(F.col("p")))
        where = F.when(F.col("most").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("q") == 0, F.array().cast("array<long>"))
        where = where.when(F.col("component") == F.col("most"), back).otherwise(F.concat(among, across))
        rows = rows.withColumn("part", F.explode(where)).drop("most", "p", "q")
    else:
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        large = staged(sizes.where(F.col("rows") > TREE_ROWS).select("cell", parts(F.col("rows")).alias("parts")), "jaccard-large")
        rows = cells.join(large, "cell", "left").withColumn("part", own(F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    rows = rows.drop("n").join(points.select("doc_id", "n", "counts"), "doc_id")
    columns = ["cell", "part", "doc_id", "n", "counts", *(["component"] if every else [])]
    dealt = rows.select(*columns).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(_walk(every), "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, several: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sets are made anew, of the documents in pairs alone."""
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-wanted")
    sets = likely_in(docs, wanted, then=_sets, schema="doc_id long, shingles binary").join(wanted, "doc_id")
    sets = staged(_once(sets, several), "jaccard-sets")
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    with_both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long, shared long")


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows without repeats of the ids in several."""
    return rows.join(several, "doc_id", "left_anti").union(rows.join(several, "doc_id", "left_semi").select(*rows.columns).distinct())


def jaccard_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership and links.

    Membership: doc_id, n_shingles, component_id of each row of docs, which has
    doc_id (a whole number) and text.  Links: a, b, shared (shingles) of linked
    documents with different sets; any two linked sets are joined by a path of
    them.  Rows of a null doc_id have no links and a null component_id; a row
    without words has no links and its own id.  Rows that repeat a doc_id are one
    document with all their links.  An empty table gives no rows; other columns
    are left alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    survey = staged(docs.mapInArrow(_survey, "n long, doc_id long, one long, two long"), "jaccard-survey")
    sized = survey.where("n >= 0").select("doc_id", "n", "one", "two")
    known = sized.where("doc_id IS NOT NULL AND n > 0")
    classes = staged(known.groupBy("n", "one", "two").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")), "jaccard-classes")
    shared = classes.where("head < last").drop("last")
    copies = staged(known.join(shared, ["n", "one", "two"]).select("doc_id", "head"), "jaccard-copies")
    # of an id with several sets, each counts
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    several = staged(several, "jaccard-several")
    idle = copies.where("doc_id <> head").select("doc_id").join(several, "doc_id", "left_anti").distinct()
    idle = staged(idle, "jaccard-idle")

    rows = sized.count()
    frequent = survey.where("n < 0").groupBy("one").agg(F.sum(-F.col("n")).alias("often")).where(F.col("often") >= max(8.0, FREQUENT * rows))
    frequent = _most_frequent(staged(frequent, "jaccard-frequent"), LISTED).toPandas()
    order = np.argsort(frequent["one"].to_numpy().view(np.uint64))
    listed = frequent["one"].to_numpy().view(np.uint64)[order], frequent["often"].to_numpy()[order]

    heads = docs.where("doc_id IS NOT NULL").join(idle, "doc_id", "left_anti")
    named = heads.mapInArrow(_named(spark.sparkContext.broadcast(listed), HOT_ROWS), "route long, shingle long, doc_id long, n int, hot boolean")
    # hot shingles are dealt out; the rows of any other stand together
    cells = named.repartition("route").sortWithinPartitions("shingle").mapInArrow(_cells(HOT_ROWS, CELL_ROWS), "cell long, doc_id long, n int").distinct()
    cells = staged(cells, "jaccard-cells")
    members = staged(cells.select("doc_id").distinct(), "jaccard-members")
    points = likely_in(docs, members, then=_points, schema="doc_id long, n int, counts binary").join(members, "doc_id")
    points = staged(_once(points, several), "jaccard-points")

    tried = staged(_walked(cells, points, every=False), "jaccard-pairs")
    links = staged(_verified(tried, docs, several), "jaccard-links")
    joined = staged(connected_components(links), "jaccard-components")
    tagged = cells.join(joined, cells["doc_id"] == joined["node"], "left").select("cell", cells["doc_id"], "n", F.coalesce("component", "doc_id").alias("component"))
    tagged = staged(tagged, "jaccard-tagged")
    open_cells = tagged.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("cell")
    left = _walked(tagged.join(open_cells, "cell", "left_semi"), points, every=True)
    left = staged(left.join(tried, ["a", "b"], "left_anti"), "jaccard-left")
    links = links.union(staged(_verified(left, docs, several), "jaccard-last-links"))

    edges = links.select("a", "b").union(copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    found = staged(connected_components(edges), "jaccard-final")
    heads_of = copies.join(several, "doc_id", "left_anti").where("doc_id <> head").distinct()
    out = sized.alias("d").join(heads_of.alias("c"), "doc_id", "left").withColumn("at", F.coalesce("head", "doc_id"))
    out = out.join(found, F.col("at") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "at").alias("component_id")), links


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates: the one of least id, and of that id the one whose text has the least SHA-256.

    Rows are judged one by one: rows of one id whose texts are not linked all stay,
    and of rows of one id and one text one does, the least as JSON.  Rows without an
    id stay, and so do rows without words, but for repeats of one id and text.  An
    empty table gives no rows.
    """
    counts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = staged(counts.where("_rows > 1").select(F.col("doc_id").alias("_id")), "jaccard-repeated")
    if repeated.isEmpty():
        away = jaccard_classes(docs)[0].where("doc_id <> component_id").select("doc_id")
        return docs.join(staged(away, "jaccard-away"), "doc_id", "left_anti").select(*docs.columns)
    id_, node, digest, least = (free_name(c, docs.columns) for c in ("_id", "_node", "_digest", "_least"))
    repeated = repeated.withColumnRenamed("_id", id_)
    plain = docs.join(repeated, docs["doc_id"] == F.col(id_), "left_anti")
    # rows of one id and text are one; each stands for itself under a number that is no id
    whole = F.struct(*docs.columns)
    several = docs.join(repeated, docs["doc_id"] == F.col(id_), "left_semi").withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("string").cast("binary"), 256), F.lit("")))
    several = several.groupBy("doc_id", digest).agg(F.min_by(whole, F.to_json(whole)).alias(least))
    below_zero = (docs.agg(F.min("doc_id")).first()[0] or 0) < 0
    number = F.xxhash64("doc_id", digest)
    several = staged(several.select(digest, (number if below_zero else -F.pmod(number, F.lit((1 << 63) - 1)) - 1).alias(node), f"{least}.*"), "jaccard-several-rows")

    nodes = plain.select("doc_id", "text").unionByName(several.select(F.col(node).alias("doc_id"), "text"))
    known = several.select(F.col(node).alias("_at"), F.struct(F.col("doc_id").cast("long").alias("id"), F.col(digest).alias("digest")).alias("_known"))
    classes = jaccard_classes(nodes)[0].where("component_id IS NOT NULL").select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_class"))
    ranked = classes.join(known, "_at", "left").withColumn("_known", F.coalesce("_known", F.struct(F.col("_at").alias("id"), F.lit("").alias("digest"))))
    ranked = staged(ranked, "jaccard-ranked")
    heads = ranked.groupBy("_class").agg(F.min("_known").alias("_head"))
    away = staged(ranked.join(heads, "_class").where("_known <> _head").select("_at"), "jaccard-away").withColumnRenamed("_at", id_)
    kept = plain.join(away, plain["doc_id"] == F.col(id_), "left_anti")
    return kept.unionByName(several.join(away, F.col(node) == F.col(id_), "left_anti").select(*docs.columns))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))[0]


SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s),
l AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.a = s.doc_id"""
