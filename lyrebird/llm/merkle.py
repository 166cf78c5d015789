"""A manifest of a dataset as Merkle trees, one a language, with a proof for each row.

A row is a leaf, eight nodes in a row are hashed to their parent, and the roots of
the languages are the leaves of one more tree, whose root stands for the dataset.

1. Leaves are digests of rows; only they are sorted and shuffled, never texts.  A
   leaf's number in its language comes from a sort by ranges and the counts of the
   sorted partitions, so that no language is one task.
2. Leaves are dealt to chunks of 512, and three levels are done in one window over
   each chunk.  Per level, lag and lead columns of fixed offsets, masked by a node's
   slot among its siblings and by the length of their run, supply the siblings; the
   row of the first child hashes the parent; rows below take their node's siblings
   from its first row.
3. The chunks' roots are the rows of the next pass, a 512th as many, until each tree
   has one root.  Paths from the root to a chunk are joined to its rows by the keys
   that the window has dealt them out by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.staging import staged, table

#: children of a node, and levels that one window does
FAN, LEVELS = 8, 3
CHUNK = FAN**LEVELS
#: the columns whose values a leaf covers, in this order
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
#: rows whose CRC of doc_id this divides are tampered with
TAMPERED_OF = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of values read alike: `-` if null, else bytes, colon, text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row's covered values."""
    return digest(*[field(values[c]) for c in COVERED])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _i, their number from 0 in their tree _g by the columns of order, and _n, the rows of the tree.

    Equal rows are numbered in any order.  The rows sorted by ranges are written, and
    each written partition's counts, a row for each partition and tree, are all that
    is summed.
    """
    told = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    keys = ["_g", *order, "_row"]
    ranged = told.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged, "merkle-sorted").withColumn("_part", F.shiftright("_at", 33))
    tree = Window.partitionBy("_g")
    counts = ranged.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_count").over(tree).alias("_n")), "merkle-counts")
    return ranged.join(counts, ["_g", "_part"]).withColumn("_i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """nodes (_g, _i, _n, _h) with their path of up to three levels, their chunk's number, root and count of roots.

    _path is an array of (left, right), the siblings' digests to both sides; a level
    is there while the tree has several nodes.  _root is of the chunk and stands in
    its first row alone.
    """
    over = "OVER (PARTITION BY _g, _chunk ORDER BY _i)"
    out = nodes.selectExpr("*", f"_i div {CHUNK} AS _chunk", "_h AS _h0", "_n AS _m0")
    for level in range(LEVELS):
        step, h, m = FAN**level, f"_h{level}", f"_m{level}"
        out = out.selectExpr("*", f"_i div {step} % {FAN} AS _slot", f"least({FAN}, {m} - _i div {step} + _i div {step} % {FAN}) AS _run", f"_i % {step} = 0 AS _top")
        lags = [f"CASE WHEN _slot >= {k} THEN lag({h}, {k * step}) {over} END" for k in range(FAN - 1, 0, -1)]
        leads = [f"CASE WHEN _slot + {k} < _run THEN lead({h}, {k * step}) {over} END" for k in range(1, FAN)]
        out = out.selectExpr("*", f"concat_ws('', {', '.join(lags)}) AS _left", f"concat_ws('', {', '.join(leads)}) AS _right")
        # the row of the first child hashes the parent; rows below a node take the siblings in its first row
        out = out.selectExpr(
            "* EXCEPT (_slot, _run, _top, _left, _right)",
            f"CASE WHEN _top AND _slot = 0 THEN CASE WHEN {m} > 1 THEN sha2(CAST(concat({h}, _right) AS binary), 256) ELSE {h} END END AS _h{level + 1}",
            f"last(CASE WHEN _top AND {m} > 1 THEN struct(_left AS left, _right AS right) END, true) {over} AS _p{level}",
            f"({m} + {FAN - 1}) div {FAN} AS _m{level + 1}",
        )
    levels = ", ".join(f"_p{level}" for level in range(LEVELS))
    own = ", ".join(f"_h{level}, _m{level}, _p{level}" for level in range(LEVELS))
    return out.selectExpr(f"* EXCEPT ({own}, _h{LEVELS}, _m{LEVELS})", f"array_compact(array({levels})) AS _path", f"_h{LEVELS} AS _root", f"_m{LEVELS} AS _m")


def trees(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The climbed rows of each pass, one at least, and (_g, _i = 0, _h) of the root of every tree."""
    most = nodes.agg(F.max("_n")).first()[0] or 1
    passes = []
    while not passes or most > 1:
        passes.append(climbed(nodes))
        nodes = staged(passes[-1].where("_root IS NOT NULL").selectExpr("_g", "_chunk AS _i", "_m AS _n", "_root AS _h"), f"merkle-{name}")
        most = -(-most // CHUNK)
    return passes, nodes


def descended(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first pass with the whole path up to above (_g, _i, _path and more), which has a row for each tree."""
    for rows in reversed(passes):
        upper = above.withColumnsRenamed({"_i": "_chunk", "_path": "_upper"})
        above = rows.drop("_m", "_root", "_n", "_h").join(upper, ["_g", "_chunk"]).withColumn("_path", F.concat("_path", "_upper")).drop("_chunk", "_upper")
    return above


def proven(leaves: DataFrame) -> DataFrame:
    """leaves (tree string, leaf, _order and more) with path (array of (left, right)), subroot and root.

    Trees are by the column tree, null first, and in a tree leaves are in order of
    _order (null first) and then of their digest; equal leaves of one _order stand
    side by side.  No rows give no rows.
    """
    code = F.coalesce(F.concat(F.lit("."), "tree"), F.lit(""))  # in the order of trees, and never null
    below, roots = trees(numbered(leaves.withColumn("_g", code), "_order", "leaf").withColumn("_h", F.col("leaf")), "nodes")
    roots = roots.selectExpr("'' AS _g", "_g AS _tree", "_h AS subroot")
    above, root = trees(numbered(roots, "_tree").withColumn("_h", F.col("subroot")), "roots")
    top = root.selectExpr("_g", "_i", "_h AS root", "array_compact(array(CAST(null AS struct<left: string, right: string>))) AS _path")
    tops = descended(above, top).selectExpr("_tree AS _g", "0L AS _i", "_path", "subroot", "root")
    return descended(below, staged(tops, "merkle-tops")).withColumnRenamed("_path", "path").drop("_g", "_i")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def siblings_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda x: F.array(x["left"], x["right"]))), ""))


def manifest(docs: DataFrame, later: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, path, subroot and root of each row, and later_leaf, the leaf with the text that later gives.

    docs has doc_id, text, lang, source and n_chars; other columns stand for nothing.
    Nulls of any column are told from empty values; rows of a null lang are a tree of
    their own, which comes first, and null ids come first in their tree.  Rows of one
    id are in order of their digest, and rows equal in all covered columns are leaves
    side by side, each with its own proof.  An empty table has no rows and no root.
    Verification is to fold a leaf with its path and compare with the root.
    """
    values = {c: docs[c] for c in COVERED}
    own = leaf(values)
    rows = docs.select(
        values["doc_id"].cast("long").alias("doc_id"), values["doc_id"].cast("long").alias("_order"), values["lang"].cast("string").alias("tree"),
        own.alias("leaf"), (leaf(values | {"text": later}) if later is not None else F.lit(None).cast("string")).alias("later_leaf"),
    )
    rows = rows.withColumn("later_leaf", F.nullif("later_leaf", "leaf"))  # only what differs is carried
    out = proven(rows).withColumn("later_leaf", F.coalesce("later_leaf", "leaf")) if later is not None else proven(rows)
    return out.select("doc_id", F.col("tree").alias("lang"), "leaf", *(["later_leaf"] if later is not None else []), "path", "subroot", "root")


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where the CRC of doc_id asks for it, else the text."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED_OF == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, roots and proof, and whether the row, tampered with where its id asks for it, still proves.

    Nulls, ties, repeated rows and empty tables are as manifest has them; a null
    doc_id is never tampered with.
    """
    rows = manifest(docs, tampered(docs["doc_id"], docs["text"].cast("string")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.col("later_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def _sql(levels: int = 9, tops: int = 4) -> str:
    """The same level by level, for trees of up to 8**levels leaves and 8**tops languages."""
    part = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    covered = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COVERED) + ")"
    steps = [rf"""
rows AS (SELECT doc_id, coalesce('.' || lang, '') AS g, {covered("text")} AS leaf, CASE WHEN xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % {TAMPERED_OF} = 0
  THEN {covered(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS later FROM documents),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m, leaf AS h, doc_id, coalesce(later, leaf) AS later FROM rows)"""]
    def climb(name: str, n: int) -> None:
        for k in range(n):
            steps.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, (any_value(m) + 7) // 8 AS m, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, i // 8)")
            steps.append(f"{name}s{k} AS (SELECT g, i, m, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
    climb("a", levels)
    steps.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m, h, g AS tree FROM a{levels})")
    climb("b", tops)
    steps.append("f0 AS (SELECT g, i, doc_id, h AS leaf, later AS f, '' AS proof FROM a0)")
    for k in range(levels):
        steps.append(f"f{k + 1} AS (SELECT f.g, f.i // 8 AS i, doc_id, leaf, CASE WHEN m > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN m > 1 THEN proof || l || r ELSE proof END AS proof FROM f{k} f JOIN as{k} s ON f.g = s.g AND f.i = s.i)")
    steps.append(f"t0 AS (SELECT b.i, doc_id, leaf, f, proof, b.h AS subroot FROM f{levels} f JOIN b0 b ON f.g = b.tree)")
    for k in range(tops):
        steps.append(f"t{k + 1} AS (SELECT t.i // 8 AS i, doc_id, leaf, CASE WHEN m > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN m > 1 THEN proof || l || r ELSE proof END AS proof, subroot FROM t{k} t JOIN bs{k} s ON t.i = s.i)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id::BIGINT AS doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM t{tops} t JOIN b{tops} b ON t.i = b.i"


SQL = _sql()
