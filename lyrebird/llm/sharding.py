"""Shards of near-equal bytes by a k-d tree.

The metadata dimensions are size, source and lang, each scaled to its own range.
A node that is to become k shards is cut at the weighted quantile (k // 2) / k of
its widest dimension, until every leaf is one shard.
The quantiles come from histograms that Spark sums over all rows: each pass
looks only at the bucket that holds the cut and splits it further.  The driver
sees one row for a node, never rows of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.staging import staged, table

SHARDS = 24
#: buckets of one histogram
FAN = 1 << 16
#: bits of a coordinate: the value in its dimension, and below it what orders equal values, text first and then id
VALUE_BITS, TEXT_BITS, ID_BITS = 16, 18, 28
BITS = VALUE_BITS + TEXT_BITS + ID_BITS
#: a cut is fine enough when its bucket holds this share of a shard
FINE = 0.0005
#: rows numbered together within a shard
SLOT_ROWS = 100_000

_TIE = TEXT_BITS + ID_BITS
_TOP = (1 << VALUE_BITS) - 1


def _metadata(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), "source", "lang")


def _coordinates(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and three coordinates below 2**BITS for each row of metadata.

    Values are the logarithm of the size and the ranks of source and lang in
    code-point order, null last, each from 0 for the least in the table to the
    same top for the greatest.  Equal values are ordered by text first, so that
    copies stay neighbours, then by id, so that a cut can pass through any number
    of them.  The windows see a row for each pair of source and lang.
    """
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = lambda c: F.dense_rank().over(Window.orderBy(F.col(c).asc_nulls_last())) - 1
    groups = rows.groupBy("source", "lang").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    groups = groups.withColumn("s", rank("source")).withColumn("l", rank("lang"))
    groups = groups.select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.min("low").over(whole).alias("_low"), F.max("high").over(whole).alias("_high"),
        *[F.floor(F.col(c) * _TOP / F.greatest(F.max(c).over(whole), F.lit(1))).alias(f"_{c}") for c in ("s", "l")],
    )
    joined = rows.join(groups, rows["source"].eqNullSafe(groups["_source"]) & rows["lang"].eqNullSafe(groups["_lang"]))
    log = lambda c: F.log2(F.col(c).cast("double"))
    size = F.floor((log("size") - log("_low")) * _TOP / F.greatest(log("_high") - log("_low"), F.lit(1e-9)))
    tie = F.shiftleft(F.shiftright("text_crc32", 32 - TEXT_BITS), ID_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    values = {"x0": F.least(size, F.lit(_TOP)), "x1": F.col("_s"), "x2": F.col("_l")}
    return joined.select("doc_id", "size", "text_crc32", *[(F.shiftleft(v.cast("long"), _TIE) + tie).alias(c) for c, v in values.items()])


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A table of a row a node, to be broadcast: there are never more nodes than shards."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(f"({', '.join(map(str, r))})" for r in rows)} AS t({names})"))


def _coordinate():
    return F.element_at(F.array("x0", "x1", "x2"), F.col("dim") + 1)


def _cuts(rows: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """node -> the first coordinate on its right side."""
    spark = rows.sparkSession
    span = {n: (0, 1 << BITS) for n in nodes}
    before = dict.fromkeys(nodes, 0)
    cuts: dict[int, int] = {}
    while todo := [n for n in nodes if n not in cuts]:
        wide = {n: max(1, (span[n][1] - span[n][0]) // FAN) for n in todo}
        asked = _values(
            spark, "node, dim, low, high, width, start, goal",
            [(n, nodes[n]["dim"], f"{span[n][0]}L", f"{span[n][1]}L", f"{wide[n]}L", f"{before[n]}L", f"{nodes[n]['goal']!r}D") for n in todo],
        )
        mass = (
            rows.join(asked, "node")
            .where((_coordinate() >= F.col("low")) & (_coordinate() < F.col("high")))
            .select("node", "size", F.expr("(element_at(array(x0, x1, x2), dim + 1) - low) div width").alias("bucket"))
            .groupBy("node", "bucket")
            .agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("n"))
        )
        running = mass.join(asked, "node").withColumn(
            "upto", F.col("start") + F.sum("mass").over(Window.partitionBy("node").orderBy("bucket"))
        )
        # of each node the bucket in which the running sum passes the goal, else the last
        hit = running.groupBy("node").agg(
            F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bucket", "mass", "upto", "n"))).alias("first"),
            F.max(F.struct("bucket", "mass", "upto", "n")).alias("last"),
        )
        for r in hit.collect():  # a row a node
            n, b = r["node"], r["first"] or r["last"]
            left = span[n][0] + b["bucket"] * wide[n]
            right, below = left + wide[n], b["upto"] - b["mass"]
            if wide[n] == 1 or b["n"] == 1 or b["mass"] <= nodes[n]["fine"]:
                cuts[n] = right if abs(b["upto"] - nodes[n]["goal"]) <= abs(below - nodes[n]["goal"]) else left
            else:
                span[n], before[n] = (left, right), below
    return cuts


def kd_shards(docs: DataFrame, shards: int = SHARDS, fine: float = FINE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each of docs.

    Shards are as equal in bytes as cuts between rows allow.  A null text has no
    bytes; null ids, sources and langs are values like others.  Rows with equal
    text lie side by side in every dimension, so that they part only where a cut
    falls among them; rows alike in text and id never part.  Slots count from 0
    without a gap in each shard.
    An empty table gives no rows.  Other columns are left alone.
    """
    rows = staged(_coordinates(staged(_metadata(docs), "kd-metadata")), "kd-rows").withColumn("node", F.lit(0))
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    nodes, first_shard, next_node = {0: shards}, {0: 0}, 1
    while total and any(k > 1 for k in nodes.values()):
        inner = [n for n, k in nodes.items() if k > 1]
        spans = [F.coalesce(F.stddev_pop(F.shiftright(f"x{d}", _TIE).cast("double")), F.lit(0.0)).alias(f"w{d}") for d in range(3)]
        plan = {}
        for r in rows.where(F.col("node").isin(inner)).groupBy("node").agg(F.sum("size").alias("mass"), *spans).collect():
            n, wide = r["node"], [r[f"w{d}"] for d in range(3)]
            plan[n] = {"dim": wide.index(max(wide)), "goal": r["mass"] * (nodes[n] // 2) / nodes[n], "fine": fine * share}
        cuts = _cuts(rows, plan)
        moves = []
        for n in inner:
            k, left, right = nodes.pop(n), next_node, next_node + 1
            next_node += 2
            nodes[left], nodes[right] = k // 2, k - k // 2
            first_shard[left], first_shard[right] = first_shard[n], first_shard[n] + k // 2
            if n in plan:
                moves.append((n, plan[n]["dim"], f"{cuts[n]}L", left, right))
        moves += [(n, 0, "0L", n, n) for n, k in nodes.items() if k == 1]
        rows = rows.join(_values(docs.sparkSession, "node, dim, cut, a, b", moves), "node")
        rows = rows.withColumn("node", F.when(_coordinate() < F.col("cut"), F.col("a")).otherwise(F.col("b"))).drop("dim", "cut", "a", "b")
        rows = staged(rows, "kd-level")  # else the plan of a level holds those of all before
    names = _values(docs.sparkSession, "node, shard", [(n, first_shard[n]) for n in nodes])
    return _slots(rows.join(names, "node").select("doc_id", "size", "text_crc32", "shard"), "shard")


def _slots(rows: DataFrame, shard: str) -> DataFrame:
    """Number the rows of each shard from 0, in parts that many tasks share."""
    count = rows.count()
    parts = max(16, count // SLOT_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    sums = rows.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy(shard, "_part").orderBy("text_crc32", "doc_id", "size")
    numbered = rows.withColumn("_k", F.row_number().over(own) - 1)
    return numbered.join(starts, [shard, "_part"]).withColumn("slot", (F.col("_from") + F.col("_k")).cast("long")).drop("_part", "_from", "_k")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
