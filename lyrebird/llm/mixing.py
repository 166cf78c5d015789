"""Mixing sources to target weights.

Word counts are summed by source, every source gets a target, and each document
is taken floor(target / size of its source) times, and once more where a number
seeded by its id falls under the fraction.  The numbers of a source are turned by
the one of SEEDS equal steps with which the words taken come nearest its target;
one grouped sum finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.staging import free_name, staged, table

#: by rank of the source in code-point order, repeating
WEIGHTS = (5, 2, 1)
#: words that the mix has, as a share of all words
TOTAL_SHARE = 1.5
#: most that a source is repeated
MOST_REPEATS = 2.0
SEED = 17
#: turns of a source's numbers, of which the best is taken; the first of equal ones
SEEDS = 32


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    spaced = F.translate(text, "\t\n\u000b\f\r", "     ")
    # the runs of spaces become one each; what is between the spaces counts
    single = F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))
    gaps = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(F.octet_length(single), F.lit(0)) > 0, gaps + 1).otherwise(0).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """source, source_size, target of a table with source and size.

    Sources stand in code-point order, null last; their weights repeat.  A
    target is the smaller of most * source_size and level * weight, with the one
    level at which the targets sum to share * all sizes.  That is what
    resharing the excess by weight arrives at.  The windows see one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    ordered = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("_below", F.coalesce(F.sum("_cap").over(ordered), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_weight").over(ordered), F.lit(0.0)))
        .withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_weights", F.sum("_weight").over(whole))
        # the level, were this source the first that is not full
        .withColumn("_level", (F.col("_all") - F.col("_below")) / (F.col("_weights") - F.col("_used")))
    )
    open_level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(whole)
    level = F.coalesce(open_level["_level"], F.lit(float("inf")))
    target = F.least(F.col("_cap"), level * F.col("_weight"))
    return filled.select("source", "source_size", target.alias("target"))


def seeded_number(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that the seed and the id fix."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def copies_taken(number: Column, rate: Column, turn: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction: where the number, turned, falls under it."""
    turned = number + turn / F.lit(float(SEEDS))
    turned = F.when(turned >= 1, turned - 1).otherwise(turned)
    whole = F.floor(rate)
    return (whole + F.when(turned < rate - whole, 1).otherwise(0)).cast("long")


def _rate() -> Column:
    return F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))


def source_turns(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with the turn of each source with which it comes nearest its target; sizes has source, size and number."""
    # a source is one row here: Spark broadcasts it below its own threshold and else splits the hot source's join
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.source", "size", "number", "source_size", "target")
    taken = [F.sum(F.col("size") * copies_taken(F.col("number"), _rate(), F.lit(k))).alias(f"taken{k}") for k in range(SEEDS)]
    sums = rows.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), *taken)
    off = F.array(*[F.struct(F.abs(F.col(f"taken{k}") - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(SEEDS)])
    return sums.select("source", "source_size", "target", F.array_min(off)["turn"].alias("turn"))


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_number(F.col("doc_id"), seed).alias("number")), "mix-sizes")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each of docs.

    docs has doc_id, text and source.  A null text has no words; documents of a
    null source form a source of their own, the last; a null doc_id is as good a
    seed as another.  A source without words has target 0 and is taken 0 times.
    Rows that repeat share their decision.  A source of one document is taken
    whole or not at all for its fraction, whichever is nearer.  Other columns are
    left alone.
    """
    sizes = _sizes(docs, options.pop("seed", SEED))
    turns = staged(source_turns(sizes, source_targets(sizes, **options)), "mix-turns")
    planned = sizes.alias("d").join(turns.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return planned.select("d.doc_id", "d.source", "size", "source_size", "target", copies_taken(F.col("number"), _rate(), F.col("turn")).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each document as often as the mix takes it; the same columns.

    A null text is a document of size 0, and sources without words are taken at no
    rate, so their rows go; a null source is a source of its own.  The number of
    copies hangs on doc_id, so rows that repeat an id are taken equally often, and
    null ids share one draw.  An empty table gives no rows.
    """
    seed = options.pop("seed", SEED)
    sizes = _sizes(docs, seed)
    turns = staged(source_turns(sizes, source_targets(sizes, **options)), "mix-turns")
    source, rate, turn, copy = (free_name(f"_mix_{c}", docs.columns) for c in ("source", "rate", "turn", "copy"))
    rates = turns.select(F.col("source").alias(source), _rate().alias(rate), F.col("turn").alias(turn))
    taken = docs.join(rates, docs["source"].eqNullSafe(rates[source]))
    repeats = F.array_repeat(F.lit(0), copies_taken(seeded_number(docs["doc_id"], seed), F.col(rate), F.col(turn)).cast("int"))
    return taken.withColumn(copy, F.explode(repeats)).select(*[docs[c] for c in docs.columns])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
k AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM l
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (ratio, source)) FROM k WHERE ratio >= level), 'inf'::DOUBLE) * weight) AS target FROM k),
r AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS number
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, number + turn / {SEEDS}.0::DOUBLE AS x FROM r, (SELECT unnest(range({SEEDS})) AS turn)),
c AS (SELECT *, CAST(floor(rate) + CASE WHEN x - CASE WHEN x >= 1 THEN 1 ELSE 0 END < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM n),
b AS (SELECT source, arg_min(turn, (off, turn)) AS turn FROM (SELECT source, turn, abs(sum(size * copies) - max(target)) AS off FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.turn = b.turn"""
