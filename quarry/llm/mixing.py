"""Mixing sources to target weights (operator 7) by hash-threshold histograms.

Each document has a hash of 36 bits. Words are summed by source and the hash's first 12 bits; in each source the bucket
in which the running sum passes the budget is the boundary, and only the documents in it are summed again by the next 12
bits, then once more. The result is one threshold a source: documents hashed below it are in. Nothing is sorted but the
histograms, reruns agree, and a larger budget's documents include a smaller one's.

Shares: the sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all words by weight.
A target stops at `most` times its source's words; the excess is shared again by weight until none is above. Each
document is taken floor(target / words) times, and once more below the threshold of what remains.

Defined results: a null text has no words; a null source is a source of its own; a source without words has target 0 and
its documents are taken 0 times; rows with equal doc_ids are in or out together; a null doc_id hashes like an empty
name; texts of any length are counted whole; an empty table gives an empty result; other columns of the input are ignored
by `mix` and kept, whatever their names, by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

WEIGHTS = (1, 2, 3)
MOST = 3
LEVEL_BITS, LEVELS = 12, 3


def hashed(doc_id: Column) -> Column:
    """36 bits of the id's md5, which DuckDB has too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def key_of(source: Column) -> Column:
    """A key that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, hash."""
    source = F.col("source").cast("string")
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", source.alias("source"), key_of(source).alias("key"), words.alias("size"), hashed(F.col("doc_id")).alias("hash"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """key, source_size, target, times (whole passes), budget (words beyond them): one row a source."""
    sources = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    # summaries of one row a source: their order needs them together
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.select("key", "source_size", weight.cast("double").alias("weight")).withColumns({"cap": (F.col("source_size") * most).cast("double")})
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    # in order of ratio: once the sources before this one have stopped, what is the rest's share for a weight of 1?
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    share = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    shared = weighed.withColumn("share", share)
    level = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "key", "share"))).over(everything)["share"]
    target = F.least(F.col("cap"), F.coalesce(level, zero) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    return shared.withColumn("target", target).withColumn("times", whole).select("key", "source_size", "target", "times", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))


def thresholds(sizes: DataFrame, budgets: DataFrame, keep: list[str]) -> DataFrame:
    """budgets (key, budget and more) with `below`: documents whose hash is less make up the budget, as nearly as hashes allow."""
    state = budgets.withColumns({"bound": F.lit(None).cast("long"), "base": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        prefix = F.shiftright(F.col("hash"), shift).alias("prefix")
        rows = sizes
        if level > 1:
            edge = common.small(state.select("key", "bound").filter("bound is not null"))
            rows = sizes.join(edge, (sizes["key"] == edge["key"]) & (F.shiftright(F.col("hash"), shift + LEVEL_BITS) == edge["bound"])).select(sizes["key"], "hash", "size")
        sums = rows.groupBy("key", prefix).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("prefix")) + F.col("base")
        # at most 4096 buckets a source
        run = sums.join(state.select("key", "budget", "base"), "key").withColumn("upto", upto)
        over = F.col("upto") > F.col("budget")
        found = run.groupBy("key").agg(F.min(F.when(over, F.struct("prefix", "upto"))).alias("first"), F.max(F.when(~over, F.col("upto"))).alias("under"))
        last = state.drop("bound").withColumnRenamed("base", "was").join(found, "key", "left")
        state = common.settle(last.select(*budgets.columns, F.col("first.prefix").alias("bound"), F.coalesce("under", "was").alias("base"), F.col("first.upto").alias("upto")), keep)
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("base")
    below = F.coalesce(F.col("bound") + nearer.cast("long"), F.lit(1 << LEVEL_BITS * LEVELS))
    return state.select(*budgets.columns, F.when(F.col("budget") <= 0, F.lit(0).cast("long")).otherwise(below).alias("below"))


def planned(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The settled sizes of docs, and one row a source with its key, source_size, target, times and below."""
    keep: list[str] = []
    sizes = common.settle(sized(docs))
    plan = common.settle(targets(sizes, most), keep)
    plan = common.settle(thresholds(sizes, plan, keep))
    common.drop(docs.sparkSession, keep)
    return sizes, plan


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and times, how often the mix takes the document."""
    sizes, plan = planned(docs, most)
    taken = F.col("times") + (F.col("hash") < F.col("below")).cast("long")
    return sizes.join(common.small(plan), "key").select("doc_id", "source", "size", "source_size", "target", taken.alias("times"))


def mixed(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of docs as often as the mix takes them. The thresholds go to the rows; texts aren't shuffled for it."""
    key, times, below, copy = common.unused(docs, "key", "times", "below", "copy")
    plan = planned(docs, most)[1].select(F.col("key").alias(key), F.col("times").alias(times), F.col("below").alias(below))
    rows = docs.join(common.small(plan), key_of(docs["source"].cast("string")) == F.col(key))
    taken = F.col(times) + (hashed(docs["doc_id"]) < F.col(below)).cast("long")
    return rows.filter(taken > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), taken))).drop(key, times, below, copy)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS share
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (SELECT coalesce(arg_min(share, ratio), 0.0) FROM l WHERE share <= ratio) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS times FROM t),
b AS (SELECT *, target - times * source_size AS budget FROM p),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
c AS (SELECT g.*, budget, sum(g.size) OVER (PARTITION BY g.source ORDER BY h)::BIGINT AS upto FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
f AS (SELECT source, arg_min(h, h) FILTER (WHERE upto > budget) AS bound, min(upto) FILTER (WHERE upto > budget) AS upto,
             coalesce(max(upto) FILTER (WHERE upto <= budget), 0) AS base FROM c GROUP BY source),
k AS (SELECT b.*, CASE WHEN budget <= 0 THEN 0
             ELSE coalesce(bound + CASE WHEN f.upto - budget < budget - f.base THEN 1 ELSE 0 END, 68719476736) END AS below
      FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, k.source_size, k.target, d.size * (k.times + CASE WHEN d.h < k.below THEN 1 ELSE 0 END) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
