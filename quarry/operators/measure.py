"""Retrieval metrics, audits and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import search


def per_query(qrels: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, recall5, recall10, recall20, rr, ndcg10 of qrels (query_id, item_key, null where nothing is expected) and ranked (query_id, item_key, rank).

    A paper counts at its first rank. Queries that expect nothing have recall 1, reciprocal rank 0 and NDCG 1."""
    first = ranked.groupBy("query_id", "item_key").agg(F.min("rank").alias("rank"))
    seen = qrels.join(first, ["query_id", "item_key"], "left")
    n = F.count("item_key")
    recall = lambda k: F.when(n == 0, 1.0).otherwise(F.count(F.when(F.col("rank") <= k, 1)) / n).alias(f"recall{k}")
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = seen.groupBy("query_id").agg(n.alias("n"), recall(5), recall(10), recall(20), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), gain.alias("gain"))
    ndcg = F.when(F.col("n") == 0, 1.0).otherwise(F.col("gain") / F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(10))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
    return out.select("query_id", "recall5", "recall10", "recall20", "rr", ndcg.alias("ndcg10"))


def macro(per: DataFrame) -> DataFrame:
    """Averages over all (category null) and by category, in one pass."""
    cols = ("recall5", "recall10", "recall20", "rr", "ndcg10")
    return per.rollup("category").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in cols))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (x.select("query_id", F.col("recall5").alias(f"r{n}"), F.col("rr").alias(f"m{n}")) for x, n in ((before, "a"), (after, "b")))
    d = F.col("mb") - F.col("ma")
    return a.join(b, "query_id").agg(F.round(F.avg(F.col("rb") - F.col("ra")), 4).alias("recall5_delta"), F.round(F.avg(d), 4).alias("mrr_delta"), F.count(F.when(d > 0, 1)).alias("improved"), F.count(F.when(d < 0, 1)).alias("regressed"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, overlap at k, and Spearman's rank correlation over what both have, of two rankings (query_id, item_key, rank)."""
    both = a.filter(F.col("rank") <= k).select("query_id", "item_key", F.col("rank").alias("ra")).join(b.filter(F.col("rank") <= k).select("query_id", "item_key", F.col("rank").alias("rb")), ["query_id", "item_key"])
    w = Window.partitionBy("query_id")
    placed = both.withColumns({"pa": F.row_number().over(w.orderBy("ra")), "pb": F.row_number().over(w.orderBy("rb"))})
    n = F.count("*")
    rho = F.when(n > 1, 1 - 6 * F.sum((F.col("pa") - F.col("pb")) * (F.col("pa") - F.col("pb"))) / (n * (n * n - 1)))
    return placed.groupBy("query_id").agg((n / k).alias("overlap"), rho.alias("spearman"))


def quality(chunks: DataFrame, short: int, garbled: Column) -> DataFrame:
    """item_key, n_chunks, shares of short and garbled chunks, score 0 to 100, grade.

    Penalties: 40 for short, 50 for garbled, in proportion; 30 for one chunk alone; a bonus of 5 for ten chunks or more."""
    n = F.count("*")
    out = chunks.groupBy("item_key").agg(n.alias("n_chunks"), (F.count(F.when(F.length("text") < short, 1)) / n).alias("short_share"), (F.count(F.when(garbled, 1)) / n).alias("garbled_share"))
    raw = 100 - 40 * F.col("short_share") - 50 * F.col("garbled_share") - F.when(F.col("n_chunks") < 2, 30).otherwise(0) + F.when(F.col("n_chunks") >= 10, 5).otherwise(0)
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2)
    return out.select("item_key", "n_chunks", F.round("short_share", 6).alias("short_share"), F.round("garbled_share", 6).alias("garbled_share"), score.alias("score"))


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row: the element at place n // 2 of the ascending values, without interpolation; by counts, so nothing is gathered."""
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value__"))
    counts = values.groupBy("value__").agg(F.count("*").alias("count__"))
    total = counts.agg(F.sum("count__").alias("total__"))
    upto = F.sum("count__").over(Window.orderBy("value__"))
    # the total is one row
    return counts.withColumn("upto__", upto).crossJoin(F.broadcast(total)).filter(F.col("upto__") > F.floor(F.col("total__") / 2)).agg(F.min("value__").alias("median"))


#: Bytes of sums that a task holds before it gives them out.
HELD_BYTES = 64 << 20


def _sums(frames: Iterator[pd.DataFrame], gram: bool) -> Iterator[pd.DataFrame]:
    """item_key, n, q and q2 (sums of squared lengths and their squares), s (sum vector), g (Gram matrix of coordinates)."""
    held: dict[str, list] = {}

    def out() -> pd.DataFrame:
        rows = [(k, n, q, q2, s.tolist(), None if g is None else g.reshape(-1).tolist()) for k, (n, q, q2, s, g) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["item_key", "n", "q", "q2", "s", "g"])

    for frame in frames:
        for key, part in frame.groupby("item_key"):
            x = np.stack(part["embedding"].to_numpy()).astype(float)
            own = (x**2).sum(axis=1)
            now = held.setdefault(key, [0, 0.0, 0.0, 0.0, 0.0 if gram else None])
            for i, v in enumerate((len(x), own.sum(), (own**2).sum(), x.sum(axis=0), x.T @ x if gram else None)):
                now[i] = None if v is None else now[i] + v
            if len(held) * 8 * x.shape[1] * (x.shape[1] if gram else 1) > HELD_BYTES:
                yield out()
    if held:
        yield out()


def _group_sums(vectors: DataFrame, gram: bool = False) -> DataFrame:
    """One row a task and item at least; nothing of the size of a vector's square is shuffled for each vector."""
    return vectors.select("item_key", "embedding").mapInPandas(partial(_sums, gram=gram), "item_key string, n long, q double, q2 double, s array<double>, g array<double>")


def _squared(parts: DataFrame, column: str, name: str) -> DataFrame:
    """item_key and the sum of the squares of an array's sums."""
    each = parts.select("item_key", F.posexplode(column).alias("i", "x")).groupBy("item_key", "i").agg(F.sum("x").alias("x"))
    return each.groupBy("item_key").agg(F.sum(F.col("x") * F.col("x")).alias(name))


def group_similarity(vectors: DataFrame) -> DataFrame:
    """item_key, n, mean and population deviation of the dot products of all pairs in a group (item_key, embedding of unit length).

    The mean comes from the sum vector, without pairs: |sum|^2 less the squares, halved. The second moment likewise from the
    Gram matrix of coordinates, summed by group in the tasks first."""
    parts = _group_sums(vectors, gram=True)
    own = parts.groupBy("item_key").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("q2").alias("q2")).filter("n > 1")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("s2") - F.col("q")) / 2 / pairs
    return own.join(_squared(parts, "s", "s2"), "item_key").join(_squared(parts, "g", "g2"), "item_key").select("item_key", "n", mean.alias("mean_sim"), F.sqrt(F.greatest(F.lit(0.0), (F.col("g2") - F.col("q2")) / 2 / pairs - mean * mean)).alias("std_sim"))


def centroids(vectors: DataFrame) -> DataFrame:
    """item_key, n, centroid: the mean vector of each group."""
    parts = _group_sums(vectors)
    n = parts.groupBy("item_key").agg(F.sum("n").alias("n"))
    sums = parts.select("item_key", F.posexplode("s").alias("i", "x")).groupBy("item_key", "i").agg(F.sum("x").alias("x")).groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return n.join(sums, "item_key").select("item_key", "n", F.transform("s", lambda v: v["x"] / F.col("n")).alias("centroid"))


def similar_papers(vectors: DataFrame, k: int) -> DataFrame:
    """key_a < key_b, sim: the k pairs of papers with the most similar centroids.

    Each paper's k best come from a search in blocks, so pairs aren't formed; the best k of all are among them."""
    c = centroids(vectors)
    size = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
    unit = c.select(F.xxhash64("item_key").alias("id"), "item_key", size.alias("size"), "centroid").filter("size > 0")
    unit = unit.select("id", "item_key", F.transform("centroid", lambda x: x / F.col("size")).alias("embedding"))
    asked = unit.select(F.col("id").alias("query_id"), F.col("item_key").alias("own"), "embedding")
    near = search.dense(unit, asked, k, own="own").join(asked.select("query_id", "own"), "query_id")
    pairs = near.select(F.least("own", "item_key").alias("key_a"), F.greatest("own", "item_key").alias("key_b"), F.col("score").alias("sim"))
    return pairs.groupBy("key_a", "key_b").agg(F.max("sim").alias("sim")).orderBy(F.round("sim", 6).desc(), "key_a", "key_b").limit(k)


#: Separation, share of outliers, length correlation and similarity of papers beyond which something is wrong, and the
#: coherence below which a section is weak.
WEAK, OUTLIERS, DRIFT, ALIKE, COHERENT = 1.3, 0.1, 0.3, 0.85, 0.4


def issues(summary: DataFrame) -> DataFrame:
    """summary (separation_ratio, outliers, sampled, length_correlation, top_similarity and keys) with a row for each issue."""
    r = F.col("length_correlation")
    rules = {
        "weak_separation": F.col("separation_ratio") < WEAK,
        "outliers": F.col("outliers") > F.col("sampled") * OUTLIERS,
        "long_chunks_drift": r < -DRIFT,
        "short_chunks_lack_context": r > DRIFT,
        "similar_papers": F.col("top_similarity") > ALIKE,
    }
    return summary.withColumn("issue", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))))


def weak_sections(by_section: DataFrame) -> DataFrame:
    """Sections (section, mean) of low coherence; plain content isn't judged."""
    return by_section.filter((F.col("section") != "content") & (F.col("mean") < COHERENT))


def trace_stats(log: DataFrame) -> DataFrame:
    """strategy, n, errors, mean latency of a retrieval log (strategy, success, latency_ms)."""
    return log.groupBy("strategy").agg(F.count("*").alias("n"), F.count(F.when(~F.col("success"), 1)).alias("errors"), F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"))
