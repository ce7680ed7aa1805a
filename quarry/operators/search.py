"""Sparse and dense retrieval in batches of queries, fusion, tiers and diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
#: Queries whose vectors go to the executors at once.
QUERY_BLOCK = 1024


def tokenised(chunks: DataFrame) -> DataFrame:
    """The sparse index, a row a chunk: chunk_id, item_key, tokens (repeats stay, none is an empty list)."""
    none = F.array().cast("array<string>")
    return chunks.select("chunk_id", "item_key", F.coalesce(T.tokens(F.col("text")), none).alias("tokens"))


def totals(index: DataFrame) -> DataFrame:
    """One row: n, the number of chunks, those without tokens too, and avgdl, their mean number of tokens."""
    return index.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(index: DataFrame) -> DataFrame:
    """token, df, idf: negative values become EPSILON times the mean over the vocabulary."""
    df = index.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # the totals and the mean are single rows
    scored = df.crossJoin(F.broadcast(index.agg(F.count("*").alias("n")))).select("token", "df", raw.alias("raw"))
    mean = scored.agg(F.avg("raw").alias("mean"))
    return scored.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, index: DataFrame, k: int | None = None, by: str = "chunk_id", known: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, item_key, score above 0, of queries (query_id, text); repeated query tokens count each time.

    With k, the k best of each query, by chunks or (by="item_key", without chunk_id) by papers with their best chunk's
    score. Chunks are scored where they are: a task weighs its chunks' tokens, multiplies them with a block of queries and
    keeps k of each, so no row of a query and a token is formed. `known` is a stored idf (sinks.write_index); otherwise it
    is counted from the index, which is then read twice."""
    total = totals(index).first()
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighed = asked.join(known if known is not None else idf(index), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("w"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = weighed.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id", "token").toArrow()
        part = _sparse_block(index, Weights.of(block), total.avgdl or 1.0, k, by)
        out = part if out is None else out.unionByName(part)
    if k is None:
        return out
    return top(out, k, by).drop("rank")


@dataclass
class Weights:
    """Queries of a block by their tokens' weights; parts of PART queries have a matrix of their own."""

    parts: list[tuple[np.ndarray, dict[str, int], np.ndarray]]

    PART = 128

    @classmethod
    def of(cls, block: pa.Table) -> Weights:
        ids, tokens, w = block["query_id"].to_numpy(), block["token"].to_pylist(), block["w"].to_numpy()
        parts, names = [], np.unique(ids)
        for i in range(0, len(names), cls.PART):
            own = names[i : i + cls.PART]
            rows = np.flatnonzero((ids >= own[0]) & (ids <= own[-1]))
            place = {t: n for n, t in enumerate(sorted({tokens[r] for r in rows}))}
            matrix = np.zeros((len(own), len(place)))
            matrix[np.searchsorted(own, ids[rows]), [place[tokens[r]] for r in rows]] = w[rows]
            parts.append((own, place, matrix))
        return cls(parts)


#: Numbers in the matrix of asked tokens by chunks.
CELLS = 1 << 22


def _scores(batch: pa.RecordBatch, weights: Weights, avgdl: float) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """Query ids, chunks of the batch, and their scores."""
    lists = batch.column("tokens")
    flat = lists.flatten().dictionary_encode()
    words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    norm = K1 * (1 - B + B * sizes / avgdl)
    for ids, place, matrix in weights.parts:
        of = np.array([place.get(x, -1) for x in words], np.int64)[codes] if len(words) else np.empty(0, np.int64)
        step = max(1, CELLS // max(1, len(place)))
        for i in range(0, len(sizes), step):
            stop = min(i + step, len(sizes))
            mine = (of >= 0) & (chunk >= i) & (chunk < stop)
            tf = np.bincount((chunk[mine] - i) * len(place) + of[mine], minlength=(stop - i) * len(place)).reshape(stop - i, len(place)).astype(float)
            yield ids, slice(i, stop), matrix @ (tf * (K1 + 1) / (tf + norm[i:stop, None])).T


def _sparse_block(index: DataFrame, weights: Weights, avgdl: float, k: int | None, by: str) -> DataFrame:
    papers = by == "item_key"
    columns = ["query_id", "item_key", "score"] if papers else ["query_id", "chunk_id", "item_key", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, tuple]] = {}
        floor: dict[int, float] = {}

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.string()] * (len(columns) - 2), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], columns)

        for batch in batches:
            items, names = batch.column("item_key").to_pylist(), batch.column("chunk_id").to_pylist()
            for ids, of, scores in _scores(batch, weights, avgdl):
                if k is None:
                    q, c = np.nonzero(scores > 0)
                    at = pa.array(of.start + c)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column("chunk_id").take(at), batch.column("item_key").take(at), pa.array(scores[q, c])], columns)
                    continue
                for q, row in zip(ids.tolist(), scores, strict=True):
                    # equal scores are equal to 9 decimals; those at the edge all stay until they are put in order
                    near = np.round(row, 9)
                    edge = floor.get(q, 0.0)
                    if len(near) > k and not papers:
                        edge = max(edge, np.partition(near, len(near) - k)[len(near) - k])
                    mine = held.setdefault(q, {})
                    for c in np.flatnonzero((row > 0) & (near >= edge)):
                        name = (items if papers else names)[of.start + c]
                        if name not in mine or mine[name][-1] < row[c]:
                            mine[name] = (q, name, row[c]) if papers else (q, name, items[of.start + c], row[c])
                    if len(mine) > k:
                        best = sorted(mine.items(), key=lambda x: (-round(x[1][-1], 9), x[0]))[:k]
                        held[q], floor[q] = dict(best), round(best[-1][1][-1], 9)
        if k is not None:
            yield rows([x for mine in held.values() for x in mine.values()])

    kinds = "query_id long, item_key string, score double" if papers else "query_id long, chunk_id string, item_key string, score double"
    return index.select("chunk_id", "item_key", "tokens").mapInArrow(search, kinds)


def top(hits: DataFrame, k: int, tie: str, by: str = "query_id", score: Column | None = None) -> DataFrame:
    """The k best of each group with their rank; equal scores by tie, ascending."""
    order = (F.round("score", 9) if score is None else score).desc()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(tie)))).filter(F.col("rank") <= k)


def dense(rows: DataFrame, queries: DataFrame, k: int, own: str | None = None) -> DataFrame:
    """query_id, id, item_key, score, rank: the k rows (id, item_key, embedding) of largest dot product, exactly.

    Queries (query_id, embedding, and `own` if given) go out in blocks; each task keeps its k best of each query. Rows whose
    item_key is the query's `own` are left out, before the k are taken. Equal scores (to 9 decimals) go by id."""
    out = _by_blocks(rows, queries, own, lambda ids, q, mine: _nearest(rows, ids, q, mine, k))
    return top(out if out is not None else rows.sparkSession.createDataFrame([], NEAREST), k, "id")


def dense_papers(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item_key, score: each paper's largest dot product with each query, put together where the rows are."""
    out = _by_blocks(rows, queries, None, lambda ids, q, _: _papers(rows, ids, q))
    out = out if out is not None else rows.sparkSession.createDataFrame([], PAPERS)
    return out.groupBy("query_id", "item_key").agg(F.max("score").alias("score"))


NEAREST = "query_id long, id long, item_key string, score double"
PAPERS = "query_id long, item_key string, score double"


def _by_blocks(rows: DataFrame, queries: DataFrame, own: str | None, search: Callable[[np.ndarray, np.ndarray, np.ndarray | None], DataFrame]) -> DataFrame | None:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow().to_pydict()
        if block["query_id"]:
            part = search(np.array(block["query_id"]), np.array(block["embedding"], float), np.array(block[own], object) if own else None)
            out = part if out is None else out.unionByName(part)
    return out


def _nearest(rows: DataFrame, ids: np.ndarray, q: np.ndarray, own: np.ndarray | None, k: int) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, score = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -np.inf)
        who, paper = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), None, object)
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.sort_values("id", kind="stable")
            exact = q @ np.stack(frame["embedding"].to_numpy()).astype(float).T
            keys, names = frame["item_key"].to_numpy(), frame["id"].to_numpy()
            near = np.round(exact, 9)
            if own is not None:
                near[own[:, None] == keys[None, :]] = -np.inf
            n = min(k, len(frame))
            last = np.partition(near, len(frame) - n, axis=1)[:, len(frame) - n : len(frame) - n + 1]
            # all above the last one, then equals by id
            take = np.argsort(np.where(near > last, 0, np.where(near == last, 1, 2)), axis=1, kind="stable")[:, :n]
            both = [np.concatenate((a, b), axis=1) for a, b in ((far, np.take_along_axis(near, take, 1)), (score, np.take_along_axis(exact, take, 1)), (who, names[take]), (paper, keys[take]))]
            order = np.lexsort((both[2], -both[0]), axis=1)[:, :k]
            far, score, who, paper = (np.take_along_axis(x, order, 1) for x in both)
        ok = np.isfinite(far)
        yield pd.DataFrame({"query_id": np.repeat(ids, k).reshape(ok.shape)[ok], "id": who[ok], "item_key": paper[ok], "score": score[ok]})

    return rows.select("id", "item_key", "embedding").mapInPandas(search, NEAREST)


def _papers(rows: DataFrame, ids: np.ndarray, q: np.ndarray) -> DataFrame:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame = frame.sort_values("item_key", kind="stable")
                keys = frame["item_key"].to_numpy()
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                best = np.maximum.reduceat(q @ np.stack(frame["embedding"].to_numpy()).astype(float).T, first, axis=1)
                yield pd.DataFrame({"query_id": np.repeat(ids, len(first)), "item_key": np.tile(keys[first], len(ids)), "score": best.reshape(-1)})

    return rows.select("id", "item_key", "embedding").mapInPandas(search, PAPERS)


def best_per_paper(hits: DataFrame, tie: str) -> DataFrame:
    """The first hit of each paper of a query; rank stays its place among all hits."""
    w = Window.partitionBy("query_id", "item_key").orderBy("rank", tie)
    return hits.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def rrf(a: DataFrame, b: DataFrame, k: int = RRF) -> DataFrame:
    """query_id, item_key, score, source of two rank lists (query_id, item_key, rank): dense and sparse."""
    left = a.select("query_id", "item_key", F.col("rank").alias("ra"))
    right = b.select("query_id", "item_key", F.col("rank").alias("rb"))
    one = lambda r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    source = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "hybrid").when(F.col("rb").isNotNull(), "keyword").otherwise("semantic")
    return left.join(right, ["query_id", "item_key"], "full_outer").select("query_id", "item_key", (one("ra") + one("rb")).alias("score"), source.alias("source"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best papers of each query; equal scores by key, descending."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("item_key").desc())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merged_queries(hits: DataFrame) -> DataFrame:
    """query_id, item_key, score: over expanded queries (with a weight), the largest weighted score of each paper."""
    return hits.groupBy("query_id", "item_key").agg(F.max(F.col("score") * F.col("weight")).alias("score"))


def tiers(hits: DataFrame) -> DataFrame:
    """hits with `tier`: by the scores at places int(.75 n) and int(.25 n) of the ascending list for n of 4 or more, else by the largest and the smallest."""
    w = Window.partitionBy("query_id")
    n = F.count("*").over(w)
    placed = hits.withColumns({"n": n, "at": F.row_number().over(w.orderBy(F.round("score", 9), "item_key")) - 1})
    cut = lambda f: F.max(F.when(F.col("at") == F.floor(F.col("n") * f), F.round("score", 9))).over(w)
    high = F.when(F.col("n") >= 4, cut(0.75)).otherwise(F.max(F.round("score", 9)).over(w))
    low = F.when(F.col("n") >= 4, cut(0.25)).otherwise(F.min(F.round("score", 9)).over(w))
    seen = placed.withColumns({"high": high, "low": low})
    tier = F.when(F.round("score", 9) >= F.col("high"), "high").when(F.round("score", 9) >= F.col("low"), "medium").otherwise("low")
    return seen.withColumn("tier", tier).drop("n", "at", "high", "low")


def hybrid(queries: DataFrame, dense_ranks: DataFrame, sparse_ranks: DataFrame, papers: DataFrame, k: int, fallback: int | None = None) -> DataFrame:
    """query_id, item_key, score, rank, source, tier and the columns of papers (item_key, year and more): two rank lists
    (query_id, item_key, rank) fused and tiered, the k best of the papers given.

    Queries (query_id) without any get the newest `fallback` (k) papers, with score 0 and the lowest tier."""
    fused = tiers(rrf(dense_ranks, sparse_ranks).withColumn("score", F.round("score", 9)))
    found = ranked(fused.join(papers, "item_key"), k)
    newest = papers.orderBy(F.desc("year"), F.desc("item_key")).limit(k if fallback is None else fallback)
    # k rows
    newest = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("item_key"))))
    without = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").crossJoin(F.broadcast(newest))
    rest = without.withColumns({"score": F.lit(0.0), "source": F.lit("recency"), "tier": F.lit("low")})
    return found.unionByName(rest.select(*found.columns))


def consolidated(lists: DataFrame, k: int = RRF) -> DataFrame:
    """External records of several ranked lists, one row a merge_key: fused score, missing fields filled in list order, most citations, all sources."""
    order = F.struct("list_order", "rank")
    filled = lambda c: F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order)).alias(c)
    return lists.groupBy("merge_key").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min_by("title", order).alias("title"), *(filled(c) for c in ("abstract", "doi", "publisher")), F.max("citation_count").alias("citation_count"), F.array_sort(F.collect_set("source")).alias("sources"))


def mmr(hits: DataFrame, relevance_weight: float = 0.6, most: int = 3, penalty: float = 0.1) -> DataFrame:
    """Greedy diversity of each query's candidates (query_id, id, item_key, score, embedding): mmr_rank.

    A weight of 0 or less leaves the order by score. From the second hit of a paper on a penalty grows; at most `most` stay.
    Candidates are a query's top hits, so a group is small by construction; those without a vector are dropped."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True])
        if relevance_weight <= 0:
            return frame.assign(mmr_rank=np.arange(1, len(frame) + 1, dtype=np.int32))[["query_id", "id", "item_key", "mmr_rank"]]
        frame = frame[frame["embedding"].notna()]
        if not len(frame):
            return pd.DataFrame({"query_id": [], "id": [], "item_key": [], "mmr_rank": []})
        x = np.stack(frame["embedding"].to_numpy()).astype(float)
        s = frame["score"].to_numpy()
        rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
        keys, seen, out, near = frame["item_key"].to_numpy(), {}, [], np.zeros(len(s))
        left = np.ones(len(s), bool)
        while left.any():
            n = np.array([seen.get(k, 0) for k in keys])
            left &= n < most
            if not left.any():
                break
            value = relevance_weight * rel - (1 - relevance_weight) * near - np.where(n >= 2, (n - 1) * penalty, 0)
            i = int(np.flatnonzero(left)[np.round(value[left], 12).argmax()])
            out.append(i)
            left[i] = False
            seen[keys[i]] = seen.get(keys[i], 0) + 1
            near = np.maximum(near, np.maximum(x @ x[i], 0))
        return frame.iloc[out].assign(mmr_rank=np.arange(1, len(out) + 1, dtype=np.int32))[["query_id", "id", "item_key", "mmr_rank"]]

    return hits.groupBy("query_id").applyInPandas(one, "query_id long, id long, item_key string, mmr_rank int")
