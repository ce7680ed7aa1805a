"""Approximate nearest neighbours (operator 10) by additive quantisation.

A vector is the sum of one codeword from each of BOOKS full-dimensional codebooks. The books start as residual k-means on
a bounded sample (SAMPLE rows at most in expectation) and are refined in turns: encode by beam search, then solve for all
codewords together by least squares. Every row is encoded by beam search over what remains after each book, and stored
with its codes, the squared norm of its reconstruction, the distance that the reconstruction misses it by and the original
vector.

A query makes a table of its products with all codewords; a row's approximate distance is its norm less twice the sum of
its codes' entries. A search has two rounds over the codes. The first ranks each partition's rows by approximate distance
and measures the RERANK best of each query exactly, in double precision; the k-th best over all partitions bounds what is
among the nearest. The second measures the rows that can be within that bound: their approximate distance less what their
reconstruction misses is no more. So the answer is that of brute force, however close rows lie to each other.

Queries go to the tasks in blocks of QUERY_BYTES with their tables; rows are taken in chunks of CHUNK_BYTES; neither
depends on the number of dimensions, and what is measured at once isn't either.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no
part; nor do vectors of another length than most of the sample. Ties go to the smaller id, within a chunk too, so a
vector with thousands of copies is found by its smallest ids. Each row is a candidate, so a repeated id may be found
repeatedly; of rows that repeat a query's id, the smallest vector is the query. With fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

BOOKS, WORDS, BEAM = 24, 64, 4
SAMPLE = 10_000
ROUNDS = 2
#: Rows of a partition that are measured for each query in the first round, beside those that come before them.
RERANK = 32
#: Bytes of vectors in a chunk of rows, and the most rows it has.
CHUNK_BYTES, CHUNK_ROWS = 32 << 20, 8192
#: Bytes of queries and their tables in a block.
QUERY_BYTES = 64 << 20
#: Bytes of what is computed at once: remainders of a beam, distances of queries and rows, pairs that are measured.
STEP_BYTES = 32 << 20


def usable(v: Column) -> Column:
    """Not null, not zero, and all components finite."""
    big = float(np.finfo(np.float64).max)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Quantiser:
    books: np.ndarray  # (BOOKS, WORDS, d), float64

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, BOOKS): the beam's best after the last book, by squared distance of what remains."""
        n, d = x.shape
        m, w, _ = self.books.shape
        rest = x[:, None, :]
        codes = np.zeros((n, 1, m), np.uint8)
        for b in range(m):
            book = self.books[b]
            width = rest.shape[1]
            # |r - c|^2 for each held remainder and codeword
            far = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(axis=1)
            far = far.reshape(n, width * w)
            keep = min(beam if b < m - 1 else 1, far.shape[1])
            best = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < far.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, word = best // w, best % w
            codes = np.take_along_axis(codes, parent[:, :, None], axis=1)
            codes[:, :, b] = word
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
        return codes[:, 0, :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def _sums(at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of x for each value of at."""
    one = np.zeros((len(at), k))
    one[np.arange(len(at)), at] = 1
    return one.T @ x


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = _sums(near, x, k)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def train(x: np.ndarray, seed: int = 10, rounds: int = ROUNDS) -> Quantiser:
    rng = np.random.default_rng(seed)
    rest, books = x.copy(), []
    for _ in range(BOOKS):
        c = _kmeans(rest, WORDS, rng)
        rest = rest - c[((c**2).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)]
        books.append(c)
    q = Quantiser(np.array(books))
    for _ in range(rounds):
        # rows choose one codeword of each book; the codewords that fit best solve one ridge system
        codes = q.encode(x).astype(np.int64)
        n = BOOKS * WORDS
        pairs, right = np.zeros((n, n)), np.zeros((n, x.shape[1]))
        for i in range(BOOKS):
            rows = slice(i * WORDS, (i + 1) * WORDS)
            right[rows] = _sums(codes[:, i], x, WORDS)
            for j in range(BOOKS):
                pairs[rows, j * WORDS : (j + 1) * WORDS] = np.bincount(codes[:, i] * WORDS + codes[:, j], minlength=WORDS * WORDS).reshape(WORDS, WORDS)
        ridge = 1e-3 * max(1.0, len(x) / n)
        old = q.books.reshape(n, -1)
        q = Quantiser(np.linalg.solve(pairs + ridge * np.eye(n), right + ridge * old).reshape(q.books.shape))
    return q


class Best:
    """The k nearest rows so far of each query."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.far = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, far: np.ndarray, who: np.ndarray, of: slice = slice(None)) -> None:
        """Rows of the queries `of`."""
        far, who = np.concatenate((self.far[of], far), axis=1), np.concatenate((self.who[of], who), axis=1)
        order = np.lexsort((who, far), axis=1)[:, : self.k]
        self.far[of], self.who[of] = np.take_along_axis(far, order, 1), np.take_along_axis(who, order, 1)

    def frame(self) -> pd.DataFrame:
        ok = np.isfinite(self.far)
        return pd.DataFrame({"query_id": np.repeat(self.ids, self.k).reshape(ok.shape)[ok], "vec_id": self.who[ok], "score": self.far[ok]})


@dataclass
class Chunk:
    """Rows in ascending order of their ids, so that of equal distances the smallest ids are taken."""

    rows: np.ndarray
    codes: np.ndarray
    norms: np.ndarray
    misses: np.ndarray
    vectors: np.ndarray


def chunks(frames: Iterator[pd.DataFrame], d: int) -> Iterator[Chunk]:
    """Arrow batches put together."""
    most, held, n = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * d))), [], 0

    def out() -> Chunk:
        frame = pd.concat(held).sort_values("vec_id", kind="stable")
        codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), -1)
        return Chunk(frame["vec_id"].to_numpy(), codes, frame["norm"].to_numpy(), frame["miss"].to_numpy(), np.stack(frame["embedding"].to_numpy()))

    for frame in frames:
        for i in range(0, len(frame), most):
            part = frame.iloc[i : i + most]
            if held and n + len(part) > most:
                yield out()
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield out()


class Searcher:
    """Searches chunks of rows for a block of queries."""

    def __init__(self, q: Quantiser, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.d = ids, queries, queries.shape[1]
        self.tables = np.einsum("qd,bwd->qbw", queries, q.books).astype(np.float32)
        self.own = (queries**2).sum(axis=1)
        self.best = Best(ids, k)

    def approximate(self, chunk: Chunk) -> Iterator[tuple[slice, np.ndarray]]:
        """Queries and their squared distances to all rows of the chunk, less the queries' own squares."""
        step = max(1, STEP_BYTES // (4 * len(chunk.rows)))
        for i in range(0, len(self.ids), step):
            of = slice(i, min(i + step, len(self.ids)))
            near = np.broadcast_to(chunk.norms.astype(np.float32), (of.stop - i, len(chunk.rows))).copy()
            for b in range(chunk.codes.shape[1]):
                near -= 2 * self.tables[of, b, :][:, chunk.codes[:, b]]
            near[self.ids[of, None] == chunk.rows[None, :]] = np.inf
            yield of, near

    def measure(self, of: slice, chunk: Chunk, wanted: np.ndarray) -> None:
        """Adds the rows that are marked (queries of the slice by rows of the chunk), measured exactly."""
        left = wanted.sum(axis=1)
        pairs, start = max(1, STEP_BYTES // (16 * self.d)), 0
        while start < len(left):
            # as many queries as have so many pairs, one at least
            stop = start + max(1, int(np.searchsorted(np.cumsum(left[start:]), pairs, side="right")))
            at, row = np.nonzero(wanted[start:stop])
            if len(at):
                first = of.start + start
                part = np.concatenate([np.sqrt(((chunk.vectors[row[i : i + pairs]] - self.queries[first + at[i : i + pairs]]) ** 2).sum(axis=1)) for i in range(0, len(at), pairs)])
                place = np.arange(len(at)) - np.concatenate(([0], np.cumsum(left[start:stop])))[at]
                far = np.full((stop - start, int(left[start:stop].max())), np.inf)
                who = np.full(far.shape, np.iinfo(np.int64).max)
                far[at, place], who[at, place] = part, chunk.rows[row]
                self.best.add(far, who, slice(first, of.start + stop))
            start = stop

    def rank(self, parts: Iterator[Chunk], rerank: int) -> Best:
        """The first round: the rows that are among the `rerank` best of all chunks so far, by approximate distance."""
        held = np.full((len(self.ids), rerank), np.inf, np.float32)
        for chunk in parts:
            for of, near in self.approximate(chunk):
                both = np.concatenate((held[of], near), axis=1)
                held[of] = np.partition(both, rerank - 1, axis=1)[:, :rerank]
                edge = held[of].max(axis=1, keepdims=True)
                below, level = near < edge, (near == edge) & np.isfinite(near)
                # of those at the edge, as many as there is room for
                room = rerank - below.sum(axis=1, keepdims=True)
                self.measure(of, chunk, below | (level & (np.cumsum(level, axis=1) <= room)))
        return self.best

    def within(self, parts: Iterator[Chunk], bound: np.ndarray) -> Best:
        """The second round: all rows that can be within a query's bound."""
        for chunk in parts:
            # the sums are of single precision: none is further off than `loose`
            size = chunk.norms.max() + 2 * np.abs(self.tables).max(axis=2).sum(axis=1, dtype=np.float64)
            loose = (chunk.codes.shape[1] + 4) * float(np.finfo(np.float32).eps) * (size + 1) + 1e-9 * self.own
            squares = (chunk.vectors**2).sum(axis=1)
            for of, near in self.approximate(chunk):
                limit, own = bound[of, None], self.own[of, None]
                open_ = (near <= (limit + chunk.misses) ** 2 * (1 + 1e-9) + loose[of, None] - own) & np.isfinite(near)
                # products in double precision rule out most of them before they are measured
                some = np.flatnonzero(open_.any(axis=0))
                for i in range(0, len(some), 1024):
                    rows = some[i : i + 1024]
                    total = own + squares[rows]
                    open_[:, rows] &= total - 2 * self.queries[of] @ chunk.vectors[rows].T <= limit**2 * (1 + 1e-9) + 1e-11 * total
                self.measure(of, chunk, open_)
        return self.best


def index(vectors: DataFrame, keep: list[str]) -> tuple[DataFrame, Quantiser | None]:
    """The settled index (vec_id, codes, norm, miss, embedding) of all usable rows, and its quantiser."""
    common.ship(vectors.sparkSession)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = good.filter(common.sampled(F.struct("vec_id", "embedding"), good.count(), SAMPLE)).orderBy("vec_id", "embedding").toArrow()["embedding"].combine_chunks()
    schema = "vec_id long, codes binary, norm double, miss double, embedding array<double>"
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], schema), None
    held = [np.asarray(x) for x in sample.to_numpy(zero_copy_only=False)]
    lengths = np.array([len(x) for x in held])
    d = int(np.bincount(lengths).argmax())
    q = train(np.array([x for x in held if len(x) == d]))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.enter("ann")
        step = max(1, STEP_BYTES // (8 * BEAM * (d + WORDS)))
        for frame in frames:
            for i in range(0, len(frame), step):
                part = frame.iloc[i : i + step]
                x = np.stack(part["embedding"].to_numpy())
                codes = q.encode(x)
                near = q.decode(codes)
                miss = np.sqrt(((x - near) ** 2).sum(axis=1))
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "codes": [c.tobytes() for c in codes], "norm": (near**2).sum(axis=1), "miss": miss, "embedding": part["embedding"].to_numpy()})

    return common.settle(good.filter(F.size("embedding") == d).mapInPandas(encode, schema), keep), q


def _round(q: Quantiser, rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int, bound: np.ndarray | None = None) -> DataFrame:
    """Each partition's k best rows of each query: of those it ranks first, or of those within the bound."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.enter("ann")
        s, parts = Searcher(q, ids, queries, k), chunks(frames, queries.shape[1])
        yield (s.rank(parts, rerank) if bound is None else s.within(parts, bound)).frame()

    return rows.mapInPandas(search, "query_id long, vec_id long, score double")


def search(rows: DataFrame, q: Quantiser | None, queries: DataFrame, k: int, keep: list[str], rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: queries (query_id, embedding) against all rows of an index.

    The driver holds one block of queries at a time, and a bound for each of its queries."""
    spark = queries.sparkSession
    schema = "query_id long, vec_id long, score double"
    found = common.scratch_path(spark)
    keep.append(found)
    spark.createDataFrame([], schema).write.parquet(found)
    if q is not None:
        d = q.books.shape[2]
        asked = common.settle(queries.filter(F.size("embedding") == d), keep)
        blocks = -(-asked.count() * (8 * d + 4 * BOOKS * WORDS) // QUERY_BYTES)
        dealt = common.scratch_path(spark)
        keep.append(dealt)
        if blocks:
            asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(dealt)
        for b in range(blocks):
            block = spark.read.schema("query_id long, embedding array<double>, block int").parquet(dealt).filter(F.col("block") == b).orderBy("query_id").toArrow()
            if not len(block):
                continue
            ids, x = block["query_id"].to_numpy(), np.stack([np.asarray(v) for v in block["embedding"].combine_chunks().to_numpy(zero_copy_only=False)])
            place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
            last = _round(q, rows, ids, x, k, rerank).withColumn("place", place).filter(F.col("place") == k).select("query_id", "score").toArrow()
            # queries with fewer than k candidates have no bound
            bound = np.full(len(ids), np.inf)
            bound[np.searchsorted(ids, last["query_id"].to_numpy())] = last["score"].to_numpy()
            _round(q, rows, ids, x, k, rerank, bound).write.mode("append").parquet(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = spark.read.schema(schema).parquet(found)
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep: list[str] = []
    rows, q = index(common.table(spark, sf_dir, "embeddings"), keep)
    queries = rows.filter("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    return search(rows, q, queries, 10, keep)
