"""Toxicity scores (operator 9) by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their prefixes of 3 to 6 letters, hashed into BUCKETS. From a bounded
sample of labelled training rows (SAMPLE rows at most in expectation, picked by a hash of the id), the FEATURES buckets
that tell the labels apart most (likelihood ratio, in at least LEAST documents) become inputs, each 1 if present. The
machine learns a weight for each and a vector of FACTORS, whose inner products weigh pairs, so that an insult beside a
group's name can count for more than the two alone. Labels, language, source and id are never inputs.

Defined results: a null or empty text has no terms and gets the score of the bias alone; without labelled training rows
each score is 0; rows with a null label aren't trained on, and of rows that repeat a doc_id in labels the largest label
counts, of those that repeat one in documents the least text is learnt from; a null doc_id counts as the empty text when
rows are held out; texts of any length are read whole; an empty
table gives an empty result; other columns of documents are kept or ignored whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6)
SAMPLE = 16_000
FEATURES = 2048
LEAST = 3
#: Likelihood ratio under which a bucket may be there by chance.
CHANCE = 8.0
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.03, 1e-4

WORDS = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def buckets(word: str) -> list[int]:
    raw = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw]


@dataclass
class Machine:
    """A trained machine; index gives a bucket's row in weights and factors."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    MOST_WORDS = 200_000

    @cached_property
    def squares(self) -> np.ndarray:
        return (self.factors**2).sum(axis=1)

    def inputs(self, text: str) -> list[int]:
        memo, found = self.memo, set()
        if len(memo) > self.MOST_WORDS:
            memo.clear()
        for w in set(WORDS.findall(text.lower())):
            hit = memo.get(w)
            if hit is None:
                hit = memo[w] = tuple(self.index[b] for b in buckets(w) if b in self.index)
            if hit:
                found.update(hit)
        return sorted(found)

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        at = self.inputs(text or "")
        y = self.bias
        if at:
            y += float(self.weights[at].sum()) + 0.5 * float((self.factors[at].sum(axis=0) ** 2).sum() - self.squares[at].sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))

    def __getstate__(self) -> dict:
        return {"index": self.index, "bias": self.bias, "weights": self.weights, "factors": self.factors, "memo": {}}


def likelihood_ratio(n: Column, a: Column, total: int, positive: int) -> Column:
    """Twice the log likelihood ratio of a term in n of all documents, in a of the positive ones."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(F.try_divide(seen, expected))).otherwise(0.0)

    share, rest = positive / total, 1 - positive / total
    return 2 * (part(a, n * share) + part(n - a, n * rest) + part(positive - a, (total - n) * share) + part(total - n - positive + a, (total - n) * rest))


def choose(terms: DataFrame, total: int, positive: int) -> np.ndarray:
    """The FEATURES buckets of terms (label, terms) with the largest likelihood ratios, in ascending order."""
    counts = terms.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("a"))
    scored = counts.filter(F.col("n") >= LEAST).select("term", likelihood_ratio(F.col("n"), F.col("a"), total, positive).alias("ratio"))
    best = scored.filter(F.col("ratio") >= CHANCE).orderBy(F.round("ratio", 9).desc(), "term").limit(FEATURES)
    return np.sort(np.array([r.term for r in best.select("term").collect()], np.int32))


def train(inputs: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, seed: int = 9) -> Machine:
    """Adam on the logistic loss, of rows' places in chosen; the same rows in the same order give the same machine."""
    if not len(labels) or labels.min() == labels.max():
        return Machine({}, -np.inf if not len(labels) or labels.max() == 0 else 30.0, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    n = len(chosen)
    rate = labels.mean()
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows_now = order[i : i + BATCH]
            sizes = [len(inputs[r]) for r in rows_now]
            flat = np.concatenate([inputs[r] for r in rows_now]).astype(np.int64)
            owner = np.repeat(np.arange(len(rows_now)), sizes)
            v = params[2][flat]
            sums = np.zeros((len(rows_now), FACTORS))
            np.add.at(sums, owner, v)
            linear = np.bincount(owner, params[1][flat], minlength=len(rows_now))
            squares = np.bincount(owner, (v**2).sum(axis=1), minlength=len(rows_now))
            y = params[0] + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[rows_now]) / len(rows_now)
            grad_v = np.zeros_like(params[2])
            np.add.at(grad_v, flat, error[owner][:, None] * (sums[owner] - v))
            grads = [np.array([error.sum()]), np.bincount(flat, error[owner], minlength=n) + DECAY * params[1], grad_v + DECAY * params[2]]
            step += 1
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine({int(b): k for k, b in enumerate(chosen)}, float(params[0][0]), params[1], params[2])


def terms_of(text: str) -> np.ndarray:
    return np.unique(np.fromiter({b for w in set(WORDS.findall(text.lower())) for b in buckets(w)}, np.int32))


def _terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.enter("toxicity")
    for frame in common.chunks(frames):
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "label": frame["label"].to_numpy(), "terms": [terms_of(x) for x in common.texts(frame)]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from labels (doc_id, toxic) of rows that aren't held out; sample bounds the rows in expectation.

    Terms are counted where they are; the driver gets the chosen ones' names, and at most FEATURES places a row."""
    common.ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("label")).filter(~held_out(F.col("doc_id")))
    picked = known.filter(common.sampled(F.col("doc_id"), known.count(), sample))
    # at most `sample` rows in expectation; a repeated doc_id counts once
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    keep: list[str] = []
    terms = common.settle(texts.mapInPandas(_terms, "doc_id long, label int, terms array<int>"), keep)
    total, positive = terms.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = choose(terms, total, positive) if 0 < positive < total else np.empty(0, np.int32)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.flatnonzero(np.isin(chosen, x)).astype(np.int32) for x in frame["terms"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "label": frame["label"].to_numpy(), "inputs": found})

    got = terms.mapInPandas(places, "doc_id long, label int, inputs array<int>").toArrow()
    common.drop(docs.sparkSession, keep)
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    # views of Arrow's own buffers, without copies
    inputs = [x for chunk in got["inputs"].chunks if len(chunk) for x in np.split(chunk.flatten().to_numpy(), (chunk.offsets.to_numpy() - chunk.offsets[0].as_py())[1:-1])]
    return train([inputs[i] for i in order], got["label"].to_numpy()[order].astype(float), chosen)


def score(machine: Machine, text: Column) -> Column:
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.enter("toxicity")
        for part in parts:
            yield pd.Series([machine.score(x) for x in part.tolist()], dtype=float)

    return F.pandas_udf(scores, "double")(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    machine = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(machine, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs."""
    machine = fit(docs, labels)
    return docs.filter(score(machine, F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
