"""Operator 9: held-out accuracy, pairs that additive weights miss, and edges."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tests.llm import fixtures

from quarry.llm import common
from quarry.llm import toxicity as X

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        w = fixtures.words(rng, rng.randint(5, 80)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(("Slurxx", "vilexo", "vilext")))
        rows.append(fixtures.row(i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    d = fixtures.save(spark, tmp_path / "in", rows + fixtures.edge_rows(), labels=(labels, LABELS))
    got = X.op9_toxicity(spark, d).collect()
    known = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(got) == len(rows) + len(fixtures.edge_rows())


def train(terms, labels):
    """By all terms of three rows or more."""
    names, n = np.unique(np.concatenate(terms), return_counts=True)
    chosen = names[n >= 3]
    return X.train([np.flatnonzero(np.isin(chosen, x)) for x in terms], np.array(labels, float), chosen)


def test_score_is_the_pairwise_formula():
    """Bias, weights, and the product of each pair's factors, summed pair by pair."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    index = {b: i for i, b in enumerate(sorted({b for w in words for b in X.buckets(w)}))}
    m = X.Machine(index, -0.3, rng.normal(size=len(index)), rng.normal(0, 0.4, (len(index), X.FACTORS)))
    for _ in range(40):
        text = " ".join(rng.choice(words, rng.integers(0, 12)))
        at = sorted({index[b] for w in text.split() for b in X.buckets(w)})
        y = m.bias + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for n, i in enumerate(at) for j in at[:n])
        assert abs(m.score(text) - 1 / (1 + np.exp(-np.clip(y, -30, 30)))) < 1e-9


def test_likelihood_ratio(spark):
    rows = [(40.0, 30.0), (40.0, 0.0), (3.0, 3.0), (90.0, 35.0), (20.0, 20.0)]
    got = spark.createDataFrame(rows, "n double, a double").select(X.likelihood_ratio(F.col("n"), F.col("a"), 100, 40).alias("x"))
    for (n, a), r in zip(rows, got.collect(), strict=True):
        cells = [(a, n * 0.4), (n - a, n * 0.6), (40 - a, (100 - n) * 0.4), (60 - n + a, (100 - n) * 0.6)]
        assert abs(r.x - 2 * sum(s * np.log(s / e) for s, e in cells if s > 0)) < 1e-9


def test_sample_at_any_count(spark):
    """However many rows there are, the sample isn't empty and is near its size."""
    ids = spark.range(200_000)
    for count in (200_000, 10_000):
        n = ids.filter(common.sampled(F.col("id"), count, 10_000)).count()
        assert abs(n - 200_000 * min(1, 10_000 / count)) < 500
    seen = [ids.filter(common.sampled(F.col("id"), count, count // 4000)).count() for count in (10**9, 10**11, 10**13)]
    assert all(20 < n < 100 for n in seen)
    bound = str(common.sampled(F.col("id"), 10**13, 10_000))
    assert "-9223372018" in bound and "-9223372036854775808" not in bound


def test_repeated_documents_count_once(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    known = spark.createDataFrame(labels, LABELS)
    one, many = X.fit(docs, known), X.fit(docs.union(docs).repartition(7), known)
    assert one.index == many.index and (one.weights == many.weights).all()


def test_pairs():
    """Neither word alone tells the label; both together do."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = fixtures.words(rng, 5).split() + ["insultz"] * a + ["groupqq"] * b
        rows.append(np.unique(np.array([x for y in set(w) for x in X.buckets(y)], np.int32)))
        labels.append(float(a and b))
    m = train(rows, labels)
    assert m.score("some insultz here") < 0.5 and m.score("some groupqq here") < 0.5 and m.score("insultz groupqq") > 0.5


def test_same_rows_same_machine():
    rows, labels = corpus(300)
    known = {i: t for i, _, t in labels}
    terms = [np.unique(np.array([b for w in set(X.WORDS.findall(r[1].lower())) for b in X.buckets(w)], np.int32)) for r in rows]
    y = np.array([float(known.get(r[0], 0)) for r in rows])
    a, b = train(terms, y), train(terms, y)
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_no_labels(spark, tmp_path):
    d = fixtures.save(spark, tmp_path / "a", fixtures.edge_rows(), labels=([(1, None, None), (None, 1, 1)], LABELS))
    assert {r.score for r in X.op9_toxicity(spark, d).collect()} == {0.0}
    e = fixtures.save(spark, tmp_path / "b", [], labels=([], LABELS))
    assert X.op9_toxicity(spark, e).collect() == []


def test_partitions_without_labels(spark):
    """Parts that hold no labelled rows, or only texts without terms, don't shift labels against texts."""
    rows, labels = corpus(400)
    labels += [(10_000, 1, 1), (10_001, 1, 0)]
    rows += [fixtures.row(10_000, None), fixtures.row(10_001, "")]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(40)
    m = X.fit(docs, spark.createDataFrame(labels, LABELS))
    assert m.score("x vilexo y") > 0.5 and m.score("abc def") < 0.5


def test_keep_clean(spark):
    rows, labels = corpus()
    known = {i: t for i, _, t in labels}
    got = X.keep_clean(fixtures.frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert got.columns == fixtures.COLUMNS
    kept = {r.doc_id for r in got.collect()}
    assert not any(known.get(i) and i in kept for i in known) or np.mean([i in kept for i, t in known.items() if t]) < 0.03
    assert np.mean([i in kept for i, t in known.items() if not t]) > 0.99
