"""Fusion, tiers, diversity and metrics."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import expand, library, measure, models, search
from quarry.sources import sinks

RANKS = "query_id long, item_key string, rank int"


def test_rrf_and_ties(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], RANKS)
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], RANKS)
    got = search.ranked(search.rrf(dense, sparse), 10).orderBy("rank").collect()
    assert [(r.item_key, r.source) for r in got] == [("b", "hybrid"), ("a", "semantic"), ("c", "keyword")]
    back = {r.item_key: r.score for r in search.rrf(sparse, dense).collect()}
    assert back == {r.item_key: r.score for r in got}


def test_negative_idf_is_floored(spark):
    chunks = spark.createDataFrame([("1", "a", "common rare"), ("2", "a", "common"), ("3", "a", "other words here")], "chunk_id string, item_key string, text string")
    got = {r.token: r.idf for r in search.idf(search.tokenised(chunks)).collect()}
    raw = {t: np.log(3 - n + 0.5) - np.log(n + 0.5) for t, n in (("common", 2), ("rare", 1), ("other", 1), ("words", 1), ("here", 1))}
    assert abs(got["common"] - 0.25 * np.mean(list(raw.values()))) < 1e-12


def plain_bm25(queries, chunks):
    """Scores by the formula, term by term."""
    split = {c: re.findall("[a-z]{2,}", (x or "").lower()) for c, _, x in chunks}
    n, mean = len(split), np.mean([len(x) for x in split.values()])
    df = collections.Counter(t for x in split.values() for t in set(x))
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    idf = {t: r if r >= 0 else 0.25 * np.mean(list(raw.values())) for t, r in raw.items()}
    out = {}
    for q, text in queries:
        for c, x in split.items():
            out[q, c] = sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in re.findall("[a-z]{2,}", text.lower()) if t in x)
    return {k: v for k, v in out.items() if v > 0}


def test_bm25(spark, tmp_path, monkeypatch):
    """Against the formula: all hits, the best chunks, the best papers; in blocks and parts of queries; from a stored index."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=2)) for _ in range(40)]
    chunks = [(f"{i // 4}:{i % 4}", str(i // 4), None if i == 7 else " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    chunks += [("90:0", "90", chunks[0][2]), ("91:0", "91", chunks[0][2])]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(9)] + [(50, "zzzz"), (51, "")]
    want = plain_bm25(queries, chunks)
    table = spark.createDataFrame(chunks, "chunk_id string, item_key string, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    sinks.write_index(search.tokenised(table), str(tmp_path))
    index, known = sinks.read_index(spark, str(tmp_path))
    for cells, part, block in ((search.CELLS, 128, 1024), (300, 2, 4)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search.Weights, "PART", part)
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(asked, index, known=known).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        for k in (1, 5, 200):
            best = {(q, c) for q, _ in queries for c in sorted((c for p, c in want if p == q), key=lambda c: (-round(want[q, c], 9), c))[:k]}
            assert {(r.query_id, r.chunk_id) for r in search.bm25(asked, search.tokenised(table), k).collect()} == best
        papers = {}
        for (q, c), x in want.items():
            papers[q, c.split(":")[0]] = max(x, papers.get((q, c.split(":")[0]), 0))
        best = {(q, i) for q, _ in queries for i in sorted((i for p, i in papers if p == q), key=lambda i: (-round(papers[q, i], 9), i))[:3]}
        assert {(r.query_id, r.item_key) for r in search.bm25(asked, index, 3, "item_key", known).collect()} == best


def test_similar_papers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, str(i % 9), v.tolist()) for i, v in enumerate(x)], "id long, item_key string, embedding array<double>").repartition(3)
    c = np.array([x[i::9].mean(axis=0) for i in range(9)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    pairs = sorted(((-round(float(c[a] @ c[b]), 6), str(a), str(b)) for a in range(9) for b in range(a + 1, 9)))[:4]
    got = [(r.key_a, r.key_b, round(r.sim, 6)) for r in measure.similar_papers(rows, 4).collect()]
    assert got == [(a, b, -s) for s, a, b in pairs]


def test_tiers(spark):
    rows = [(1, f"k{i}", float(i)) for i in range(8)] + [(2, f"k{i}", float(i)) for i in range(3)]
    got = {(r.query_id, r.item_key): r.tier for r in search.tiers(spark.createDataFrame(rows, "query_id long, item_key string, score double")).collect()}
    assert [got[1, f"k{i}"] for i in range(8)] == ["low"] * 2 + ["medium"] * 4 + ["high"] * 2
    assert [got[2, f"k{i}"] for i in range(3)] == ["medium", "medium", "high"]


def test_mmr(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, "one" if i < 5 else "two", 1 - i / 10, (v := rng.normal(size=4), (v / np.linalg.norm(v)).tolist())[1]) for i in range(6)] + [(1, 9, "three", 0.1, None)]
    hits = spark.createDataFrame(rows, "query_id long, id long, item_key string, score double, embedding array<double>")
    got = search.mmr(hits).orderBy("mmr_rank").collect()
    assert sum(r.item_key == "one" for r in got) == 3 and sum(r.item_key == "two" for r in got) == 1 and got[0].id == 0
    assert [r.id for r in search.mmr(hits, relevance_weight=0).orderBy("mmr_rank").collect()] == [0, 1, 2, 3, 4, 5, 9]


def plain_mmr(rows, weight=0.6, most=3, penalty=0.1):
    """The same choice, one row at a time."""
    rows = sorted(rows, key=lambda r: (-r[3], r[1]))
    s = [r[3] for r in rows]
    rel = {r[1]: (r[3] - min(s)) / (max(s) - min(s)) if max(s) > min(s) else 1.0 for r in rows}
    out = []
    while True:
        best = None
        for r in rows:
            n = sum(o[2] == r[2] for o in out)
            if r in out or n >= most:
                continue
            near = max([0.0, *(float(np.dot(r[4], o[4])) for o in out)])
            value = weight * rel[r[1]] - (1 - weight) * near - ((n - 1) * penalty if n >= 2 else 0)
            if best is None or round(value, 12) > best[0]:
                best = (round(value, 12), r)
        if best is None:
            return [r[1] for r in out]
        out.append(best[1])


def test_mmr_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(4):
        x = rng.normal(size=(25, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(q, i, f"p{rng.integers(0, 7)}", float(rng.integers(0, 8)) / 8, v.tolist()) for i, v in enumerate(x)]
    hits = spark.createDataFrame(rows, "query_id long, id long, item_key string, score double, embedding array<double>")
    got = {}
    for r in search.mmr(hits).orderBy("query_id", "mmr_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: plain_mmr([r for r in rows if r[0] == q]) for q in range(4)}


def test_hybrid(spark):
    """Two lists fused and tiered; a query without papers gets the newest."""
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], RANKS)
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "z", 1)], RANKS)
    papers = spark.createDataFrame([("a", 2001), ("b", 2002), ("c", 2003)], "item_key string, year int")
    got = search.hybrid(spark.createDataFrame([(1,), (2,)], "query_id long"), dense, sparse, papers, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_key, r.source, r.tier) for r in got] == [(1, "b", "hybrid", "high"), (1, "a", "semantic", "medium"), (2, "c", "recency", "low"), (2, "b", "recency", "low")]


def test_dense_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, str(i % 5), v.tolist()) for i, v in enumerate(x)], "id long, item_key string, embedding array<double>").repartition(3)
    q = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("item_key").alias("own"))
    for own in (None, "own"):
        got = {}
        for r in search.dense(rows, q, 7, own=own).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i in got:
            ids = [j for j in np.lexsort((np.arange(300), -np.round(x @ x[i], 9))) if own is None or j % 5 != i % 5][:7]
            assert got[i] == ids
        assert len(got) == 6
    assert search.dense(rows, q.filter("false"), 3).collect() == []


def test_metrics(spark):
    qrels = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, item_key string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 3), (1, "a", 4), (2, "x", 1)], RANKS)
    got = {r.query_id: r for r in measure.per_query(qrels, ranked).collect()}
    assert got[1].recall5 == 1.0 and abs(got[1].rr - 1 / 3) < 1e-9 and got[1].ndcg10 == 0.5
    assert (got[2].recall5, got[2].rr, got[2].ndcg10) == (1.0, 0.0, 1.0)


def test_upper_median(spark):
    assert measure.upper_median(spark.createDataFrame([(4,), (1,), (3,), (2,), (None,)], "n long"), "n").first().median == 3


def test_publisher_quota(spark):
    rows = [(1, i, "p" if i > 7 else "q", float(-i)) for i in range(10)]
    got = library.publisher_quota(spark.createDataFrame(rows, "query_id long, id long, publisher string, score double"), "p", 5).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 8]


def test_expansion(spark):
    queries = spark.createDataFrame([(1, "Deep City Maps"), (2, "none")], "query_id long, text string")
    terms = spark.createDataFrame([("city", "urban"), ("city map", "atlas"), ("longer than any query at all", "x")], "term string, expansion string")
    assert {(r.query_id, r.expansion) for r in expand.contained(queries, terms).collect()} == {(1, "urban"), (1, "atlas")}
    seeds = spark.createDataFrame([(1, "The growth of cities", ["a b", "c", "d"])], "query_id long, title string, keywords array<string>")
    assert [r.text for r in expand.seed_queries(seeds).orderBy("ordinal").collect()] == ["a b c", "a b d", "c d", "a b", "growth cities"]


def test_duplicates(spark):
    rows = [("1", "10.1/A", "Some title here"), ("2", "10.1/a", "Other"), ("3", None, "some-title HERE"), ("4", None, "short"), ("5", None, "short")]
    from quarry.functions import text as T

    got = library.duplicate_groups(spark.createDataFrame(rows, "item_key string, doi string, title string"), T.normalised_title(F.col("title")))
    assert {(tuple(r["keys"]), r.reason) for r in got.collect()} == {(("1", "2"), "doi_match"), (("1", "3"), "doi_match")}


def test_models(spark):
    docs = spark.createDataFrame([(1, "red apple", 1, "red apple pie"), (1, "red apple", 2, "blue sky"), (1, "red apple", 3, None)], "query_id long, query string, id long, text string")
    got = models.reranked(docs, 2).orderBy("ce_rank").collect()
    assert [r.id for r in got] == [1, 2]
    v = docs.select(models.embedded(F.col("text")).alias("v")).collect()
    assert [round(sum(x * x for x in r.v), 3) for r in v] == [1.0, 1.0, 0.0]
    assert docs.select(models.translated(F.col("text")).alias("t")).first().t is None
    assert docs.select(models.translated(F.col("text"), str.upper).alias("t")).first().t == "RED APPLE PIE"
