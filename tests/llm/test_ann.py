"""Operator 10 against brute force."""

import math

import numpy as np
import pandas as pd
from quarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, rank int"


def save(spark, folder, rows):
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def exact(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v) and len(v) == 16]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            far = np.sqrt(((x - v) ** 2).sum(axis=1))
            far[ids == q] = np.inf
            out[q] = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far))[:k] if np.isfinite(far[j])]
    return out


def rows(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).round(3)
    x[500:1500] = x[100]  # a third are copies of a query
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_ties_and_scores(spark, tmp_path):
    data = rows() + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [float("inf")] * 16), (9400, [None] + [1.0] * 15), (9500, [1.0] * 3), (None, [1.0] * 16)]
    got = {}
    for r in ann.op10_ann(spark, save(spark, tmp_path, data)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(data)
    assert got.keys() == want.keys()
    assert {q: [v for _, v, _ in found] for q, found in got.items()} == {q: [v for v, _ in found] for q, found in want.items()}
    assert [v for _, v, _ in got[100]] == [v for v, _ in want[100]] == list(range(500, 510))
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        far = dict(exact(data, k=10**6)[q])
        assert all(abs(far[v] - s) < 1e-12 for _, v, s in found)


def test_few_and_none(spark, tmp_path):
    got = ann.op10_ann(spark, save(spark, tmp_path / "a", [(100, [1.0] * 16), (1, [2.0] * 16), (2, [3.0] * 16)])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(100, 1, 1), (100, 2, 2)]
    assert ann.op10_ann(spark, save(spark, tmp_path / "b", [])).collect() == []
    assert ann.op10_ann(spark, save(spark, tmp_path / "c", [(100, None)])).collect() == []


def test_query_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 7 * (8 * 16 + 4 * ann.BOOKS * ann.WORDS))
    monkeypatch.setattr(ann, "CHUNK_ROWS", 100)
    monkeypatch.setattr(ann, "STEP_BYTES", 3000)
    data = rows(1500, 1)
    got = ann.op10_ann(spark, save(spark, tmp_path, data)).collect()
    want = exact(data)
    assert {r.query_id for r in got} == set(want)
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) >= 0.97 * len(got)


def test_beam_beats_greedy():
    x = np.random.default_rng(3).normal(size=(800, 16))
    q = ann.train(x)
    lost = [((x - q.decode(q.encode(x, beam))) ** 2).sum() for beam in (1, 8)]
    assert lost[1] < lost[0]


def test_near_copies_in_a_hot_cluster(spark, tmp_path):
    """A third of the rows lie closer together than the quantiser resolves; a chunk holds more of them than RERANK."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    x[1::3] = x[1] + rng.normal(size=(2000, 16)) * 0.004
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.op10_ann(spark, save(spark, tmp_path, data)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(data)
    assert got == {q: [v for v, _ in found] for q, found in want.items()}


def test_repeated_ids_and_extra_columns(spark, tmp_path):
    """Rows that repeat an id are candidates each; of a query's the smallest vector asks; other columns don't matter."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)).astype(np.float32).tolist()
    data = [(i, v) for i, v in enumerate(x)] + [(7, x[100]), (7, x[100]), (200, x[5])]
    spark.createDataFrame([(i, v, 0.5, "r", 1, 2) for i, v in data], "vec_id long, embedding array<float>, score double, rank string, query_id int, norm int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op10_ann(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, all_ = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float32).astype(float)
    for q in (0, 100, 200):
        own = min(v for i, v in data if i == q)
        far = np.sqrt(((all_ - np.array(own)) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        want = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far))[:10]]
        assert [v for v, _ in got[q]] == [v for v, _ in want]
    assert got[100][:2] == [(7, 0.0), (7, 0.0)]


def test_many_dimensions():
    """At 768 dimensions nothing that is held at once is much above its bound."""
    import tracemalloc

    rng = np.random.default_rng(7)
    q = ann.Quantiser(rng.normal(size=(ann.BOOKS, ann.WORDS, 768)))
    x = rng.normal(size=(3000, 768))
    frame = pd.DataFrame({"vec_id": range(3000), "codes": [bytes(ann.BOOKS)] * 3000, "norm": 1.0, "miss": 100.0, "embedding": list(x)})
    s = ann.Searcher(q, np.arange(2000), rng.normal(size=(2000, 768)), 10)
    tracemalloc.start()
    s.within(ann.chunks(iter([frame]), 768), np.full(2000, 36.0))
    assert tracemalloc.get_traced_memory()[1] < 10 * ann.STEP_BYTES
    tracemalloc.stop()


def test_bounds_spare_most_rows():
    """With clusters, the second round measures few of the rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32)) * 2
    x = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 32)) * 0.3
    q = ann.train(x[:3000])
    codes = q.encode(x)
    near = q.decode(codes)
    c = ann.Chunk(np.arange(8000), codes, (near**2).sum(axis=1), np.sqrt(((x - near) ** 2).sum(axis=1)), x)
    s = ann.Searcher(q, np.arange(0, 8000, 100), x[::100], 10)
    bound = s.rank(iter([c]), ann.RERANK).far[:, -1]
    seen = []
    t = ann.Searcher(q, np.arange(0, 8000, 100), x[::100], 10)
    real = t.measure
    t.measure = lambda of, chunk, wanted: (seen.append(wanted.mean()), real(of, chunk, wanted))
    best = t.within(iter([c]), bound)
    far = np.sqrt(((x[None, ::100].transpose(1, 0, 2) - x[None]) ** 2).sum(axis=2))
    far[np.arange(80), np.arange(0, 8000, 100)] = np.inf
    assert (np.sort(far, axis=1)[:, :10] == best.far).all() and max(seen) < 0.01
