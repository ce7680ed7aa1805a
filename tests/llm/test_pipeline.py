"""The pipeline against its stages by brute force."""

import hashlib
import math
import random

import pytest
from tests.llm import fixtures
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dup import exact
from tests.llm.test_pii import KEY
from tests.llm.test_pii import brute as brute_pii

from quarry.llm import common, pii, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LABELS = "doc_id long, quality int, toxic int"


def made():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(100, 800):
        w = fixtures.words(rng, rng.randint(8, 60)).split()
        bad = rng.random() < 0.15
        if bad:
            w.insert(3, rng.choice(("vilexo", "slurxx")))
        if i % 9 == 0:
            w.insert(1, f"user{i}@mail.example.com")
        if i % 10 == 0 and i > 100:
            w = rows[-1][1].split()[:-1]
            bad = labels[-1][2]
        rows.append(fixtures.row(i, " ".join(w), "en", f"s{i % 4}" if i % 3 else "hot"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def naive_score(m, text):
    """The machine's formula, pair by pair."""
    at = sorted({m.index[b] for w in toxicity.WORDS.findall((text or "").lower()) for b in toxicity.buckets(w) if b in m.index})
    y = m.bias + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for n, i in enumerate(at) for j in at[:n])
    return 1 / (1 + math.exp(-max(-30, min(30, y))))


def test_run(spark, tmp_path):
    spark.conf.set(pii.KEY, KEY)
    rows, labels = made()
    rows += fixtures.edge_rows()
    d = fixtures.save(spark, tmp_path / "in", rows, labels=(labels, LABELS))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "byte_bpe"]

    clean = stages["toxicity"](spark, docs, d)
    kept = clean.collect()
    toxic = {i for i, _, t in labels if t}  # ids from 100 on; those of the edge rows are below
    assert not toxic & {r.doc_id for r in kept} and len(kept) >= len(rows) - len(toxic) - 3
    assert clean.columns == fixtures.COLUMNS
    machine = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert sorted((tuple(r) for r in kept), key=str) == sorted((tuple(r) for r in docs.collect() if naive_score(machine, r.text) < 0.5), key=str)

    plain = [tuple(r) for r in kept]
    want_ids = {i for i, _, _, keep in exact(plain, 5) if keep}
    once = {}
    for r in sorted(plain, key=lambda r: (str(r[0]), r[1] is not None, r[1] or "")):
        if r[0] in want_ids:
            once.setdefault(r[0], r)
    texts = {i: (brute_pii(r[1]) if r[1] is not None else None) for i, r in once.items()}
    mix = brute_mix([(r[0], texts[i], *r[2:]) for i, r in once.items()])
    want = []
    for doc_id, size, _, _, taken in mix:
        if size:
            want += [(doc_id, hashlib.sha256((texts[doc_id] or "").encode()).hexdigest())] * (taken // size)
    before = common.made()
    got = corpus_pipeline.run(spark, d).collect()
    # of the scratch tables only the last stage's input is left
    assert len(common.made() - before) == 1
    spark.conf.unset(pii.KEY)
    blank = {i for i, t in texts.items() if not (t or "").split()}
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got if r.doc_id not in blank), key=str) == sorted(want, key=str)
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)


def test_empty(spark, tmp_path):
    d = fixtures.save(spark, tmp_path / "in", [], labels=([], LABELS))
    assert corpus_pipeline.run(spark, d).collect() == []
    assert toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).score("x") == 0
