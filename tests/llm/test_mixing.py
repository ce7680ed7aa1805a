"""Operator 7 against a plain mix and DuckDB."""

import hashlib
import re

import duckdb
from tests.llm import fixtures

from quarry.llm import mixing


def brute(rows, most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    everything, target, stopped = sum(total.values()), {}, set()
    while True:
        left = everything - sum(most * total[s] for s in stopped)
        share = sum(weight[s] for s in sources if s not in stopped)
        target = {s: most * total[s] if s in stopped else left * weight[s] / share for s in sources}
        over = {s for s in sources if s not in stopped and target[s] > most * total[s]}
        if not over:
            break
        stopped |= over
    code = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:9], 16)
    out = []
    for s in sources:
        mine = [r for r in rows if r[3] == s]
        times = min(most, int(target[s] // total[s])) if total[s] else 0
        budget, bound = target[s] - times * total[s], 0
        if budget > 0:
            upto, bound = 0, 1 << 36
            for h in sorted({code(r[0]) for r in mine}):
                n = sum(size(r[1]) for r in mine if code(r[0]) == h)
                if upto + n > budget:
                    bound = h + (upto + n - budget < budget - upto)
                    break
                upto += n
        out += [(r[0], size(r[1]), total[s], round(target[s], 6), size(r[1]) * (times + (code(r[0]) < bound))) for r in mine]
    return sorted(out, key=str)


def rows():
    import random

    rng = random.Random(8)
    hot = [fixtures.row(1000 + i, fixtures.words(rng, rng.randint(0, 60)), "en", "hot") for i in range(300)]
    more = [fixtures.row(2000 + i, fixtures.words(rng, rng.randint(1, 30)), "en", f"s{i % 7}") for i in range(60)]
    return hot + more + [fixtures.row(5000, "", "en", "empty"), fixtures.row(5001, None, "en", "empty")] + fixtures.edge_rows()


def test_against_brute_force(spark, tmp_path):
    d = fixtures.save(spark, tmp_path / "in", rows())
    got = mixing.op7_mixing(spark, d).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows())
    for s in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == s]
        longest = max(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target * len({(r.target) for r in mine})) <= max(1, longest) or len({r.target for r in mine}) > 1
        assert all(r.taken <= 3 * r["size"] for r in mine)


def test_against_sql(spark, tmp_path):
    d = fixtures.save(spark, tmp_path / "in", rows())
    got = mixing.op7_mixing(spark, d)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    rel = c.sql(mixing.OP7_SQL)
    at = [rel.columns.index(x) for x in got.columns]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=str)


def test_rows_as_often_as_taken(spark, tmp_path):
    docs = fixtures.frame(spark, rows())
    got = mixing.mixed(docs)
    assert got.columns == fixtures.COLUMNS
    want = []
    for doc_id, size, _, _, taken in brute(rows()):
        if size:
            want += [doc_id] * (taken // size)
    assert sorted((r.doc_id for r in got.collect() if r.text and r.text.split()), key=str) == sorted(want, key=str)


def test_empty(spark, tmp_path):
    assert mixing.op7_mixing(spark, fixtures.save(spark, tmp_path / "in", [])).collect() == []
    assert mixing.mixed(fixtures.frame(spark, [])).collect() == []
