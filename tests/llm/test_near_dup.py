"""Operator 2 against exact comparison of all pairs."""

import random
import re

import pytest
from tests.llm import fixtures

from quarry.llm import near_dup
from quarry.llm.components import components
from quarry.llm.shingles import MinHash, shingle_set


def exact(rows, k, percent=80):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets, parent = [], {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append((r[0], {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
        parent[r[0]] = r[0]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None:
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return sorted(((d, len(x), root(d), d is None or root(d) == d) for d, x in sets), key=str)


def families(seed=0):
    """A large star of near copies at all similarities, groups of exact copies, and strangers."""
    rng = random.Random(seed)
    rows, at = [], 100

    def add(text):
        nonlocal at
        rows.append(fixtures.row(at, text))
        at += 1

    for size, most in ((90, 30), (6, 8), (3, 3)):
        base = fixtures.words(rng, 160).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = fixtures.words(rng, 1)
            add(" ".join(w))
    for _ in range(4):
        text = fixtures.words(rng, 40)
        for _ in range(5):
            add(text if rng.random() < 0.5 else text.upper())
    for _ in range(40):
        add(fixtures.words(rng, rng.randint(1, 90)))
    for n in (1, 2, 3, 4):
        add(" ".join(["tiny"] * n))
        add(" ".join(["tiny"] * n))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_groups(spark, k):
    rows = families() + fixtures.edge_rows()
    got = near_dup.groups(fixtures.frame(spark, rows), k=k).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact(rows, k)


def test_query_and_empty(spark, tmp_path):
    rows = families(1)
    got = near_dup.op2_near_dup(spark, fixtures.save(spark, tmp_path / "a", rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact(rows, 4)
    assert near_dup.op2_near_dup(spark, fixtures.save(spark, tmp_path / "b", [])).collect() == []


def test_wide_regions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "REGION", 20)
    rows = families(2)
    got = near_dup.groups(fixtures.frame(spark, rows), k=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact(rows, 4)


def template_pages(n, kept, seed=0, words=200):
    """n pages that share one template's words but for own ones, at several shares."""
    rng = random.Random(seed)
    base = fixtures.words(rng, words).split()
    rows = []
    for i in range(n):
        share = kept[i % len(kept)]
        cut = int(words * share)
        rows.append(fixtures.row(10_000 + i, " ".join(base[:cut] + fixtures.words(rng, words - cut, "klmnopqrst").split())))
    rng.shuffle(rows)
    return rows


def test_wide_region_of_unlinked_rows(spark):
    """Pages of one template, most of them below the threshold: the groups are those of all pairs."""
    rows = template_pages(240, (0.6, 0.78, 0.85, 0.88, 0.9, 0.93))
    got = near_dup.groups(fixtures.frame(spark, rows), k=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact(rows, 4)


@pytest.mark.parametrize("share", [0.6, 0.8])
def test_templates_meet_nobody(spark, share):
    """In a wide region without links no pair comes out of the prefix join, so none is compared."""
    run = near_dup.Forest(fixtures.frame(spark, template_pages(150, (share,))), 4, 80)
    run.classes()
    run.regions()
    assert run.wide.count() > 0
    seen = []
    run.alike = lambda pairs: seen.append(pairs.count()) or pairs
    run.links = lambda pairs: pairs
    run.across(spark.createDataFrame([], "node long, component long")).collect()
    assert seen == [0]


def test_clashing_columns(spark):
    rows = [(i, "a b c d e f g h", i, i, i) for i in (1, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long, twice long, place long")
    assert [tuple(r) for r in near_dup.deduplicated(docs).collect()] == [rows[0]]


def test_deduplicated(spark):
    rows = families(3) + fixtures.edge_rows()
    got = near_dup.deduplicated(fixtures.frame(spark, rows))
    assert got.columns == fixtures.COLUMNS
    want = {d for d, _, _, kept in exact(rows, 5) if kept}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(1000, rng.randrange(2000, 2050)) for _ in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), []).collect()}
    assert got == {x: root(x) for x in parent}


def test_signature_estimates():
    rng = random.Random(6)
    a = fixtures.words(rng, 900).split()
    b = a[:800] + fixtures.words(rng, 100).split()
    x, y = shingle_set(" ".join(a), 4), shingle_set(" ".join(b), 4)
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    m = MinHash(1024)
    assert abs((m(x) == m(y)).mean() - true) < 0.06
