"""Operator 5: base counts by brute force, outliers on made groups."""

import collections
import random
import re

import numpy as np
from tests.llm import fixtures

from quarry.llm import quality


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mark)


def rows():
    rng = random.Random(9)
    out = []
    for i in range(400):
        group = ("en", "hot") if i % 3 else ("fr", f"s{i % 2}")
        out.append(fixtures.row(100 + i, "\n".join(fixtures.words(rng, 30) for _ in range(4)) + ".", *group))
    for i in range(12):
        out.append(fixtures.row(900 + i, " ".join(f"{x}%%%" for x in fixtures.words(rng, 120).split()), "en", "hot"))
        out.append(fixtures.row(930 + i, fixtures.words(rng, 120).upper(), "fr", f"s{i % 2}"))
    out.append(fixtures.row(990, "a b c d a b c a b c\n" * 20))
    out.append(fixtures.row(991, "one line\none line\n\none line\n" + fixtures.words(rng, 60)))
    return out + fixtures.edge_rows()


def test_base_counts(spark, tmp_path):
    got = quality.op5_quality(spark, fixtures.save(spark, tmp_path / "in", rows())).collect()
    want = []
    for r in rows():
        b = base(r[1])
        want.append((r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)


def test_outliers(spark):
    got = {r.doc_id: r for r in quality.judged(fixtures.frame(spark, rows())).collect()}
    assert all(got[100 + i].kept for i in range(400))
    assert not any(got[i].kept for i in (*range(900, 912), *range(930, 942)))


def test_estimates_resist_a_third_of_outliers(spark):
    """A classical covariance would be widened by so many; the concentrated one is near that of the good rows alone."""
    rng = random.Random(3)
    good = [fixtures.row(i, fixtures.words(rng, 100)) for i in range(300)]
    bad = [fixtures.row(1000 + i, " ".join(f"{x}|||" for x in fixtures.words(rng, 100).split())) for i in range(70)]
    got = {r.doc_id: r for r in quality.judged(fixtures.frame(spark, good + bad)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(70))


Q = quality


def fitted(x):
    """Mean and covariance of a group's rows, by the same steps in numpy."""
    n, floor = len(x), np.diag(np.array(Q.FLOOR) ** 2)

    def weighed(v, w, wider=1.0):
        m = (w[:, None] * v).sum(axis=0) / w.sum() / Q.SCALE
        return m, ((w[:, None, None] * v[:, :, None] * v[:, None, :]).sum(axis=0) / w.sum() / Q.SCALE**2 - np.outer(m, m)) * wider + floor

    def far(m, c):
        z = x / Q.SCALE - m
        return np.floor(np.minimum(np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z), Q.MOST) * Q.STEP)

    middle = np.median(x, axis=0)
    d = np.sqrt((1.4826 * np.median(abs(x - middle), axis=0)) ** 2 + (np.array(Q.FLOOR) * Q.SCALE) ** 2)
    box = (abs(x - middle) <= Q.BOX * d).all(axis=1)
    begins = [(middle / Q.SCALE, np.diag((d / Q.SCALE) ** 2)), weighed(np.clip(x, np.round(middle - Q.WINSOR * d), np.round(middle + Q.WINSOR * d)), np.ones(n))]
    if box.any():
        begins.append(weighed(x[box], np.ones(box.sum())))
    ends = []
    for m, c in begins:
        for _ in range(Q.STEPS):
            f = far(m, c)
            half = min(n, (n + Q.P + 1) // 2)
            bound = np.sort(f)[half - 1]
            m, c = weighed(x, np.where(f < bound, 1, np.where(f == bound, (half - (f < bound).sum()) / (f == bound).sum(), 0)), Q.CONSISTENT)
        ends.append((m, c))
    m, c = min(ends, key=lambda e: round(np.linalg.slogdet(e[1])[1] / 2, 9))
    f = far(m, c)
    return weighed(x, (f <= (np.median(f) + 0.5) / Q.MEDIAN_5 * Q.INNER_5).astype(float))


def test_verdicts_by_brute_force(spark):
    """Groups of their own, languages that pool, a lone source, copies of junk and spread-out junk."""
    rng = random.Random(12)
    data = []

    def add(n, lang, source, make):
        data.extend(fixtures.row(len(data), make(), lang, source) for _ in range(n))

    plain = lambda: "\n".join(fixtures.words(rng, rng.randint(10, 60)) for _ in range(rng.randint(3, 9)))
    junk = " ".join(f"{x}##" for x in fixtures.words(rng, 100).split())
    loud = lambda: fixtures.words(rng, 90).upper() + " $ |" * rng.randint(0, 60)
    for lang, source, n in (("en", "a", 150), ("en", "b", 70), ("en", "c", 5), ("de", "a", 40), ("de", None, 45), (None, "x", 3)):
        add(n, lang, source, plain)
        add(n // 4, lang, source, loud)
        add(n // 5, lang, source, lambda: junk)
    docs = spark.createDataFrame(data, fixtures.SCHEMA)
    stats = [r for r in Q.measured(docs).collect() if not r.base_failed]
    pairs = collections.Counter((r.lang, r.source) for r in stats)
    langs = collections.Counter(r.lang for r in stats)
    group = {p: p if n >= Q.LEAST_ROWS else (p[0],) if langs[p[0]] >= Q.LEAST_ROWS else () for p, n in pairs.items()}
    assert {len(g) for g in group.values()} == {0, 1, 2}
    x = {g: np.array([[r[f"x{k}"] for k in range(Q.P)] for r in stats if (r.lang, r.source)[: len(g)] == g], float) for g in set(group.values())}
    fits = {g: fitted(v) for g, v in x.items()}
    got = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert len(got) == len(data)
    verdicts = collections.Counter()
    for r in stats:
        m, c = fits[group[r.lang, r.source]]
        z = np.array([r[f"x{k}"] for k in range(Q.P)]) / Q.SCALE - m
        d = z @ np.linalg.inv(c) @ z
        assert abs(got[r.doc_id].distance - d) <= 1e-6 * (1 + d)
        assert got[r.doc_id].kept == (d <= Q.CUT)
        verdicts[d <= Q.CUT] += 1
    assert min(verdicts.values()) > 40


def test_copies_of_a_junk_page(spark):
    """Identical junk rows as a third and as 40 % of a group."""
    rng = random.Random(6)
    rows = []
    for source, n in (("third", 150), ("more", 200)):
        junk = " ".join(f"{x}|||" for x in fixtures.words(rng, 100).split())
        rows += [fixtures.row(i, fixtures.words(rng, 100), "en", source) for i in range(300)]
        rows += [fixtures.row(1000, junk, "en", source) for _ in range(n)]
    got = quality.judged(fixtures.frame(spark, rows)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_cholesky(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(quality.P, quality.P))
    cov = a @ a.T + np.eye(quality.P)
    mean = rng.normal(size=quality.P)
    row = {"group": "g"} | {f"m{k}": float(mean[k]) for k in range(quality.P)} | {f"c{i}{j}": float(cov[i, j]) for i, j in quality._triangle()}
    params = quality.factored(spark.createDataFrame([row]), [])
    x = rng.integers(-3000, 3000, quality.P)
    point = spark.createDataFrame([{"group": "g"} | {f"x{k}": int(x[k]) for k in range(quality.P)}])
    got = point.join(params, "group").select(quality.distance().alias("d")).first().d
    z = x / quality.SCALE - mean
    assert abs(got - z @ np.linalg.inv(cov) @ z) < 1e-6


def test_empty_and_few(spark, tmp_path):
    assert quality.op5_quality(spark, fixtures.save(spark, tmp_path / "a", [])).collect() == []
    got = quality.op5_quality(spark, fixtures.save(spark, tmp_path / "b", fixtures.edge_rows())).collect()
    assert all(r.kept != r.base_failed for r in got)
