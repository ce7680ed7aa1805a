"""Hand-made cases of column functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.functions import text as T
from quarry.operators import chunking, cleaning, expand, library
from quarry.plans import journal


def one(spark, column, **values):
    fields = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    row = spark.createDataFrame([tuple(v[0] for v in values.values())], fields)
    return row.select(column.alias("x")).first().x


def s(v):
    return (v, "string")


@pytest.mark.parametrize(
    ("text", "want"),
    [("城市 GIS 网", ["城", "市", "网", "城市", "市网", "gis"]), ("A bc, DEF ghi", ["bc", "def", "ghi"]), ("", []), (None, None), ("字", ["字"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=s(text)) == want


@pytest.mark.parametrize(("text", "want"), [("漢" * 13 + "abcde", "zh"), ("漢" + "a" * 19, "en"), ("123", "en"), ("漢" * 5 + "a" * 5, "mixed")])
def test_chunk_language(spark, text, want):
    assert one(spark, T.chunk_language(F.col("t")), t=s(text)) == want


@pytest.mark.parametrize(("text", "want"), [("A。B！C. D", 4), ("one two", 1), (" ", 0), ("a.b", 1)])
def test_sentences(spark, text, want):
    assert len(one(spark, T.sentences(F.col("t")), t=s(text))) == want


@pytest.mark.parametrize(("text", "want"), [("May 2019, rev. 2020", 2019), ("12345", 0), ("", 0), (None, 0)])
def test_year(spark, text, want):
    assert one(spark, T.parse_year(F.col("t")), t=s(text)) == want
    assert one(spark, T.loose_year(F.col("t")), t=s("x2021y")) == 2021


@pytest.mark.parametrize(
    ("text", "want"),
    [("10.1000/xyz", "doi"), ("https://arxiv.org/abs/1234.5678", "url"), ("1706.03762", "arxiv"), ("@article{x, title={y}}", "bibtex"), ("9783161484100", "isbn"), ("978-3-16-148410-0", "isbn"), ("https://doi.org/10.1/x", "url"), ("other", "doi")],
)
def test_identifier(spark, text, want):
    assert one(spark, names.identifier_kind(F.col("t")), t=s(text)) == want


@pytest.mark.parametrize(("name", "want"), [("王小明", "王"), ("Smith, J.", "Smith"), ("Smith J", "Smith"), ("Ann Lee", "Lee"), ("Plato", "Plato")])
def test_surname(spark, name, want):
    assert one(spark, names.surname(F.col("t")), t=s(name)) == want


def test_authors_and_citation(spark):
    a = lambda *x: (list(x), "array<string>")
    cite = names.inline_citation(F.col("a"), F.col("y"), F.col("p"))
    assert one(spark, names.short_authors(F.col("a")), a=a("A B", "C D", "E")) == "A B et al."
    assert one(spark, names.short_authors(F.col("a")), a=a()) == ""
    assert one(spark, cite, a=a("Ann Lee", "Bo Ek"), y=(2020, "int"), p=(3, "int")) == "(Lee & Ek, 2020, p.3)"
    assert one(spark, cite, a=a(), y=(0, "int"), p=(None, "int")) == "(Unknown, n.d.)"


def test_bibtex(spark):
    got = one(spark, names.bibtex_fields(F.col("t")), t=s('@article{k, Title = {A b}, author = "X and Y", year = {2020}, note = {}}'))
    assert got == {"title": "A b", "author": "X and Y", "year": "2020"}


def test_doi_from_url(spark):
    get = names.doi_from_url(F.col("u"), F.col("h"))
    assert one(spark, get, u=s("https://x.org/10.1234/ab.c?q"), h=s("")) == "10.1234/ab.c"
    assert one(spark, get, u=s("https://x.org/a"), h=s('<meta name="citation_doi" content="10.9999/zz">')) == "10.9999/zz"
    assert one(spark, get, u=s("https://x.org/a"), h=s("<p>")) is None


def test_snippet(spark):
    text = "a" * 180 + ". " + "b" * 200
    assert one(spark, T.snippet(F.col("t")), t=s(text)) == "a" * 180 + ".…"
    assert len(one(spark, T.snippet(F.col("t")), t=s("c" * 400))) == 301
    assert one(spark, T.snippet(F.col("t")), t=s("short")) == "short"


def test_stance_modes(spark):
    cues = (("support", "demonstrate"), ("refute",), ("debate",))
    strict = T.stance(T.stance_counts(F.col("t"), *cues))
    loose = T.stance(T.stance_counts(F.col("t"), *cues, stems=True))
    assert one(spark, strict, t=s("it demonstrates that")) == "neutral"
    assert one(spark, loose, t=s("it demonstrates that")) == "supporting"
    assert one(spark, strict, t=s("refute, support")) == "neutral"


def test_cleaning(spark):
    clean = lambda x: one(spark, cleaning.cleaned(F.col("t")), t=s(x))
    assert clean("A B S T R A C T\n\nreal body line\nhttps://example.org/x\n12\nmore text") == "\nreal body line\n12\nmore text"
    assert clean("Published results\n12\n13\n14\n15\nend") == "Published results\nend"
    assert clean("a\n\n\n\n\nb") == "a\n\nb"
    assert clean(None) is None and clean("") == "" and clean("\n") == "" and clean("x\r\ny\n") == "x\ny"


def page_numbers(text):
    """The fold over lines, with the last three that were kept."""
    kept, near = [], []
    for line in text.split("\n"):
        if re.fullmatch(r"\d{1,4}", line) and any(re.search(r"第\s*\d+\s*卷|Published", x) for x in near):
            continue
        kept.append(line)
        near = [*near, line][-3:]
    return "\n".join(kept)


def test_page_numbers(spark):
    rng = random.Random(1)
    texts = [journal.NUMBERED, *("\n".join(rng.choice(["12", "7", "x", "y", "Published results"]) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", cleaning.cleaned(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == re.sub("\n{3,}", "\n\n", page_numbers(texts[r.i]))


def test_line_classes(spark):
    lines = [*journal.GOING, *((None, x) for x in journal.STAYING), (None, ""), (None, "plain words")]
    rows = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(lines)], "i int, t string").select("i", cleaning.category(F.col("t")).alias("c")).collect()
    assert {lines[r.i][1]: r.c for r in rows} == {x: c for c, x in lines}
    assert {c for c, _ in journal.GOING} == set(cleaning.CLASSES)


def test_decompose(spark):
    d = lambda parity=False: expand.decomposed(F.col("t"), parity)
    assert one(spark, d(), t=s("understanding urban growth")) == []
    assert one(spark, d(True), t=s("understanding urban growth")) == ["underst", "ing urban growth"]
    assert one(spark, d(), t=s("urban growth and land cover")) == ["urban growth", "land cover"]


def test_sync_and_verify(spark):
    m = "item_key string, version long"
    got = library.sync_diff(spark.createDataFrame([("a", 1), ("b", 1)], m), spark.createDataFrame([("b", 2), ("c", 1)], m))
    assert {tuple(r) for r in got.collect()} == {("c", "new"), ("b", "modified"), ("a", "deleted")}
    votes = [("x", False), ("x", False), ("y", False), ("y", None), ("z", True), ("z", False)]
    assert {tuple(r) for r in library.verified(spark.createDataFrame(votes, "doi string, found boolean")).collect()} == {("x", False), ("y", True), ("z", True)}
    assert library.needs_rebuild(("m", ""), ("n", "2")) and not library.needs_rebuild(("", ""), ("n", "2"))


@pytest.mark.parametrize(("a", "n", "opened", "want"), [(3, 0, False, "deep_read"), (0, 1, False, "deep_read"), (1, 0, False, "browsed"), (0, 0, True, "browsed"), (0, 0, False, "unread")])
def test_reading_status(spark, a, n, opened, want):
    assert one(spark, library.reading_status(F.col("a"), F.col("n"), F.col("o")), a=(a, "int"), n=(n, "int"), o=(opened, "boolean")) == want


def test_year_bounds(spark):
    assert one(spark, library.year_range(F.col("y"), 2000, None), y=(0, "int")) is False
    assert one(spark, library.year_range(F.col("y"), 2000, None, keep_unknown=True), y=(0, "int")) is True
    assert one(spark, library.year_range(F.col("y"), None, None), y=(0, "int")) is True


def test_headings(spark):
    assert one(spark, chunking.heading_level(F.col("t")), t=s("1. Introduction")) == 1
    assert one(spark, chunking.heading_level(F.col("t")), t=s("2.1 Study area")) == 2
    assert one(spark, chunking.heading_level(F.col("t")), t=s("Just a sentence here.")) is None
