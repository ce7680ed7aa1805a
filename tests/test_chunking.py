"""Chunkers and sections."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.operators import chunking


def sliding(spark, text):
    pages = spark.createDataFrame([("a", 1, text)], "item_key string, page_num int, text string")
    return [r.text for r in chunking.merge_short(chunking.sliding(pages)).orderBy("chunk_idx").collect()]


@pytest.mark.parametrize(("n", "sizes"), [(599, [599]), (600, [722]), (1079, [600, 599]), (1080, [600, 722])])
def test_windows(spark, n, sizes):
    text = "".join(chr(97 + i % 26) for i in range(n))
    assert [len(x) for x in sliding(spark, text)] == sizes


def test_blank(spark):
    assert sliding(spark, " \n ") == [] and sliding(spark, "") == []


@pytest.mark.parametrize("n", [5, 600, 1500, 4000])
def test_fold_agrees_with_closed_form(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    assert [r["text"] for r in chunking.chunk_item([(1, text)])] == sliding(spark, text)


def test_sections(spark):
    rows = [("a", 0, "1. Introduction"), ("a", 1, "plain"), ("a", 2, "2. Methods"), ("b", 0, "no heading")]
    chunks = spark.createDataFrame([(*r, "ok") for r in rows], "item_key string, chunk_idx int, text string, quality_flag string")
    got = {(r.item_key, r.chunk_start_idx, r.chunk_end_idx, r.section_type) for r in chunking.sections(chunks).collect()}
    assert got == {("a", 0, 1, "introduction"), ("a", 2, 2, "methods"), ("b", 0, 0, "unknown")}
    assert chunking.section_map(chunks, chunking.sections(chunks)).count() == 4


def test_parents(spark):
    rows = [("a", i, t, "ok") for i, t in enumerate(["1. Alpha part", "1.1 Beta part", "1.1.1 Gamma part", "2. Delta part", "2.1 Epsilon part"])]
    chunks = spark.createDataFrame(rows, "item_key string, chunk_idx int, text string, quality_flag string")
    got = {r.chunk_start_idx: r.parent_idx for r in chunking.sections(chunks).collect()}
    assert got[0] is None and got[1] == 1 and got[2] == 2 and got[3] is None and got[4] == 4


def test_general_chunker():
    body = "\n\n".join(f"Paragraph {i} says that things hold. It goes on for a while, as Table 1 shows, until it ends here." * 3 for i in range(8))
    table = "\n\nTable 1. Values\n1 2 3\n4 5 6\n7 8 9\n\n"
    rows = chunking.chunk_item([(1, body + table), (2, "References\n\n" + "\n\n".join(f"[{i}] Someone, a title of a paper that is long enough, {1990 + i}." for i in range(6)))])
    prose = [r for r in rows if r["kind"] == "prose"]
    assert [r["ref"] for r in rows if r["kind"] == "table"] == ["1"]
    assert any(r["section"] == "references" for r in prose) and any(r["table_refs"] == ["1"] for r in prose)
    assert [r["chunk_idx"] for r in rows] == list(range(len(rows)))
    assert all(r["page_start"] <= r["page_end"] for r in rows)
    assert chunking.chunk_item([]) == [] and chunking.chunk_item([(1, None)]) == []


def test_measure_words_are_no_references():
    assert chunking.cited("see Tables 3 and 4, and 表 5 个", "table", {"3", "4", "5"}) == ["3", "4"]


@given(st.text("ab. ,\n。", max_size=3000))
def test_hard_split_keeps_text(text):
    parts = chunking.hard_split(text)
    assert all(0 < len(x) <= chunking.MOST for x in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
