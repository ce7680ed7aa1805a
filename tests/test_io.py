"""Sources, sinks and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import library
from quarry.sources import readers, sinks
from quarry.streaming import traces


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"_meta": {}, "queries": [{"query_text": "a", "expected_item_keys": ["k"], "category": "direct"}, {"query_id": "Z", "query_text": "b"}]}))
    got = readers.golden_queries(spark, str(tmp_path / "q.json")).orderBy("query_text").collect()
    assert [(r.query_id, r.expected) for r in got] == [("Q000", ["k"]), ("Z", [])]
    (tmp_path / "d.json").write_text(json.dumps({"城市": ["city", "urban"], "x": []}))
    assert {tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.json")).collect()} == {("城市", "city"), ("城市", "urban")}
    (tmp_path / "t.jsonl").write_text('{"trace_id": "1", "ts": "2024-01-01T10:00:00", "success": true}\nnot json\n{"trace_id": "2", "ts": "bad"}\n')
    got = {r.trace_id: r.ts for r in readers.traces(spark, str(tmp_path / "t.jsonl")).collect()}
    assert got == {"1": datetime.datetime(2024, 1, 1, 10), "2": None}


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "K1.pdf").write_bytes(b"one\x0c \x0cthree")
    pages = readers.pdf_pages(spark, str(tmp_path / "*.pdf"), lambda b: b.decode().split("\x0c"))
    assert sorted(tuple(r) for r in pages.collect()) == [("K1", 1, "one"), ("K1", 3, "three")]
    assert readers.full_text(pages, most=1).first().text == "--- page 1 ---\none\n\n[truncated]"


def test_records_source(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "W1", "title": "A", "year": 2020}\n{"id": "W2", "title": "B", "doi": "10.1/b"}\n')
    got = readers.records(spark, str(tmp_path / "r.jsonl"), "works").orderBy("rank").collect()
    assert [(r.source, r.source_id, r["rank"], r.year) for r in got] == [("works", "W1", 1, 2020), ("works", "W2", 2, 0)]


def test_titles_and_abstracts(spark):
    seeds = spark.createDataFrame([(1, "Urban growth of large cities"), (2, "Nothing alike")], "seed_id long, title string")
    works = spark.createDataFrame([(10, "urban growth of cities"), (11, "growth of plants"), (12, "something else")], "work_id long, title string")
    assert [tuple(r) for r in readers.title_matches(seeds, works).collect()] == [(1, 10)]
    index = spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},)], "i map<string, array<int>>")
    assert index.select(readers.abstract_from_index(F.col("i")).alias("x")).first().x == "a b a b"


def test_replace_items(spark, tmp_path):
    schema = "item_key string, chunk_idx int, text string"
    path = str(tmp_path / "chunks")
    sinks.write_chunks(spark.createDataFrame([(k, i, f"{k}{i}") for k in "abcdef" for i in range(3)], schema), path, 4)
    sinks.replace_items(spark.createDataFrame([("b", 0, "new")], schema), path, str(tmp_path / "work"), 4)
    got = {(r.item_key, r.chunk_idx, r.text) for r in spark.read.parquet(path).collect()}
    assert got == {(k, i, f"{k}{i}") for k in "acdef" for i in range(3)} | {("b", 0, "new")}
    m = spark.createDataFrame([("a", 1)], "item_key string, version long")
    sinks.save_manifest(m, str(tmp_path / "m"), "model", "1")
    assert library.sync_diff(spark.read.parquet(str(tmp_path / "m")), m).first().status == "unchanged"


def logged(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=17 * i), "ab"[i % 2], i % 5 > 0, float(i)) for i in range(60)]
    return spark.createDataFrame(rows, traces.LOG_SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    logged(spark).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).repartition(4).write.json(str(tmp_path / "in"))
    stream = traces.hourly(traces.read_json_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("hours").collect()}
    assert got == {tuple(r) for r in traces.hourly(logged(spark)).collect()}


def test_upsert(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    schema = "k string, version long, v string"
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        traces.follow(spark.readStream.schema(schema).json(str(source)), traces.upsert_into(target, "k"), str(tmp_path / "check")).awaitTermination(60)
    assert {(r.k, r.v) for r in traces.newest(spark, target, "k", "version").collect()} == {("a", "z"), ("b", "y")}


def test_late_rows(spark):
    rows = logged(spark).withColumn("ts", F.when(F.col("trace_id") > 2, F.col("ts")))
    timed, without = traces.split_late(rows)
    assert timed.count() == 57 and without.count() == 3


def test_folders_by_rows(spark, tmp_path, monkeypatch):
    """More rows, more folders and tasks; an item is in one folder, however many rows it has."""
    monkeypatch.setattr(sinks, "FOLDER_ROWS", 50)
    monkeypatch.setattr(sinks, "TASK_ROWS", 20)
    rows = [("hot" if i % 3 else f"k{i}", i, f"t{i}") for i in range(300)]
    path = str(tmp_path / "c")
    parts = sinks.write_chunks(spark.createDataFrame(rows, "item_key string, chunk_idx int, text string"), path)
    assert parts == 6
    got = spark.read.parquet(path)
    assert sorted((r.item_key, r.chunk_idx, r.text) for r in got.collect()) == sorted(rows)
    assert got.groupBy("item_key").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
    assert len([x for x in got.inputFiles() if "/part=" in x]) > got.select("part").distinct().count()


def test_traced(spark, tmp_path):
    path = str(tmp_path / "t")
    with sinks.Traced(spark, path, "a", "q", "hybrid"):
        pass
    with pytest.raises(KeyError), sinks.Traced(spark, path, "b", "q", "dense"):
        raise KeyError("gone")
    a, b = sinks.find_traces(spark, path, ["a"]).first(), sinks.find_traces(spark, path, ["b", "c"]).first()
    assert a.success and a.error is None and a.latency_ms >= 0 and a.ts is not None
    assert not b.success and b.error == "KeyError: 'gone'" and b.strategy == "dense"


def test_outline(spark, tmp_path):
    (tmp_path / "K1.pdf").write_bytes(b"1|Intro|1;2|Scope|2")
    parse = lambda b: [(int(x), y, int(z)) for x, y, z in (e.split("|") for e in b.decode().split(";"))]
    assert [tuple(r) for r in readers.pdf_outline(spark, str(tmp_path / "*.pdf"), parse).orderBy("place").collect()] == [("K1", 0, 1, "Intro", 1), ("K1", 1, 2, "Scope", 2)]


def test_open_access(spark):
    rows = [("a", "unpaywall", None), ("a", "arxiv", "u1"), ("a", "pmc", "u2"), ("b", "core", ""), ("c", "other", "u3")]
    got = library.first_open(spark.createDataFrame(rows, "item_key string, stage string, url string"), ["unpaywall", "pmc", "arxiv", "core"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "pmc", "u2")]
