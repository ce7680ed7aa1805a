"""Shared helpers."""

import os

import pandas as pd
from pyspark.sql import functions as F

from quarry.llm import common


def test_scratch_tables(spark):
    paths = []
    df = common.settle(spark.range(5), paths)
    assert df.count() == 5 and paths[0].startswith(spark.conf.get("spark.checkpoint.dir"))
    local = paths[0].removeprefix("file://")
    common.drop(spark, paths)
    assert not os.path.exists(local) and paths == []
    other = common.scratch_path(spark)
    spark.range(1).write.parquet(other)
    common.clear(spark)
    assert not os.path.exists(other.removeprefix("file://"))


def test_small_counts_before_it_broadcasts(spark):
    few, many = common.small(spark.range(3), 3), common.small(spark.range(4), 3)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(few) and "broadcast" not in plan(many)


def test_chunks_keep_all_rows():
    frame = pd.DataFrame({"doc_id": range(7), "text": ["a" * 5, None, "", "b" * 30, "c", "d" * 9, "e"]})
    parts = list(common.chunks(iter([frame, frame.iloc[:0]]), most=10))
    assert pd.concat(parts)["doc_id"].tolist() == list(range(7)) and len(parts) > 2


def test_let_evaluates_once(spark):
    row = spark.range(1).select(common.let(F.rand(), lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("s")).first().s
    assert row.a == row.b


def test_batches_are_bounded(spark):
    common.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_caches_go_when_another_operator_enters(monkeypatch):
    gone = []
    monkeypatch.setattr(common, "_holder", "")
    monkeypatch.setattr(common, "_forget", {})
    common.forgets("a", lambda: gone.append("a"))
    for op in ("a", "a", "b", "b"):
        common.enter(op)
    assert gone == ["a"]
    common.enter("a")
    common.enter("c")
    assert gone == ["a", "a"]
