"""Sinks: partitioned tables with replacement by item, append-only traces, manifests, the sparse index."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search

#: Rows of a folder that one replacement writes again, and of a task that writes.
FOLDER_ROWS, TASK_ROWS = 4_000_000, 500_000
TRACE_FIELDS = "trace_id string, ts timestamp, query string, strategy string, success boolean, error string, latency_ms double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local master may do with its own temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/quarry-{os.getpid()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folders(rows: int, least: int = 1) -> int:
    return max(least, -(-rows // FOLDER_ROWS))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("item_key"), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, parts: int, n: int, dynamic: bool = False) -> None:
    """Folders by part, each written by as many tasks as its rows ask for; an item with many rows is dealt too."""
    tasks = max(1, -(-n // parts // TASK_ROWS))
    dealt = rows.repartition(min(parts * tasks, 10_000), "part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "part"]), F.lit(tasks)))
    out = dealt.write.partitionBy("part").mode("overwrite")
    (out.option("partitionOverwriteMode", "dynamic") if dynamic else out).parquet(path)


def write_chunks(chunks: DataFrame, path: str, parts: int | None = None) -> int:
    """All chunks, in folders by a hash of the item, so that one item is in one folder; returns their number, which
    replace_items asks for. It goes by the rows unless it is given."""
    n = chunks.count()
    parts = parts or folders(n)
    _write(chunks.withColumn("part", _part(parts)), path, parts, n)
    return parts


def replace_items(fresh: DataFrame, path: str, work: str, parts: int) -> None:
    """Replaces all chunks of the items in fresh. Only folders that hold one of them are read and written again.

    The new folders are written beside (work) and read back before they overwrite the old ones."""
    spark = fresh.sparkSession
    rows = fresh.withColumn("part", _part(parts))
    # no more rows than folders
    touched = [r.part for r in rows.select("part").distinct().collect()]
    old = spark.read.parquet(path).filter(F.col("part").isin(touched)).join(rows.select("item_key").distinct(), "item_key", "left_anti")
    old.unionByName(rows).write.mode("overwrite").parquet(work)
    again = spark.read.parquet(work)
    _write(again, path, max(1, len(touched)), again.count(), dynamic=True)


def append_traces(traces: DataFrame, path: str) -> None:
    """Appends, in folders by day, ordered by trace_id, so that a lookup by id skips what can't hold it."""
    traces.withColumn("day", F.to_date("ts")).sortWithinPartitions("trace_id").write.partitionBy("day").mode("append").parquet(path)


def find_traces(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The traces of some ids; files say which ids they can hold."""
    return spark.read.parquet(path).filter(F.col("trace_id").isin(ids))


class Traced:
    """A retrieval run that leaves a trace: `with Traced(spark, path, "t1", "query", "hybrid"): …` keeps how long it took, and
    its error if it raised one, which goes on to the caller."""

    def __init__(self, spark: SparkSession, path: str, trace_id: str, query: str, strategy: str):
        self.spark, self.path, self.fields = spark, path, (trace_id, query, strategy)

    def __enter__(self) -> Traced:
        self.began = time.perf_counter()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, _: object) -> None:
        trace_id, query, strategy = self.fields
        row = (trace_id, query, strategy, error is None, None if error is None else f"{kind.__name__}: {error}", (time.perf_counter() - self.began) * 1000)
        rows = self.spark.createDataFrame([row], "trace_id string, query string, strategy string, success boolean, error string, latency_ms double")
        append_traces(rows.withColumn("ts", F.current_timestamp()).select(*(x.split()[0] for x in TRACE_FIELDS.split(", "))), self.path)


def save_manifest(manifest: DataFrame, path: str, model: str, chunking: str) -> None:
    """item_key, version, with the embedding model and chunking version they were indexed with."""
    manifest.select("item_key", "version", F.lit(model).alias("embedding_model"), F.lit(chunking).alias("chunking_version")).write.mode("overwrite").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """The sparse index (search.tokenised) as it lies, a row a chunk, and the weights of its tokens."""
    index.write.mode("overwrite").parquet(f"{path}/chunks")
    search.idf(index.sparkSession.read.parquet(f"{path}/chunks")).write.mode("overwrite").parquet(f"{path}/idf")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What search.bm25 takes as index and known."""
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/idf")
