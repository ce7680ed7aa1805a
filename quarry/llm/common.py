"""What the operators share: tables, scratch tables, size-checked joins and batching."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import spread

#: A side with at most this many narrow rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000

#: Characters of text that a Python worker handles at once.
CHUNK_CHARS = 2_000_000

#: Bounds of an Arrow batch: whole texts are rows, so Spark's default of 10 000 may take much memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


#: Arrow's own pool keeps what was freed; the system's gives it back.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started, and bounds what they get at once.

    A larger bound on batches in the session's settings is lowered; a smaller one stays."""
    for key, value in BATCH.items():
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= int(value):
            spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)


#: Scratch tables that this process has made and not dropped.
_made: set[str] = set()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares. Only a local master, whose tasks run on this machine, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/quarry-{os.getpid()}"
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
    path = f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def settle(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    keep, if given, gets the path, for drop() once nothing reads it any more."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made.discard(path)
    paths.clear()


def made() -> set[str]:
    """The scratch tables there are now."""
    return set(_made)


def path_of(df: DataFrame) -> str | None:
    """The scratch table that a settled DataFrame reads."""
    return getattr(df, "_quarry_path", None)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this process. Results that still read one must have been written before."""
    drop(spark, sorted(_made))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a settled table, marked for broadcast if its counted rows are few; else a shuffle join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sampled(key: Column, count: int, most: int) -> Column:
    """Whether a row is in a sample of about `most` of `count` rows, by the 64-bit hash of its key; all if they are no more."""
    return F.xxhash64(key) < (1 << 64) * most // count - (1 << 63) if count > most else F.lit(True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names, made from these, that df doesn't have (in any case)."""
    taken = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_holder = ""
_forget: dict[str, list[Callable[[], object]]] = {}


def forgets(op: str, *clear: Callable[[], object]) -> None:
    """Names what clears the caches that an operator keeps in a Python worker."""
    _forget.setdefault(op, []).extend(clear)


def enter(op: str) -> None:
    """Called first in a worker: when another operator ran there before, its caches go and the memory is given back."""
    global _holder
    if _holder not in ("", op):
        for clear in _forget.get(_holder, ()):
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _holder = op


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; inlined into a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(frames: Iterator[pd.DataFrame], column: str = "text", most: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Splits Arrow batches so that each part has at most about `most` characters (one text may have more)."""
    for frame in frames:
        if len(frame):
            part = frame[column].str.len().fillna(0).cumsum() // most
            for _, x in frame.groupby(part.to_numpy(), sort=True):
                yield x


def texts(frame: pd.DataFrame, column: str = "text") -> list[str]:
    """Null counts as empty."""
    return ["" if x is None or x != x else x for x in frame[column].tolist()]
