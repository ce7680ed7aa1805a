"""Traces as a stream: hourly statistics, retention, and incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "trace_id long, ts timestamp, strategy string, success boolean, latency_ms double"


def hourly(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, strategy, n, errors, mean latency; of a stream, rows later than `late` are dropped with their hour closed."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "strategy").agg(F.count("*").alias("n"), F.count(F.when(~F.col("success"), 1)).alias("errors"), F.avg("latency_ms").alias("mean_latency_ms"))
    return out.select(F.col("w.start").alias("hour"), "strategy", "n", "errors", "mean_latency_ms")


def read_json_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines as a stream; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def split_late(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a time, and those without, which retention keeps forever."""
    return log.filter("ts is not null"), log.filter("ts is null")


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `each` on every batch of what is there now, then stops; the next call goes on from there."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest version of each key in a Parquet table, one folder a batch; rereading takes the last.

    Writing a batch again gives the same folder, so a retried batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return write


def newest(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/*")
    fields = [F.col(c) for c in rows.columns]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(version, "batch")).alias("r")).select("r.*")
