"""Session defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; other settings are the cluster's own."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


#: Rows up to which a table in few files is dealt over the cores.
SPREAD_ROWS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt over them, as one row group is one task; any other
    is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.count() <= SPREAD_ROWS else df
