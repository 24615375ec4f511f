"""Run generation from a stream: each micro-batch becomes a sorted run, merged when wanted.

Sorting itself stays bounded: a stream has no last row, so only its runs so far have a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sort import merge_runs, order_columns, project
from ..spec import SortSpec


def write_runs(stream: DataFrame, spec: SortSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that stores each micro-batch as a sorted run under ``path/run=N``.

    A batch that is retried overwrites its own run, so each row is in exactly one.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = project(batch, spec)
        rows.sortWithinPartitions(*order_columns(rows, spec)).write.mode("overwrite").parquet(f"{path}/run={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, spec: SortSpec) -> DataFrame:
    """All runs so far in total order."""
    return merge_runs(spark.read.parquet(path).withColumn("run", F.col("run").cast("int")).drop("run"), spec)
