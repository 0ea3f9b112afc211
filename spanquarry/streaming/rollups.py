"""Incremental run rollups: each batch stores its partial states, reads merge them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanquarry.operators.agents import merge_states, rollup_record
from spanquarry.schemas import RUN_KEY


def store_states(folder: str):
    """``foreachBatch`` writer of the batch's partial states.

    Late and out-of-order spans need no watermark: their states merge like any other.
    A repeated batch replaces its own directory, so nothing is counted twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        merge_states(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    return write


def read_rollups(spark: SparkSession, folder: str, roots: DataFrame | None = None) -> DataFrame:
    return rollup_record(spark.read.parquet(folder).drop("batch_id"), roots)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Merge all stored batches into one state per run, in a new location."""
    merged = merge_states(spark.read.parquet(folder).drop("batch_id")).withColumn("batch_id", F.lit(-1))
    merged.sortWithinPartitions(*RUN_KEY).write.mode("errorifexists").partitionBy("batch_id").parquet(target)
