"""Several sinks of one stream, written together: a batch counts once its commit record is there."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanquarry.operators.rules import scoring_jobs
from spanquarry.streaming.ingest import scored_inline

COMMITS = "commits"


def write_sinks(folder: str, sinks: Mapping[str, Callable[[DataFrame], DataFrame]]):
    """``foreachBatch`` writer of every sink's rows of a batch, then of a record that the batch is complete.

    Each sink has a directory per batch, which a repeated batch replaces as a whole, also
    by no rows.  Readers (:func:`read_sink`) follow the records, so they see all sinks of
    a batch or none, and every message once, whatever was repeated or broke off between.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, counts = batch.sparkSession, {}
        held = batch.persist()
        try:
            for name, rows_of in sinks.items():
                path = f"{folder}/{name}/batch_id={batch_id}"
                rows_of(held).write.mode("overwrite").parquet(path)
                counts[name] = spark.read.parquet(path).count()  # from the files' footers
        finally:
            held.unpersist()
        record = spark.createDataFrame([(batch_id, counts)], "batch bigint, counts map<string,bigint>")
        record.coalesce(1).write.mode("overwrite").json(f"{folder}/{COMMITS}/batch_id={batch_id}")

    return write


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, counts`` of the complete batches."""
    return spark.read.schema("batch bigint, counts map<string,bigint>").json(f"{folder}/{COMMITS}")


def read_sink(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a sink that belong to complete batches (one short record per batch is broadcast if Spark finds it small)."""
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    done = committed(spark, folder).select(F.col("batch").alias("batch_id"))
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(done, "batch_id", "left_semi").drop("batch_id")


def _trace_rows(batch: DataFrame) -> DataFrame:
    return batch.drop("routes", "rule", "eval_over")


def _requested_jobs(batch: DataFrame) -> DataFrame:
    """Scoring that the caller asked for: the event with its own configuration."""
    asked = batch.filter(F.array_contains("routes", "evaluate") & F.col("rule").isNull() & scored_inline())
    operation = F.when(F.col("eval_config").isNotNull() & (F.col("type") == "llm"), "score_call").otherwise("score_retrieval")
    return asked.select("organization_id", "api_key_prefix", "trace_id", "root_trace_id", "event", operation.alias("operation"), "eval_config")


def _rule_jobs(batch: DataFrame) -> DataFrame:
    """Scoring that an online rule ordered: rule, metrics and judges travel with the event."""
    return scoring_jobs(batch, "api_key_prefix", "root_trace_id", "event")


def _scan_jobs(batch: DataFrame) -> DataFrame:
    return batch.filter(F.array_contains("routes", "secure")).select(
        "organization_id", "api_key_prefix", "trace_id", "root_trace_id", "event", "security_config")


INGEST_SINKS = {"traces": _trace_rows, "requested_scores": _requested_jobs, "rule_scores": _rule_jobs, "scans": _scan_jobs}


def write_ingest(folder: str):
    """Routed events to the trace log, both kinds of scoring jobs and the scan jobs."""
    return write_sinks(folder, INGEST_SINKS)
