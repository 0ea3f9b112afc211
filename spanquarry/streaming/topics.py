"""Topics of JSON messages keyed by organization, and checkpointed queries over them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

LIVE_NAMES = {"enriched": "trace.enriched", "started": "trace.started"}


def read_topic(spark: SparkSession, schema: T.StructType, *, servers: str | None = None, topic: str | None = None,
               path: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Stream of parsed messages from a broker, or from JSON files when ``path`` is given."""
    if path is not None:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("failOnDataLoss", "true").load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def as_messages(df: DataFrame) -> DataFrame:
    """Key and value columns of a topic: the organization is the key, so its order is kept."""
    return df.select(F.col("organization_id").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (as_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def run_once(df: DataFrame, checkpoint: str, sink, mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop.  One query and checkpoint per sink: each message is handled once."""
    return (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_batches(folder: str):
    """``foreachBatch`` writer of an append log; a repeated batch replaces its own directory."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    return write


def enriched(stream: DataFrame, enrichment: str | None = None) -> DataFrame:
    """Enriched messages of a known organization, optionally of one type."""
    rows = stream.filter((F.col("kind") == "enriched") & (F.coalesce("organization_id", F.lit("")) != ""))
    return rows if enrichment is None else rows.filter(F.col("enrichment") == enrichment)


def live_feed(stream: DataFrame, org: str, api_key_prefix: str | None = None) -> DataFrame:
    """One organization's messages with the name of the update they stand for."""
    rows = stream.filter(F.col("organization_id") == org)
    if api_key_prefix is not None:
        rows = rows.filter(F.col("api_key_prefix") == api_key_prefix)
    name = F.when(F.col("kind") == "enriched", LIVE_NAMES["enriched"]).when(F.col("kind") == "started", LIVE_NAMES["started"]).otherwise("trace")
    return rows.withColumn("event_name", name)
