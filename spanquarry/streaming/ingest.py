"""Native events: normalising, routing to the persist / score / scan sinks, idempotent writes.

All functions are stateless projections, so they run the same over a batch and a stream.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.ids import coerce_trace_id
from spanquarry.functions.scalars import normalize_tags
from spanquarry.operators.agents import agent_key, agent_kind
from spanquarry.operators.filters import is_retrieval
from spanquarry.operators.rules import select_rule

# Control keys a producer may put on an event.
CONTROL_KEYS = ["_eval_config", "_security_config", "_eval", "_tags", "_metadata"]
METADATA_KEY = "user_metadata"
ROUTES = ["traces", "evaluate", "secure"]


def normalize_events(raw: DataFrame, event: str = "event") -> DataFrame:
    """Typed columns of raw event JSON (with ``organization_id``, ``api_key_prefix``).

    Ids become UUIDs, control keys leave the event, scalar user metadata stays on it
    under one key, and the fields that queries filter on are promoted to columns.
    """
    e = F.try_parse_json(event)
    rows = raw.withColumn("_e", e)
    v = F.col("_e")
    text = lambda p: F.try_variant_get(v, p, "string")
    sub = lambda p: F.try_variant_get(v, p, "variant")
    own = F.coalesce(coerce_trace_id(text("$.trace_id")), coerce_trace_id(F.sha2(F.col(event), 256)))
    given_tags = F.coalesce(F.try_variant_get(v, "$._tags", "array<string>"), F.array(text("$._tags")))
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    meta = F.try_variant_get(v, "$._metadata", "map<string,variant>")
    scalar = F.map_filter(meta, lambda _, x: F.schema_of_variant(x).rlike("^(STRING|BIGINT|DOUBLE|BOOLEAN|DECIMAL.*|FLOAT)$"))
    kept = F.map_filter(fields, lambda k, _: ~k.isin([*CONTROL_KEYS, METADATA_KEY]))
    doc = F.when(F.size(scalar) > 0, F.map_concat(kept, F.create_map(F.lit(METADATA_KEY), F.try_parse_json(F.to_json(scalar))))).otherwise(kept)
    config = sub("$._eval_config")
    return rows.withColumn("trace_id", own).select(
        "organization_id", "api_key_prefix", "trace_id",
        F.coalesce(coerce_trace_id(text("$.root_trace_id")), "trace_id").alias("root_trace_id"),
        coerce_trace_id(text("$.parent_id")).alias("parent_id"), F.to_json(doc).alias("event"),
        text("$.type").alias("type"), text("$.api").alias("api"), text("$.integration").alias("integration"), text("$.model").alias("model"),
        text("$.status").alias("status"), F.try_variant_get(v, "$.success", "boolean").alias("success"),
        F.try_variant_get(v, "$.latency", "double").alias("latency"),
        agent_key(text("$.function"), text("$.name"), text("$.langgraph.langgraph_node")).alias("agent_key"),
        agent_kind(text("$.function"), text("$.name"), text("$.langgraph.langgraph_node")).alias("agent_kind"),
        F.to_json(config).alias("eval_config"), F.to_json(sub("$._security_config")).alias("security_config"),
        (F.coalesce(F.try_variant_get(v, "$._eval", "boolean"), F.lit(False)) | config.isNotNull()).alias("eval_enabled"),
        normalize_tags(F.array_compact(given_tags)).alias("tags"),
        *[c for c in raw.columns if c not in ("organization_id", "api_key_prefix", event)],
    )


def _not_running() -> Column:
    return F.coalesce("status", F.lit("")) != "running"


def scored_inline() -> Column:
    """Scored because the caller asked: retrieval by flag, model calls by their configuration."""
    asked = (F.col("type") == "llm") & F.col("eval_config").isNotNull()
    return _not_running() & F.col("eval_enabled") & (is_retrieval("type", "api") | F.coalesce(asked, F.lit(False)))


def route_events(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds ``routes`` (sinks of each event) and ``rule`` (the online rule that scores it).

    Every event is persisted; running events are never scored; ``eval_over`` (the
    organization's quota, absent means not over) stops scoring only.
    """
    over = F.coalesce(F.col("eval_over"), F.lit(False)) if "eval_over" in events.columns else F.lit(False)
    inline = scored_inline() & ~over
    rows = select_rule(events, rules) if rules is not None else events.withColumn("rule", F.lit(None).cast("struct<rule_id:string,name:string>"))
    rows = rows.withColumn("rule", F.when(_not_running() & ~inline & ~over, F.col("rule")))
    secure = _not_running() & F.col("security_config").isNotNull()
    routes = F.array_compact(F.array(
        F.lit("traces"), F.when(inline | F.col("rule").isNotNull(), "evaluate"), F.when(secure, "secure")))
    return rows.withColumns({"eval_skipped": F.col("eval_enabled") & _not_running() & over, "routes": routes})


def route_otlp(events: DataFrame, secure: bool = False) -> DataFrame:
    """Routes of converted spans: retrieval and model calls are scored, scanning is opt-in."""
    over = F.coalesce(F.col("eval_over"), F.lit(False)) if "eval_over" in events.columns else F.lit(False)
    scored = F.col("type").isin("vectorstore", "retrieval", "llm") & ~over
    routes = F.array(F.lit("traces"), F.when(scored, "evaluate"), F.when(~over & F.lit(secure), "secure"))
    return events.withColumn("routes", F.array_compact(routes))


def dedupe_stream(stream: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop replays of an event; state is kept for ``delay`` of event time only."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def write_routes(folder: str):
    """``foreachBatch`` writer: one directory per route and batch, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("*", F.explode("routes").alias("route")).drop("routes", "rule")
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("route", "batch_id").parquet(folder)

    return write
