"""Roots, agent identity, per-run rollups and the per-agent summary."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col, first_non_empty, non_empty, page_of
from spanquarry.operators.filters import is_human, is_root
from spanquarry.schemas import AUTO_SECURITY, RUN_KEY, THREATS


def detect_roots(spans: DataFrame) -> DataFrame:
    """Set ``is_root``: a span is a child only if its root is another persisted span.

    Orphans, whose root was never stored, stay roots.  The probe side is one row per
    id; a run holding a large share of all spans is split by the adaptive skew join.
    """
    ids = spans.select(F.col("trace_id").alias("_id")).distinct()
    child = (F.col("trace_id") != F.col("root_trace_id")) & F.col("_id").isNotNull()
    return (
        spans.join(ids, spans.root_trace_id == ids["_id"], "left")
        .withColumn("is_root", F.when(child, 0).otherwise(1)).drop("_id")
    )


def agent_key(function, name, node) -> Column:
    """First non-empty of function, name and graph node; empty when there is none."""
    return F.coalesce(first_non_empty(function, name, node), F.lit(""))


def agent_kind(function, name, node) -> Column:
    return (
        F.when(non_empty(function).isNotNull(), "function").when(non_empty(name).isNotNull(), "chain")
        .when(non_empty(node).isNotNull(), "langgraph_node").otherwise("")
    )


def backfill_agent_identity(spans: DataFrame, function="function", name="name", node="node") -> DataFrame:
    """Recompute the denormalised identity columns over a whole history (repeatable)."""
    return detect_roots(
        spans.withColumn("agent_key", agent_key(as_col(function), as_col(name), as_col(node)))
        .withColumn("agent_kind", agent_kind(as_col(function), as_col(name), as_col(node)))
    )


# Per-run rollups are kept as mergeable partial states: sums, counts, minima and
# maxima.  Averages are stored as (sum, count), so states from several batches, late
# ones included, merge to the same totals as one pass over the whole history.
STATE = {
    "run_cost": (F.sum, "decimal(28,10)"), "run_tokens": (F.sum, "bigint"), "span_count": (F.sum, "bigint"),
    "quality_min": (F.min, "double"), "quality_sum": (F.sum, "double"), "quality_count": (F.sum, "bigint"),
    "risk_score_max": (F.max, "double"), "should_block_max": (F.max, "int"), "detections": (F.sum, "bigint"),
}


def merge_states(states: DataFrame, keys=RUN_KEY) -> DataFrame:
    have = [c for c in STATE if c in states.columns]
    merged = states.groupBy(*keys).agg(
        *[STATE[c][0](c).alias(c) for c in have],
        *([F.max("updated_at").alias("updated_at")] if "updated_at" in states.columns else []),
    )
    return merged.withColumns({c: F.col(c).cast(STATE[c][1]) for c in have})


def cost_states(costs: DataFrame) -> DataFrame:
    return costs.select(
        *RUN_KEY, F.col("total_cost").alias("run_cost"),
        (F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens")).alias("run_tokens"),
        F.col("ingested_at").alias("updated_at"),
    )


def quality_states(evals: DataFrame) -> DataFrame:
    """Automated quality only: security and human scores are reported elsewhere."""
    keep = (F.col("evaluator") != AUTO_SECURITY) & ~is_human()
    return evals.filter(keep).select(
        *RUN_KEY, F.col("score").alias("quality_min"), F.col("score").alias("quality_sum"),
        F.lit(1).cast("bigint").alias("quality_count"), F.col("ingested_at").alias("updated_at"),
    )


def detections(scans: DataFrame) -> Column:
    flags = [F.coalesce(F.col(f"{t}_detected").cast("bigint"), F.lit(0)) for t in THREATS
             if f"{t}_detected" in scans.columns]
    return reduce(lambda a, b: a + b, flags)


def security_states(scans: DataFrame) -> DataFrame:
    return scans.select(
        *RUN_KEY, F.col("security_risk_score").alias("risk_score_max"),
        F.col("should_block").alias("should_block_max"), detections(scans).alias("detections"),
        F.col("ingested_at").alias("updated_at"),
    )


def span_states(traces: DataFrame) -> DataFrame:
    return traces.select(*RUN_KEY, F.lit(1).cast("bigint").alias("span_count"), F.col("ingested_at").alias("updated_at"))


def rollup_cost(costs: DataFrame) -> DataFrame:
    return merge_states(cost_states(costs))


def rollup_quality(evals: DataFrame) -> DataFrame:
    return merge_states(quality_states(evals))


def rollup_security(scans: DataFrame) -> DataFrame:
    return merge_states(security_states(scans))


def rollup_spans(traces: DataFrame) -> DataFrame:
    return merge_states(span_states(traces))


def run_states(traces: DataFrame, costs: DataFrame, evals: DataFrame, scans: DataFrame) -> DataFrame:
    """The four kinds of state of every run, side by side in one frame."""
    parts = [cost_states(costs), quality_states(evals), security_states(scans), span_states(traces)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rollup_record(states: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Totals per run with zero / null defaults: one shuffle instead of three outer joins.

    ``states`` may be raw states or any mix of stored rollups; ``roots`` restricts the
    result to the given runs.
    """
    if roots is not None:
        states = states.join(roots.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")
    m = merge_states(states)
    return m.select(
        *RUN_KEY, F.coalesce(F.col("run_cost").cast("double"), F.lit(0.0)).alias("run_cost"),
        F.coalesce("run_tokens", F.lit(0)).alias("run_tokens"), F.coalesce("span_count", F.lit(0)).alias("span_count"),
        "quality_min", (F.col("quality_sum") / F.col("quality_count")).alias("quality_avg"),
        F.coalesce("quality_count", F.lit(0)).alias("quality_count"),
        F.coalesce("risk_score_max", F.lit(0.0)).alias("security_risk_max"),
        (F.coalesce("should_block_max", F.lit(0)) == 1).alias("security_should_block"),
        F.coalesce("detections", F.lit(0)).alias("security_detections"),
    )


def run_costs(costs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Cost of each run with its currency."""
    if roots is not None:
        costs = costs.join(roots.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")
    return costs.groupBy(*RUN_KEY).agg(
        F.sum("total_cost").alias("cost"), F.coalesce(F.min("currency"), F.lit("USD")).alias("currency")
    )


def runs_with_cost(traces: DataFrame, cost_rollup: DataFrame) -> DataFrame:
    """Agent roots with the cost of their run; joined by root id so orphans count too."""
    roots = traces.filter(is_root() & (F.col("agent_key") != "")).select(
        *RUN_KEY, "trace_id", "agent_key", "agent_kind", "integration", "latency", "ingested_at")
    return roots.join(cost_rollup.select(*RUN_KEY, "run_cost", "run_tokens"), RUN_KEY, "left").withColumns({
        "run_cost": F.coalesce("run_cost", F.lit(0).cast("decimal(28,10)")),
        "run_tokens": F.coalesce("run_tokens", F.lit(0)),
    })


def agent_summary(traces: DataFrame, cost_rollup: DataFrame) -> DataFrame:
    """Runs, cost, tokens, latency and last run per agent."""
    return runs_with_cost(traces, cost_rollup).groupBy(
        "organization_id", "agent_key", "agent_kind", F.coalesce("integration", F.lit("")).alias("integration")
    ).agg(
        F.count("*").alias("runs"), F.sum("run_cost").cast("double").alias("total_cost"),
        (F.sum("run_cost").cast("double") / F.count("*")).alias("avg_cost_per_run"),
        F.sum("run_tokens").alias("total_tokens"),
        F.avg(F.when(F.col("latency") > 0, F.col("latency"))).alias("avg_latency"),
        F.max("ingested_at").alias("last_run"),
    )


def agent_page(summary: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.col("last_run").desc_nulls_last(), F.col("organization_id"), F.col("agent_key"),
             F.col("agent_kind"), F.col("integration")]
    return page_of(summary, order, limit, offset)
