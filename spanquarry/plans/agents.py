"""Rollups per run and the per-agent summary."""
from pyspark.sql import functions as F

from spanquarry.operators import agents as A
from spanquarry.plans.registry import query
from spanquarry.schemas import RUN_KEY

ROLLUP_COST = """SELECT organization_id, root_trace_id, sum(total_cost) AS run_cost,
  sum(input_tokens + cached_input_tokens + output_tokens) AS run_tokens, max(ingested_at) AS updated_at
FROM v_costs GROUP BY ALL"""
AUTOMATED = "evaluator <> 'auto.security' AND evaluator NOT LIKE 'human.%'"


@query("d20_rollup_cost", f"""SELECT organization_id, root_trace_id, round(CAST(run_cost AS DOUBLE), 6) AS run_cost,
  CAST(run_tokens AS BIGINT) AS run_tokens, updated_at FROM ({ROLLUP_COST}) r""")
def _(lake):
    return A.rollup_cost(lake.costs).withColumn("run_cost", F.round(F.col("run_cost").cast("double"), 6))


@query("d21_rollup_quality", f"""SELECT organization_id, root_trace_id, min(score) AS quality_min,
  round(avg(score), 6) AS quality_avg, count(*) AS quality_count FROM v_evals WHERE {AUTOMATED} GROUP BY 1, 2""")
def _(lake):
    r = A.rollup_quality(lake.evals)
    return r.select(*RUN_KEY, "quality_min", F.round(F.col("quality_sum") / F.col("quality_count"), 6).alias("quality_avg"),
                    "quality_count")


SECURITY = """SELECT organization_id, root_trace_id, max(security_risk_score) AS risk_score_max, max(should_block) AS should_block_max,
  CAST(sum(injection_detected + jailbreak_detected + secrets_detected) AS BIGINT) AS detections FROM v_scans GROUP BY 1, 2"""


@query("d22_rollup_security", SECURITY)
def _(lake):
    return A.rollup_security(lake.scans).drop("updated_at")


@query("i06_detection_sums", SECURITY.replace("organization_id, root_trace_id, max(security_risk_score) AS risk_score_max, max(should_block) AS should_block_max,", "organization_id, trace_id,").replace("root_trace_id", "trace_id"))
def _(lake):
    return lake.scans.groupBy("organization_id", "trace_id").agg(F.sum(A.detections(lake.scans)).alias("detections"))


@query("d23_rollup_spans", "SELECT organization_id, root_trace_id, count(*) AS span_count FROM v_traces GROUP BY 1, 2")
def _(lake):
    return A.rollup_spans(lake.traces).drop("updated_at")


RECORD = f"""WITH c AS ({ROLLUP_COST}),
q AS (SELECT organization_id, root_trace_id, min(score) AS qmin, avg(score) AS qavg, count(*) AS qn FROM v_evals WHERE {AUTOMATED} GROUP BY ALL),
s AS ({SECURITY}), n AS (SELECT organization_id, root_trace_id, count(*) AS span_count FROM v_traces GROUP BY ALL)
SELECT organization_id, root_trace_id, round(coalesce(CAST(run_cost AS DOUBLE), 0), 6) AS run_cost,
  CAST(coalesce(run_tokens, 0) AS BIGINT) AS run_tokens, coalesce(span_count, 0) AS span_count, qmin AS quality_min,
  round(qavg, 6) AS quality_avg, coalesce(qn, 0) AS quality_count, coalesce(risk_score_max, 0.0) AS security_risk_max,
  coalesce(should_block_max, 0) = 1 AS security_should_block, coalesce(detections, 0) AS security_detections
FROM n FULL OUTER JOIN c USING (organization_id, root_trace_id) FULL OUTER JOIN q USING (organization_id, root_trace_id)
     FULL OUTER JOIN s USING (organization_id, root_trace_id)"""


def _record(df):
    return df.withColumns({"run_cost": F.round("run_cost", 6), "quality_avg": F.round("quality_avg", 6)})


@query("d24_run_rollups", RECORD)
def _(lake):
    return _record(A.rollup_record(A.run_states(lake.traces, lake.costs, lake.evals, lake.scans)))


@query("a30_rollup_backfill", RECORD)
def _(lake):
    # Stored rollups of two halves of the history merge to the same totals as one pass.
    from spanquarry.functions.common import moment
    early = lambda d, at: d.filter(F.col("ingested_at") < moment(at))
    late = lambda d, at: d.filter(F.col("ingested_at") >= moment(at))
    parts = [A.merge_states(A.run_states(*(cut(d, at) for d, at in (
        (lake.traces, "1998-01-01"), (lake.costs, "1998-01-01"), (lake.evals, "2024-01-15"), (lake.scans, "2024-01-15")))))
        for cut in (early, late)]
    return _record(A.rollup_record(parts[0].unionByName(parts[1])))


@query("d28_run_costs", """SELECT organization_id, root_trace_id, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost, min(currency) AS currency
FROM v_costs c WHERE EXISTS (SELECT 1 FROM v_scans s WHERE s.organization_id = c.organization_id AND s.root_trace_id = c.root_trace_id)
GROUP BY 1, 2""")
def _(lake):
    return A.run_costs(lake.costs, lake.scans).withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query("c05_runs_with_cost", f"""SELECT t.organization_id, t.trace_id, agent_key, round(coalesce(CAST(run_cost AS DOUBLE), 0), 6) AS run_cost,
  CAST(coalesce(run_tokens, 0) AS BIGINT) AS run_tokens
FROM v_traces t LEFT JOIN ({ROLLUP_COST}) c ON t.organization_id = c.organization_id AND t.root_trace_id = c.root_trace_id
WHERE (is_root = 1 OR trace_id = t.root_trace_id) AND agent_key <> ''""")
def _(lake):
    r = A.runs_with_cost(lake.traces, A.rollup_cost(lake.costs))
    return r.select("organization_id", "trace_id", "agent_key", F.round(F.col("run_cost").cast("double"), 6).alias("run_cost"), "run_tokens")


SUMMARY = f"""SELECT t.organization_id, agent_key, agent_kind, coalesce(integration, '') AS integration, count(*) AS runs,
  round(CAST(sum(coalesce(run_cost, 0)) AS DOUBLE), 4) AS total_cost,
  round(CAST(sum(coalesce(run_cost, 0)) AS DOUBLE) / count(*), 6) AS avg_cost_per_run,
  CAST(sum(coalesce(run_tokens, 0)) AS BIGINT) AS total_tokens,
  round(avg(latency) FILTER (WHERE latency > 0), 6) AS avg_latency, max(ingested_at) AS last_run
FROM v_traces t LEFT JOIN ({ROLLUP_COST}) c ON t.organization_id = c.organization_id AND t.root_trace_id = c.root_trace_id
WHERE (is_root = 1 OR trace_id = t.root_trace_id) AND agent_key <> '' GROUP BY 1, 2, 3, 4"""


def _summary(lake):
    return A.agent_summary(lake.traces, A.rollup_cost(lake.costs)).withColumns({
        "total_cost": F.round("total_cost", 4), "avg_cost_per_run": F.round("avg_cost_per_run", 6),
        "avg_latency": F.round("avg_latency", 6)})


@query("d10_agent_summary", SUMMARY)
def _(lake):
    return _summary(lake)


@query("d10_agent_page", f"""SELECT * FROM ({SUMMARY}) s
ORDER BY last_run DESC, organization_id, agent_key, agent_kind, integration LIMIT 50""")
def _(lake):
    return A.agent_page(_summary(lake), 50)


@query("h09_agent_identity", """SELECT doc_id, CASE WHEN f <> '' THEN f WHEN n <> '' THEN n ELSE node END AS agent_key,
  CASE WHEN f <> '' THEN 'function' WHEN n <> '' THEN 'chain' WHEN node <> '' THEN 'langgraph_node' ELSE '' END AS agent_kind
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS f, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS n,
             CASE WHEN doc_id % 5 = 0 THEN concat('node-', doc_id % 4) ELSE '' END AS node FROM documents) d""")
def _(lake):
    d = lake.raw("documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("f"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("n"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("node-"), F.col("doc_id") % 4)).otherwise("").alias("node"))
    cols = (F.col("f"), F.col("n"), F.col("node"))
    return d.select("doc_id", A.agent_key(*cols).alias("agent_key"), A.agent_kind(*cols).alias("agent_kind"))


@query("a29_backfill_identity", """SELECT t.organization_id, t.trace_id, agent_key, agent_kind,
  CASE WHEN t.trace_id <> t.root_trace_id AND p.trace_id IS NOT NULL THEN 0 ELSE 1 END AS is_root
FROM (SELECT organization_id, trace_id, root_trace_id, integration AS agent_key, 'function' AS agent_kind FROM v_traces) t
LEFT JOIN (SELECT DISTINCT trace_id FROM v_traces) p ON t.root_trace_id = p.trace_id""")
def _(lake):
    spans = lake.traces.select("organization_id", "trace_id", "root_trace_id", F.col("integration").alias("function"),
                               F.col("model").alias("name"), F.lit("").alias("node"))
    return A.backfill_agent_identity(spans).select("organization_id", "trace_id", "agent_key", "agent_kind", "is_root")
