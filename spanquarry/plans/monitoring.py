"""Spend, traffic and score series, usage and quotas."""
from pyspark.sql import functions as F

from spanquarry.operators import monitor as M, versioned as V
from spanquarry.plans.registry import query
from spanquarry.plans.traces import LIVE_TAGS
from spanquarry.schemas import TRACE_KEY

# The windows reach back over the whole tables.
AT_TRACES, AT_EVENTS = "2001-12-01 00:00:00", "2024-01-31 00:00:00"
ALL_HOURS = 24 * 3000
DAILY = M.bucket_minutes(720)


def _round(df, n=6, **cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c in cols})


BY_DAY = """SELECT c.organization_id, CAST(t.ingested_at AS DATE) AS day, provider, sum(total_cost) AS cost
FROM v_costs c JOIN v_traces t ON t.organization_id = c.organization_id AND t.trace_id = c.trace_id GROUP BY 1, 2, 3"""


def _by_day(lake):
    return M.spend_by_day(lake.costs, lake.traces, AT_TRACES, 3000)


@query("d05_spend_by_day", f"SELECT organization_id, day, provider, round(CAST(cost AS DOUBLE), 6) AS cost FROM ({BY_DAY}) d")
def _(lake):
    return _round(_by_day(lake), cost=1)


@query("c03_spend_inner_join", f"SELECT organization_id, count(*) AS days, round(CAST(sum(cost) AS DOUBLE), 4) AS cost FROM ({BY_DAY}) d GROUP BY 1")
def _(lake):
    return _round(_by_day(lake).groupBy("organization_id").agg(F.count("*").alias("days"), F.sum("cost").alias("cost")), 4, cost=1)


@query("d06_spend_pivot", f"""SELECT organization_id, day,
  round(coalesce(sum(CAST(cost AS DOUBLE)) FILTER (WHERE lower(provider) = 'openai'), 0), 6) AS openai,
  round(coalesce(sum(CAST(cost AS DOUBLE)) FILTER (WHERE lower(provider) = 'anthropic'), 0), 6) AS anthropic,
  round(coalesce(sum(CAST(cost AS DOUBLE)) FILTER (WHERE lower(provider) = 'google'), 0), 6) AS google,
  round(coalesce(sum(CAST(cost AS DOUBLE)) FILTER (WHERE lower(provider) NOT IN ('openai', 'anthropic', 'google')), 0), 6) AS other,
  round(sum(CAST(cost AS DOUBLE)), 6) AS "all" FROM ({BY_DAY}) d GROUP BY 1, 2""")
def _(lake):
    return _round(M.spend_pivot(_by_day(lake)), openai=1, anthropic=1, google=1, other=1, all=1)


def _traffic_sql(where="true"):
    return f"""SELECT organization_id, time_bucket(INTERVAL 1 DAY, ingested_at) AS bucket, count(*) AS spans,
  count(*) FILTER (WHERE is_root = 1) AS runs, round(quantile_cont(latency, 0.5), 6) AS p50,
  round(quantile_cont(latency, 0.95), 6) AS p95, count(*) FILTER (WHERE success = false) AS errors
FROM v_traces WHERE {where} GROUP BY 1, 2"""


def _traffic(lake, **kw):
    return M.monitor_traffic(lake.traces, AT_TRACES, ALL_HOURS, DAILY, **kw)


@query("d07_monitor_traffic", _traffic_sql())
def _(lake):
    return _round(_traffic(lake), p50=1, p95=1)


@query("b14_model_filter", _traffic_sql("model = 'model-3'"))
def _(lake):
    return _round(_traffic(lake, model="model-3"), p50=1, p95=1)


@query("h07_quantiles", """SELECT agent_kind, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95
FROM v_traces WHERE latency IS NOT NULL GROUP BY 1""")
def _(lake):
    from spanquarry.functions.quantiles import exact_percentiles
    return _round(exact_percentiles(lake.traces, ["agent_kind"], "latency", {"p50": 0.5, "p95": 0.95}), p50=1, p95=1)


SPEND = """SELECT organization_id, time_bucket(INTERVAL 1 DAY, ingested_at) AS bucket, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_tokens
FROM v_costs GROUP BY 1, 2"""


def _spend(lake):
    return M.monitor_spend(lake.costs, AT_TRACES, ALL_HOURS, DAILY)


@query("d08_monitor_spend", SPEND)
def _(lake):
    return _round(_spend(lake), cost=1)


def _scores_sql(width, digits):
    return f"""SELECT organization_id, time_bucket(INTERVAL {width}, ingested_at) AS bucket,
  round(avg(score) FILTER (WHERE evaluator NOT LIKE 'human.%'), {digits}) AS judge_score, count(*) FILTER (WHERE evaluator NOT LIKE 'human.%') AS judged,
  round(avg(score) FILTER (WHERE evaluator = 'human.feedback'), {digits}) AS feedback_score, count(*) FILTER (WHERE evaluator = 'human.feedback') AS feedback_count
FROM v_evals GROUP BY 1, 2"""


@query("d09_monitor_scores", _scores_sql("4 HOUR", 6))
def _(lake):
    return _round(M.monitor_scores(lake.evals, AT_EVENTS, 720, M.bucket_minutes(168)), judge_score=1, feedback_score=1)


@query("d11_monitor_totals", f"""WITH t AS ({_traffic_sql()}), s AS ({SPEND}), e AS ({_scores_sql("1 DAY", 12)}),
ta AS (SELECT organization_id, sum(spans) AS spans, sum(runs) AS runs, sum(errors) AS errors, max(p95) AS worst_p95 FROM t GROUP BY 1),
sa AS (SELECT organization_id, sum(cost) AS cost, sum(tokens) AS tokens FROM s GROUP BY 1),
ea AS (SELECT organization_id, sum(coalesce(judge_score, 0) * judged) / nullif(sum(judged), 0) AS judge_score, sum(judged) AS judged,
  sum(coalesce(feedback_score, 0) * feedback_count) / nullif(sum(feedback_count), 0) AS feedback_score, sum(feedback_count) AS feedback_count FROM e GROUP BY 1)
SELECT organization_id, CAST(spans AS BIGINT) AS spans, CAST(runs AS BIGINT) AS runs, CAST(errors AS BIGINT) AS errors, worst_p95,
  round(cost, 4) AS cost, CAST(tokens AS BIGINT) AS tokens, round(judge_score, 6) AS judge_score, CAST(judged AS BIGINT) AS judged,
  round(feedback_score, 6) AS feedback_score, CAST(feedback_count AS BIGINT) AS feedback_count
FROM ta FULL JOIN sa USING (organization_id) FULL JOIN ea USING (organization_id)""")
def _(lake):
    scores = M.monitor_scores(lake.evals, AT_EVENTS, 720, DAILY)
    totals = M.monitor_totals(_traffic(lake), _spend(lake), scores)
    return _round(_round(totals, judge_score=1, feedback_score=1, worst_p95=1), 4, cost=1)


@query("d12_bucket_minutes", """SELECT event_id, CASE WHEN event_id % 1000 <= 1 THEN 5 WHEN event_id % 1000 <= 6 THEN 15 WHEN event_id % 1000 <= 24 THEN 30
  WHEN event_id % 1000 <= 72 THEN 60 WHEN event_id % 1000 <= 168 THEN 240 ELSE 1440 END AS minutes FROM events""")
def _(lake):
    hours, case = F.col("event_id") % 1000, None
    for window, size in M.BUCKETS:
        case = F.when(hours <= window, size) if case is None else case.when(hours <= window, size)
    return lake.raw("events").select("event_id", case.otherwise(M.DAY_MINUTES).alias("minutes"))


@query("d13_model_breakdown", """SELECT organization_id, model, provider, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
  round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost FROM v_costs WHERE model <> '' GROUP BY 1, 2, 3
ORDER BY sum(total_cost) DESC, organization_id, model, provider LIMIT 8""")
def _(lake):
    return _round(M.top_models(M.model_breakdown(lake.costs, AT_TRACES, ALL_HOURS), 8), cost=1)


@query("d14_tag_counts", f"SELECT organization_id, tag, count(*) AS n FROM ({LIVE_TAGS}) t GROUP BY 1, 2 ORDER BY n DESC, organization_id, tag LIMIT 100")
def _(lake):
    return M.tag_counts(V.latest(lake.tag_log, [*TRACE_KEY, "tag"], "updated_at", ["event_id"], "deleted"), 100)


@query("d01_month_usage", """SELECT organization_id, count(*) AS evaluations FROM v_evals
WHERE ingested_at >= date_trunc('month', TIMESTAMP '2024-01-20 12:00:00') AND ingested_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""")
def _(lake):
    return M.month_usage(lake.evals, "2024-01-20 12:00:00", "evaluations")


@query("d02_quota_status", """WITH u AS (SELECT organization_id, count(*) AS n FROM v_evals WHERE ingested_at >= TIMESTAMP '2024-01-01 00:00:00' AND ingested_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
o AS (SELECT DISTINCT organization_id FROM v_traces),
t AS (SELECT organization_id, CASE organization_id WHEN 'org0' THEN 'Free' WHEN 'org1' THEN 'Starter' WHEN 'org2' THEN 'Enterprise' WHEN 'org3' THEN 'Unknown' END AS tier,
  CASE organization_id WHEN 'org0' THEN 150 WHEN 'org3' THEN -500 ELSE 0 END AS bonus FROM o)
SELECT organization_id, coalesce(tier, 'Free') AS tier, CAST(0 AS BIGINT) AS traces_used, CAST(NULL AS BIGINT) AS traces_limit, false AS traces_over,
  coalesce(n, 0) AS evals_used,
  CASE tier WHEN 'Starter' THEN 2000 + bonus WHEN 'Enterprise' THEN NULL ELSE greatest(0, 100 + bonus) END AS evals_limit,
  CASE tier WHEN 'Starter' THEN coalesce(n, 0) >= 2000 + bonus WHEN 'Enterprise' THEN false ELSE coalesce(n, 0) >= greatest(0, 100 + bonus) END AS evals_over,
  coalesce(n, 0) AS scans_used, CASE tier WHEN 'Starter' THEN 50000 WHEN 'Enterprise' THEN NULL ELSE 1000 END AS scans_limit,
  CASE tier WHEN 'Starter' THEN coalesce(n, 0) >= 50000 WHEN 'Enterprise' THEN false ELSE coalesce(n, 0) >= 1000 END AS scans_over,
  CASE WHEN tier IN ('Starter', 'Enterprise') THEN NULL ELSE 14 END AS retention_days
FROM t LEFT JOIN u USING (organization_id)""")
def _(lake):
    from spanquarry.functions.common import lookup
    org = F.col("organization_id")
    tiers = lake.traces.select("organization_id").distinct().select(
        org, lookup({"org0": "Free", "org1": "Starter", "org2": "Enterprise", "org3": "Unknown"}, org).alias("tier"),
        F.when(org == "org0", 150).when(org == "org3", -500).otherwise(0).alias("eval_bonus"))
    return M.quota_status(tiers, M.usage(lake.traces, lake.evals, lake.scans, "2024-01-20 00:00:00"))


JUDGE = """SELECT organization_id, evaluator, CAST(sum(judge_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(judge_output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(judge_calls) AS BIGINT) AS judge_calls, count(DISTINCT trace_id) AS eval_runs FROM v_evals GROUP BY 1, 2"""


@query("d03_judge_usage", JUDGE)
def _(lake):
    return M.judge_usage(lake.evals, AT_EVENTS, 30)


@query("d03_judge_usage_total", f"""SELECT organization_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(judge_calls) AS BIGINT) AS judge_calls, CAST(sum(eval_runs) AS BIGINT) AS eval_runs FROM ({JUDGE}) j GROUP BY 1""")
def _(lake):
    return M.judge_usage_total(M.judge_usage(lake.evals, AT_EVENTS, 30))


@query("d04_run_judge_usage", """WITH i AS (SELECT DISTINCT o_orderstatus AS run_id, concat('r', o_orderkey) AS trace_id FROM orders)
SELECT run_id, CAST(sum(judge_calls) AS BIGINT) AS judge_calls, CAST(sum(judge_input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(judge_output_tokens) AS BIGINT) AS output_tokens FROM v_evals JOIN i USING (trace_id) GROUP BY 1""")
def _(lake):
    items = lake.raw("orders").select(F.col("o_orderstatus").alias("run_id"), F.concat(F.lit("r"), "o_orderkey").alias("trace_id"))
    return M.run_judge_usage(lake.evals, items)
