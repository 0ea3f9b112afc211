"""Spend, traffic and score series over time, usage counts and quotas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import avg_where, count_where, lookup, moment, page_of, trailing
from spanquarry.functions.quantiles import exact_percentiles
from spanquarry.operators.filters import failed, is_human
from spanquarry.schemas import HUMAN_FEEDBACK, TRACE_KEY

# Fixed values: (window in hours, bucket in minutes); longer windows use days.
BUCKETS = [(1, 5), (6, 15), (24, 30), (72, 60), (168, 240), (720, 1440)]
DAY_MINUTES = 1440
# Price-sheet provider (lower case) to chart column.
SPEND_COLUMNS = ["openai", "anthropic", "google", "other"]
# Monthly allowances and retention days per plan; -1 is unlimited.
UNLIMITED = -1
TRACE_QUOTA = {"Free": -1, "Starter": -1, "Team": -1, "Growth": -1, "Enterprise": -1}
EVAL_QUOTA = {"Free": 100, "Starter": 2000, "Team": 10000, "Growth": 50000, "Enterprise": -1}
SCAN_QUOTA = {"Free": 1000, "Starter": 50000, "Team": 500000, "Growth": 2000000, "Enterprise": -1}
RETENTION_DAYS = {"Free": 14, "Starter": 36500, "Team": 36500, "Growth": 36500, "Enterprise": 36500}
KEEP_FOREVER_DAYS = 36500
DEFAULT_TIER = "Free"

BY = ["organization_id", "bucket"]


def bucket_minutes(hours: int) -> int:
    """Bucket length for a window, so that a chart has a readable number of points."""
    return next((size for window, size in BUCKETS if hours <= window), DAY_MINUTES)


def _bucketed(df: DataFrame, as_of, hours: int, minutes: int | None) -> DataFrame:
    size = minutes or bucket_minutes(hours)
    recent = df.filter(trailing("ingested_at", as_of, hours=hours))
    return recent.withColumn("bucket", F.window("ingested_at", f"{size} minutes")["start"])


def spend_by_day(costs: DataFrame, traces: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Cost per day of the *trace* and provider; the window prunes both scans' columns."""
    recent = traces.filter(trailing("ingested_at", as_of, days=days)).select(
        *TRACE_KEY, F.to_date("ingested_at").alias("day"))
    return (
        costs.select(*TRACE_KEY, "provider", "total_cost").join(recent, TRACE_KEY)
        .groupBy("organization_id", "day", "provider").agg(F.sum("total_cost").alias("cost"))
    )


def spend_pivot(by_day: DataFrame) -> DataFrame:
    """One row per day: a column per well-known provider, the rest, and the total."""
    p = F.lower(F.coalesce("provider", F.lit("")))
    bucket = F.when(p.isin(SPEND_COLUMNS[:-1]), p).otherwise("other")
    cost = F.col("cost").cast("double")
    return by_day.withColumn("_b", bucket).groupBy("organization_id", "day").agg(
        *[F.coalesce(F.sum(F.when(F.col("_b") == b, cost)), F.lit(0.0)).alias(b) for b in SPEND_COLUMNS],
        F.sum(cost).alias("all"),
    )


def monitor_traffic(traces: DataFrame, as_of, hours: int, minutes: int | None = None, model: str | None = None,
                    percentiles: str = "exact") -> DataFrame:
    """Spans, runs, errors and latency percentiles per bucket.

    ``percentiles="approx"`` keeps everything in one aggregation with sketches of
    bounded size; the default is exact and equally safe for a bucket of any size.
    """
    rows = traces if not model else traces.filter(F.col("model") == model)
    rows = _bucketed(rows, as_of, hours, minutes)
    counts = [
        F.count("*").alias("spans"), count_where(F.col("is_root") == 1).alias("runs"),
        count_where(failed(F.lit(""), "success")).alias("errors"),
    ]
    if percentiles == "approx":
        p = F.percentile_approx("latency", [0.5, 0.95], 10000)
        return rows.groupBy(*BY).agg(*counts, p[0].alias("p50"), p[1].alias("p95"))
    ranks = exact_percentiles(rows, BY, "latency", {"p50": 0.5, "p95": 0.95})
    return rows.groupBy(*BY).agg(*counts).join(ranks, BY, "left")


def monitor_spend(costs: DataFrame, as_of, hours: int, minutes: int | None = None) -> DataFrame:
    return _bucketed(costs, as_of, hours, minutes).groupBy(*BY).agg(
        F.sum("total_cost").alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.sum("cached_input_tokens").alias("cached_tokens"),
    )


def monitor_scores(evals: DataFrame, as_of, hours: int, minutes: int | None = None,
                   exclude_security: bool = False) -> DataFrame:
    """Judge and end-user scores per bucket; human rows never enter the judge average."""
    judge = ~is_human()
    if exclude_security:
        judge = judge & (F.col("evaluator") != "auto.security")
    feedback = F.col("evaluator") == HUMAN_FEEDBACK
    return _bucketed(evals, as_of, hours, minutes).groupBy(*BY).agg(
        avg_where("score", judge).alias("judge_score"), count_where(judge).alias("judged"),
        avg_where("score", feedback).alias("feedback_score"), count_where(feedback).alias("feedback_count"),
    )


def _weighted(value: str, n: str) -> Column:
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.coalesce(F.col(n), F.lit(0)))
    return total / F.nullif(F.sum(n), F.lit(0))


def monitor_totals(traffic: DataFrame, spend: DataFrame, scores: DataFrame) -> DataFrame:
    """Headline numbers of the window: the worst bucket's p95, count-weighted scores."""
    org = "organization_id"
    a = traffic.groupBy(org).agg(F.sum("spans").alias("spans"), F.sum("runs").alias("runs"),
                                 F.sum("errors").alias("errors"), F.max("p95").alias("worst_p95"))
    b = spend.groupBy(org).agg(F.sum("cost").cast("double").alias("cost"), F.sum("tokens").alias("tokens"))
    c = scores.groupBy(org).agg(
        _weighted("judge_score", "judged").alias("judge_score"), F.sum("judged").alias("judged"),
        _weighted("feedback_score", "feedback_count").alias("feedback_score"),
        F.sum("feedback_count").alias("feedback_count"),
    )
    zero = {k: 0 for k in ("spans", "runs", "errors", "cost", "tokens", "judged", "feedback_count")}
    return a.join(b, org, "full_outer").join(c, org, "full_outer").fillna(zero)


def model_breakdown(costs: DataFrame, as_of, hours: int) -> DataFrame:
    return costs.filter(trailing("ingested_at", as_of, hours=hours) & (F.col("model") != "")).groupBy(
        "organization_id", "model", "provider"
    ).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
          F.sum("total_cost").alias("cost"))


def top_models(breakdown: DataFrame, limit: int) -> DataFrame:
    return page_of(breakdown, [F.col("cost").desc_nulls_last(), F.col("organization_id"), F.col("model"),
                               F.col("provider")], limit)


def tag_counts(live_tags: DataFrame, limit: int) -> DataFrame:
    n = live_tags.groupBy("organization_id", "tag").agg(F.count("*").alias("n"))
    return page_of(n, [F.col("n").desc(), F.col("organization_id"), F.col("tag")], limit)


def _this_month(as_of) -> Column:
    return (F.col("ingested_at") >= F.date_trunc("month", moment(as_of))) & (F.col("ingested_at") <= moment(as_of))


def month_usage(df: DataFrame, as_of, name: str) -> DataFrame:
    """Rows of each organization from the start of ``as_of``'s calendar month to ``as_of``."""
    return df.filter(_this_month(as_of)).groupBy("organization_id").agg(F.count("*").alias(name))


def usage(traces: DataFrame, evals: DataFrame, scans: DataFrame, as_of) -> DataFrame:
    """The three monthly counts of every organization, in one aggregation."""
    parts = [d.filter(_this_month(as_of)).select("organization_id", F.lit(n).alias("kind"))
             for n, d in (("traces", traces), ("evals", evals), ("scans", scans))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("organization_id").agg(
        *[count_where(F.col("kind") == k).alias(f"{k}_used") for k in ("traces", "evals", "scans")])


def _limit(table: dict[str, int], tier: Column) -> Column:
    return lookup({k: str(v) for k, v in table.items()}, tier, F.lit(str(table[DEFAULT_TIER]))).cast("bigint")


def retention_days(tier: Column) -> Column:
    """Days to keep raw rows; an unknown plan keeps the short window."""
    return _limit(RETENTION_DAYS, tier).cast("int")


def quota_status(tiers: DataFrame, used: DataFrame) -> DataFrame:
    """Limits (null when unlimited), use and over flags; ``eval_bonus`` shifts the cap, floored at 0."""
    tier = F.coalesce("tier", F.lit(DEFAULT_TIER))
    eval_cap = _limit(EVAL_QUOTA, tier)
    bonus = F.coalesce("eval_bonus", F.lit(0))
    caps = {
        "traces": _limit(TRACE_QUOTA, tier),
        "evals": F.when(eval_cap == UNLIMITED, eval_cap).otherwise(F.greatest(F.lit(0).cast("bigint"), eval_cap + bonus)),
        "scans": _limit(SCAN_QUOTA, tier),
    }
    rows = tiers.join(used, "organization_id", "left")
    keep = retention_days(tier)
    out = [F.col("organization_id"), tier.alias("tier")]
    for k, cap in caps.items():
        n = F.coalesce(f"{k}_used", F.lit(0))
        out += [n.alias(f"{k}_used"), F.when(cap != UNLIMITED, cap).alias(f"{k}_limit"),
                ((cap != UNLIMITED) & (n >= cap)).alias(f"{k}_over")]
    return rows.select(*out, F.when(keep < KEEP_FOREVER_DAYS, keep).alias("retention_days"))


def judge_usage(evals: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Judge tokens per evaluator; a message's totals sit on one of its rows, so sums are exact."""
    return evals.filter(trailing("ingested_at", as_of, days=days)).groupBy("organization_id", "evaluator").agg(
        F.sum("judge_input_tokens").alias("input_tokens"), F.sum("judge_output_tokens").alias("output_tokens"),
        F.sum("judge_calls").alias("judge_calls"), F.count_distinct("trace_id").alias("eval_runs"),
    )


def judge_usage_total(by_evaluator: DataFrame) -> DataFrame:
    """Totals over evaluators (a run judged by two evaluators counts twice)."""
    cols = ["input_tokens", "output_tokens", "judge_calls", "eval_runs"]
    return by_evaluator.groupBy("organization_id").agg(*[F.sum(c).alias(c) for c in cols])


def run_judge_usage(evals: DataFrame, items: DataFrame, run="run_id") -> DataFrame:
    """Judge spend of evaluation runs, summed over their items' trace ids."""
    ids = items.select(run, "trace_id").distinct()
    return evals.join(ids, "trace_id").groupBy(run).agg(
        F.sum("judge_calls").alias("judge_calls"), F.sum("judge_input_tokens").alias("input_tokens"),
        F.sum("judge_output_tokens").alias("output_tokens"))
