"""The filtered, sorted, paged list of traces with cost, scores and security verdict."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import broadcast_page, page_of, scoped
from spanquarry.operators import filters as P
from spanquarry.operators.versioned import latest
from spanquarry.schemas import RUN_KEY, TRACE_KEY


@dataclass(frozen=True)
class TraceQuery:
    org: str | None = None
    api_key_prefix: str | None = None
    root_trace_id: str | None = None
    roots_only: bool = False
    agent_key: str | None = None
    agent_kind: str | None = None
    status: str = "all"
    integration: str = "all"
    security: str = "all"
    quality: str = "all"
    tags: tuple[str, ...] = field(default_factory=tuple)
    sort: str = "newest"
    limit: int = 100
    offset: int = 0


def order_of(sort: str) -> list[Column]:
    """Requested order, made total by the trace key; missing values always last."""
    first = {
        "oldest": F.col("ingested_at").asc_nulls_last(),
        "latency_desc": F.col("latency").desc_nulls_last(),
        "latency_asc": F.col("latency").asc_nulls_last(),
        "cost_desc": F.col("total_cost").desc_nulls_last(),
        "cost_asc": F.col("total_cost").asc_nulls_last(),
    }.get(sort, F.col("ingested_at").desc_nulls_last())
    return [first, F.col("organization_id").asc(), F.col("trace_id").asc()]


def cost_per_trace(costs: DataFrame) -> DataFrame:
    return costs.groupBy(*TRACE_KEY).agg(
        F.sum("total_cost").alias("total_cost"), F.min("currency").alias("currency")
    )


def scores_per_trace(evals: DataFrame) -> DataFrame:
    return evals.groupBy(*TRACE_KEY).agg(
        F.count("*").alias("n_evaluations"), F.min("score").alias("min_score")
    )


def scan_per_trace(scans: DataFrame) -> DataFrame:
    """Newest scan of each trace, security columns only."""
    tie = [c for c in ("event_id",) if c in scans.columns]
    drop = [c for c in ("root_trace_id", "api_key_prefix", "ingested_at", "retention_days", *tie) if c in scans.columns]
    return latest(scans, TRACE_KEY, "ingested_at", tie).drop(*drop)


def evaluation_entries(evals: DataFrame, keys=TRACE_KEY) -> DataFrame:
    """Scores of each trace as an array, one entry per (metric, evaluator).

    Repeated scores of one metric are folded first, so the array is as long as the
    number of distinct metrics, however often a trace was scored.  The single score
    rows are available in long form from ``page_evaluations``.
    """
    folded = evals.groupBy(*keys, "metric", "evaluator").agg(
        F.avg("score").alias("score"), F.count("*").alias("n")
    )
    return folded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("metric", "evaluator", "score", "n"))).alias("evaluations")
    )


def base_rows(q: TraceQuery, traces: DataFrame, scans: DataFrame, costs: DataFrame,
              tag_log: DataFrame | None) -> DataFrame:
    """Everything that can be decided before the joins."""
    rows = traces
    if q.api_key_prefix is not None:
        rows = rows.filter(F.col("api_key_prefix") == q.api_key_prefix)
    if q.root_trace_id is not None:
        rows = rows.filter(F.col("root_trace_id") == q.root_trace_id)
    if q.integration != "all":
        rows = rows.filter(F.coalesce("integration", F.lit("")) == q.integration)
    if q.roots_only:
        rows = rows.filter(P.is_root())
    if q.agent_key is not None:
        rows = P.by_agent(rows, q.agent_key, q.agent_kind, costs)
    rows = P.by_status(rows, q.status, traces, q.roots_only or q.agent_key is not None)
    if q.tags:
        rows = P.with_tags(rows, tag_log, q.tags)
    if q.security == "flagged":
        rows = rows.join(P.flagged_runs(traces, scans), RUN_KEY, "left_semi")
    return rows


def list_traces(q: TraceQuery, traces: DataFrame, costs: DataFrame, evals: DataFrame,
                scans: DataFrame, tag_log: DataFrame | None = None) -> DataFrame:
    """One page of the list.

    When order and filters only need trace columns, the page of keys is chosen first
    from those columns, and it is small enough to broadcast: the wide columns of the
    traces, the costs, the scores and the scans are then read for the page's keys
    only.  Otherwise the right sides are aggregated per trace and joined before the
    top-k.
    """
    traces, costs, evals, scans = (scoped(d, q.org) for d in (traces, costs, evals, scans))
    tag_log = None if tag_log is None else scoped(tag_log, q.org)
    rows = base_rows(q, traces, scans, costs, tag_log)
    order = order_of(q.sort)
    post_join = q.security in ("clean", *P.RISKY) or q.quality != "all"
    if not post_join and q.sort not in ("cost_desc", "cost_asc"):
        keys = broadcast_page(page_of(rows, order, q.limit, q.offset).select(*TRACE_KEY), q.limit)
        narrow = lambda d: d.join(keys, TRACE_KEY, "left_semi")
        return page_of(_attach(narrow(traces), narrow(costs), narrow(evals), narrow(scans)), order, q.limit)
    rows = _attach(rows, costs, evals, scans)
    if q.security in ("clean", *P.RISKY):
        rows = rows.filter(P.security_is(q.security))
    if q.quality != "all":
        rows = rows.filter(P.quality_band() == q.quality)
    return page_of(rows, order, q.limit, q.offset)


def _attach(rows: DataFrame, costs: DataFrame, evals: DataFrame, scans: DataFrame) -> DataFrame:
    return (
        rows.join(cost_per_trace(costs), TRACE_KEY, "left")
        .join(scores_per_trace(evals), TRACE_KEY, "left")
        .join(scan_per_trace(scans), TRACE_KEY, "left")
        .withColumn("n_evaluations", F.coalesce("n_evaluations", F.lit(0).cast("bigint")))
    )


def page_evaluations(page: DataFrame, evals: DataFrame, limit: int) -> DataFrame:
    """Score rows of a page's traces, in long form."""
    keys = broadcast_page(page.select(*TRACE_KEY), limit)
    return evals.join(keys, TRACE_KEY, "left_semi")


def page_tags(page: DataFrame, tag_log: DataFrame, limit: int) -> DataFrame:
    """Live tags of a page's traces."""
    keys = broadcast_page(page.select(*TRACE_KEY), limit)
    tie = [c for c in ("event_id",) if c in tag_log.columns]
    live = latest(tag_log.join(keys, TRACE_KEY, "left_semi"), [*TRACE_KEY, "tag"], "updated_at", tie, "deleted")
    return live.groupBy(*TRACE_KEY).agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def trace_record(rows: DataFrame, evals: DataFrame) -> DataFrame:
    """Display record: cost, folded evaluations, and a security struct when scanned."""
    taken = {*TRACE_KEY, "total_cost", "currency", "n_evaluations", "min_score"}
    security = [c for c in rows.columns if c.endswith("_detected") or c in
                ("security_risk_level", "security_risk_score", "should_block")]
    scanned = F.coalesce(F.col("security_risk_level"), F.lit("")) != ""
    bools = {"should_block"} | {c for c in security if c.endswith("_detected")}
    fields = [(F.col(c) == 1).alias(c) if c in bools else F.col(c) for c in security]
    return rows.join(evaluation_entries(evals), TRACE_KEY, "left").select(
        *TRACE_KEY, *[c for c in rows.columns if c not in taken and c not in security],
        F.col("total_cost").cast("double").alias("cost"), F.nullif("currency", F.lit("")).alias("currency"),
        F.coalesce("evaluations", F.array().cast("array<struct<metric:string,evaluator:string,score:double,n:bigint>>"))
        .alias("evaluations"),
        F.when(scanned, F.struct(*fields)).alias("security"),
    )


def with_running(page: DataFrame, running: DataFrame, *, offset: int, status: str = "all",
                 roots_only: bool = False) -> DataFrame:
    """In-flight rows not yet persisted, ahead of the first page (``in_flight`` sorts them).

    A page has at most ``MAX_PAGE`` rows, so the anti-join broadcasts it.
    """
    page = page.withColumn("in_flight", F.lit(False))
    if offset or status not in ("all", "running"):
        return page
    if roots_only:
        root = F.col("root_trace_id")
        running = running.filter(root.isNull() | (root == "") | (root == F.col("trace_id")))
    fresh = running.join(F.broadcast(page.select(*TRACE_KEY)), TRACE_KEY, "left_anti")
    return fresh.withColumn("in_flight", F.lit(True)).unionByName(page, allowMissingColumns=True)
