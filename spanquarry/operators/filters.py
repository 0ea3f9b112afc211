"""Predicates of the trace list and the small searches."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col, scoped
from spanquarry.operators.versioned import latest
from spanquarry.schemas import HUMAN_PREFIX, RUN_KEY, TRACE_KEY

# Query calls of a vector store that count as retrieval (fixed values).
RETRIEVAL_APIS = ["query", "search", "near_text", "near_vector", "hybrid", "bm25", "query_points", "fetch_objects"]
# Agent kinds that are stored on the span itself (fixed values).
STORED_KINDS = ["function", "chain", "langgraph_node"]
# Risk levels that put a run on the security list (fixed values).
RISKY = ["low", "medium", "high"]


def is_root(trace_id="trace_id", root="root_trace_id", flag="is_root") -> Column:
    return (as_col(flag) == 1) | (as_col(trace_id) == as_col(root))


def blocked(status="status") -> Column:
    return F.coalesce(as_col(status), F.lit("")) == "blocked"


def failed(status="status", success="success") -> Column:
    """Only an explicit ``false`` is a failure, and a block is not one."""
    return (~F.coalesce(as_col(success), F.lit(True))) & ~blocked(status)


def running(status="status") -> Column:
    return F.coalesce(as_col(status), F.lit("")) == "running"


def completed(status="status", success="success") -> Column:
    return ~running(status) & ~blocked(status) & F.coalesce(as_col(success), F.lit(True))


STATUS = {"running": running, "blocked": blocked, "failed": failed, "completed": completed}


def status_label() -> Column:
    """Each span falls under exactly one status."""
    return (
        F.when(running(), "running").when(blocked(), "blocked").when(failed(), "failed").otherwise("completed")
    )


def by_status(rows: DataFrame, status: str, traces: DataFrame, returning_roots: bool) -> DataFrame:
    """Status filter; for root lists a run matches when any of its spans is blocked / failed."""
    if status == "all":
        return rows
    if returning_roots and status in ("blocked", "failed"):
        hit = traces.filter(STATUS[status]()).select(*RUN_KEY).distinct()
        return rows.join(hit, RUN_KEY, "left_semi")
    return rows.filter(STATUS[status]())


def flagged_runs(traces: DataFrame, scans: DataFrame) -> DataFrame:
    """Runs with a blocked span or with any scan above clean."""
    return (
        traces.filter(blocked()).select(*RUN_KEY)
        .unionByName(scans.filter(F.col("security_risk_level").isin(RISKY)).select(*RUN_KEY))
        .distinct()
    )


def with_tags(rows: DataFrame, tag_log: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Traces that carry every one of ``tags`` now."""
    wanted = sorted(set(tags))
    live = latest(tag_log.filter(F.col("tag").isin(wanted)), [*TRACE_KEY, "tag"], "updated_at",
                  [c for c in ("event_id",) if c in tag_log.columns], "deleted")
    carrying = live.groupBy(*TRACE_KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted))
    return rows.join(carrying, TRACE_KEY, "left_semi")


def by_agent(rows: DataFrame, agent_key: str, agent_kind: str | None, costs: DataFrame | None = None) -> DataFrame:
    """Root spans of one agent; an ``llm`` agent is the ``provider:model`` of its cost row."""
    rows = rows.filter(is_root())
    if agent_kind == "llm":
        named = costs.filter(F.concat_ws(":", "provider", "model") == agent_key)
        return rows.join(named.select(*TRACE_KEY), TRACE_KEY, "left_semi")
    rows = rows.filter(F.col("agent_key") == agent_key)
    return rows.filter(F.col("agent_kind") == agent_kind) if agent_kind in STORED_KINDS else rows


def quality_band(n="n_evaluations", weakest="min_score") -> Column:
    return (
        F.when(F.coalesce(as_col(n), F.lit(0)) == 0, "none").when(as_col(weakest) < 0.5, "low")
        .when(as_col(weakest) < 0.8, "medium").otherwise("high")
    )


def security_is(level: str, col="security_risk_level") -> Column:
    c = F.coalesce(as_col(col), F.lit(""))
    return c == ("" if level == "clean" else level)


def is_human(evaluator="evaluator") -> Column:
    return as_col(evaluator).startswith(HUMAN_PREFIX)


def evaluator_class(evaluator="evaluator") -> Column:
    c = as_col(evaluator)
    return (
        F.when(c == "human.feedback", "feedback").when(c.startswith(HUMAN_PREFIX), "human")
        .when(c == "auto.security", "security").otherwise("judge")
    )


def is_retrieval(type_="type", api="api") -> Column:
    return F.coalesce((as_col(type_) == "vectorstore") & as_col(api).isin(RETRIEVAL_APIS), F.lit(False))


def has_tag(tags, tag) -> Column:
    return F.array_contains(as_col(tags), tag)


def search(df: DataFrame, text: str, cols: Sequence[str], **equal) -> DataFrame:
    """Case-insensitive "contains" over any of ``cols`` plus optional equalities."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if not text:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return df.filter(F.coalesce(hit, F.lit(False)))


def search_total(df: DataFrame, text: str, cols: Sequence[str], **equal) -> DataFrame:
    return search(df, text, cols, **equal).agg(F.count("*").alias("total"))


def audit_search(log: DataFrame, org: str | None = None, event_type: str | None = None,
                 actor: str | None = None) -> DataFrame:
    """Audit rows by organization, event type and actor (order and page by the caller)."""
    out = scoped(log, org)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    return out.filter(F.col("actor") == actor) if actor else out
