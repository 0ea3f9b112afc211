"""Rows to append, retention, layout and maintenance of the stored tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col, moment, strip
from spanquarry.functions.ids import hmac_sha256
from spanquarry.operators.monitor import KEEP_FOREVER_DAYS, retention_days
from spanquarry.schemas import AUTO_EVAL, HUMAN_ANNOTATION

# Fixed values.
FEEDBACK_NAME = r"^[a-z][a-z0-9_\-]{0,63}$"
DEFAULT_FEEDBACK = "user_feedback"
AUDIT_YEARS = 10
AUDIT_EVENTS = [
    ("POST", "/auth/login", "auth_login"), ("POST", "/auth/register", "auth_register"), ("POST", "/auth/logout", "auth_logout"),
    ("POST", "/auth/refresh", "auth_refresh"), ("POST", "/api-keys", "api_key_created"), ("DELETE", "/api-keys", "api_key_deleted"),
    ("POST", "/api/v1/secure", "security_check"), ("POST", "/api/v1/evaluate", "eval_run"), ("POST", "/api/v1/trace", "llm_call"),
    ("POST", "/admin", "admin_action"), ("DELETE", "/admin", "admin_action"),
]


def evaluation_rows(results: DataFrame, judge_model: str) -> DataFrame:
    """One score row per metric of a ``results`` map (metric to score); the root defaults to the trace."""
    root = F.col("root_trace_id") if "root_trace_id" in results.columns else F.lit(None).cast("string")
    return results.select("organization_id", "trace_id", F.coalesce(root, "trace_id").alias("root_trace_id"),
                          F.explode("results").alias("metric", "score")).withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "evaluator": F.lit(AUTO_EVAL), "judge_model": F.lit(judge_model)})


def human_score_rows(df: DataFrame, evaluator: str = HUMAN_ANNOTATION) -> DataFrame:
    """One score row per human signal (columns trace_id, metric, score, details)."""
    return df.select("organization_id", "trace_id", F.coalesce("root_trace_id", "trace_id").alias("root_trace_id"),
                     F.lit(evaluator).alias("evaluator"), "metric", F.col("score").cast("double").alias("score"),
                     F.lit("").alias("judge_model"), "details")


def coerce_feedback(df: DataFrame, most: int | None = None) -> DataFrame:
    """Feedback as scores: true / false to 1 / 0, numbers clamped, names checked, comments whole or cut at ``most``."""
    raw = F.lower(strip(F.col("value").cast("string")))
    number = raw.try_cast("double")
    score = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    name = F.lower(strip(F.coalesce(F.nullif("name", F.lit("")), F.lit(DEFAULT_FEEDBACK))))
    whole = strip("comment")
    comment = F.nullif(whole if most is None else F.substring(whole, 1, most), F.lit(""))
    return df.withColumns({
        "score": F.when(number.isNull() & ~raw.isin("true", "false"), None).otherwise(score), "name": name, "comment": comment,
        "valid": name.rlike(FEEDBACK_NAME) & (raw.isin("true", "false") | number.isNotNull())})


def audit_event_type(method, path) -> Column:
    """Class of a request; the first matching method and path prefix decides."""
    m, p, out = as_col(method), as_col(path), None
    for verb, prefix, name in AUDIT_EVENTS:
        cond = (m == verb) & p.startswith(prefix)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("api_request")


def audit_rows(df: DataFrame, secret: str) -> DataFrame:
    """Audit rows with their class and a keyed hash that shows later changes."""
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    typed = df.withColumn("event_type", audit_event_type("http_method", "http_path"))
    message = F.concat_ws("|", "event_id", "organization_id", "event_type", "actor", stamp)
    return typed.withColumn("row_hash", hmac_sha256(message, secret))


def tag_rows(df: DataFrame, now: Column, source: str = "dashboard", deleted: int = 0) -> DataFrame:
    """Log rows that set (or, as tombstones, remove) the tags of traces (array column ``tags``)."""
    return df.select("organization_id", "trace_id", F.coalesce("root_trace_id", "trace_id").alias("root_trace_id"), F.explode("tags").alias("tag"),
                     F.lit(source).alias("source"), F.lit(deleted).alias("deleted"), now.alias("updated_at"))


def flag_rows(df: DataFrame, now: Column, status: str, actor: str, reason: str = "manual", note: str = "") -> DataFrame:
    """Log rows that open or resolve review flags."""
    return df.select(
        "organization_id", "trace_id", F.coalesce("root_trace_id", "trace_id").alias("root_trace_id"), F.lit(status).alias("status"),
        F.lit(reason).alias("reason"), F.lit(note).alias("note"), F.lit(actor if status == "open" else "").alias("flagged_by"),
        F.lit(actor if status == "resolved" else "").alias("resolved_by"), now.alias("updated_at"))


def stamp_retention(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """``retention_days`` from the organization's plan; an unknown plan keeps the short window."""
    t = tiers.select("organization_id", F.col("tier").alias("_tier"))
    return df.join(t, "organization_id", "left").withColumn("retention_days", retention_days(F.coalesce("_tier", F.lit("")))).drop("_tier")


def expire(df: DataFrame, as_of) -> DataFrame:
    """Rows still inside their own window; rows without a stamp are kept."""
    days = F.coalesce(F.col("retention_days"), F.lit(KEEP_FOREVER_DAYS))
    return df.filter(F.col("ingested_at") + F.make_dt_interval(days) > moment(as_of))


def expire_audit(df: DataFrame, as_of) -> DataFrame:
    return df.filter(F.col("created_at") + F.make_ym_interval(F.lit(AUDIT_YEARS)) > moment(as_of))


def write_monthly(df: DataFrame, path: str, ts: str = "ingested_at", mode: str = "append") -> None:
    """Month directories, each file sorted by organization and time so that scans skip row groups."""
    rows = df.withColumn("month", F.date_format(ts, "yyyyMM"))
    # Rows of one month spread over the tasks by time of day, so that no month is one task.
    spread = rows.repartition("month", F.pmod(F.xxhash64(F.date_trunc("hour", F.col(ts))), F.lit(64)))
    spread.sortWithinPartitions("month", "organization_id", ts).write.mode(mode).partitionBy("month").parquet(path)


def erase_org(df: DataFrame, org: str) -> DataFrame:
    """A table without one organization (to be written to a new location)."""
    return df.filter(~F.coalesce(F.col("organization_id") == org, F.lit(False)))


def plan_resource_push(existing: DataFrame, pushed: DataFrame) -> DataFrame:
    """What a push of declared resources does: created, updated, error or kept; nothing is deleted.

    Both sides have (organization_id, resource, key, kind); keys match without case.
    """
    norm = F.lower(strip("key"))
    old = existing.select("organization_id", "resource", norm.alias("_k"), F.col("kind").alias("_kind"), F.lit(True).alias("_old"))
    new = pushed.withColumn("_k", norm).withColumn("_new", F.lit(True))
    both = new.join(old, ["organization_id", "resource", "_k"], "full_outer")
    action = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created")
        .when(F.coalesce(F.col("_kind"), F.lit("")) != F.coalesce(F.col("kind"), F.lit("")), "error").otherwise("updated")
    )
    return both.select("organization_id", "resource", F.col("_k").alias("key"), F.coalesce("kind", "_kind").alias("kind"), action.alias("action"))
