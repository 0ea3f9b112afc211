"""Alerts on scores and scans, and their digests (batch form)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanquarry.functions.scalars import normalize_metric
from spanquarry.functions.shared import cut

# Fixed values.
RATE_WINDOW = 30
RATE_MINIMUM = 10
COOLDOWN_SECONDS = 600
FLAG_CATEGORIES = {
    "injection_detected": "prompt_injection", "jailbreak_detected": "jailbreak",
    "secrets_detected": "secrets_detected", "indirect_injection_detected": "indirect_injection",
}
DIGEST_WINDOWS = {"hourly": "1 hour", "daily": "1 day"}
# Rows per piece when a long sequence is cut up.
PIECE = 100_000


def watched_evals(evals: DataFrame, settings: DataFrame) -> DataFrame:
    """Scores of organizations that alert on them, with the settings and a ``failed`` flag.

    A joined settings row decides: an empty metric list watches all metrics.
    """
    on = settings.filter(F.col("eval_enabled") & F.col("webhook").isNotNull()).select(
        "organization_id", "digest", "eval_metrics", "eval_score_below", "eval_failure_rate_above")
    rows = evals.filter(F.col("metric").isNotNull() & F.col("score").isNotNull()).withColumn("metric", normalize_metric("metric"))
    rows = rows.join(on, "organization_id")
    watched = (F.size("eval_metrics") == 0) | F.array_contains("eval_metrics", F.col("metric"))
    passed = F.col("passed") if "passed" in evals.columns else F.lit(None).cast("boolean")
    return rows.filter(watched).withColumn("failed", F.coalesce(~passed, F.col("score") < F.col("eval_score_below"))).drop("eval_metrics")


def eval_alerts(watched: DataFrame) -> DataFrame:
    """Scores below their organization's threshold."""
    summary = F.format_string("Eval `%s` scored %.2f (< %.2f)", "metric", "score", "eval_score_below")
    return watched.filter(F.col("score") < F.col("eval_score_below")).withColumns({"kind": F.lit("eval"), "summary": summary})


def positions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, bucket: str = "hour") -> DataFrame:
    """Adds ``pos``, the row's place in its key's order, without sorting a key in one task.

    Rows are counted per key and time bucket, the counts are summed over the buckets,
    and only the rows of one bucket are ranked together.
    """
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(ts, tie))
    return rows.withColumn("_i", inside).join(counts, [*keys, "_bucket"]).withColumn(
        "pos", F.col("_before") + F.col("_i") - 1).drop("_bucket", "_i", "_before")


def failure_rate(watched: DataFrame, ts: str = "ingested_at", tie: str = "event_id", piece: int = PIECE) -> DataFrame:
    """Share of failures among the last 30 outcomes at every score of an (organization, metric).

    A long sequence is cut into pieces that overlap by the 29 rows a window looks back,
    so one busy metric spreads over many tasks and the result is the same.
    """
    keys = ["organization_id", "metric"]
    back = RATE_WINDOW - 1
    rows = positions(watched, keys, ts, tie).withColumn("_piece", F.floor(F.col("pos") / piece))
    tail = F.col("pos") % piece >= piece - back
    rows = rows.withColumn("_in", F.explode(F.when(tail, F.array("_piece", F.col("_piece") + 1)).otherwise(F.array("_piece"))))
    w = Window.partitionBy(*keys, "_in").orderBy("pos").rowsBetween(-back, 0)
    n, f = F.count("*").over(w), F.sum(F.col("failed").cast("int")).over(w)
    out = rows.withColumns({"samples": n, "failure_rate": f * 100 / n}).filter(F.col("_in") == F.col("_piece"))
    return out.drop("_piece", "_in", "pos")


def rate_breaches(rates: DataFrame) -> DataFrame:
    return rates.filter((F.col("samples") >= RATE_MINIMUM) & (F.col("failure_rate") > F.col("eval_failure_rate_above")))


def with_cooldown(alerts: DataFrame, keys: Sequence[str], ts: str = "ingested_at", seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """At most one alert per key in any ``seconds``: keys and the times that fire.

    The first alert of a key fires, then always the first one at least ``seconds`` after
    the last that fired.  An alert that long after the one before it fires in any case,
    so a key falls apart into pieces at such gaps.  Within a piece every alert has a
    successor, the one that would fire next; it lies in the next clock bucket of
    ``seconds`` or is the first of the one after.  What the pieces' first alerts reach
    is found by successor doubling: log2(longest chain) rounds of equi-joins on key and
    time, so one hot key spreads over all tasks and no key is read in order by one.
    """
    keys, gap = list(keys), round(seconds * 1_000_000)
    time = F.unix_micros(F.col(ts).cast("timestamp"))
    each = cut(alerts.select(*keys, ts).distinct().withColumns({"_k": F.to_json(F.struct(*keys)), "_t": time}).withColumn(
        "_b", F.expr(f"(_t - pmod(_t, {gap}L)) div {gap}L")))
    ends = each.groupBy("_k", "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    before = ends.select("_k", (F.col("_b") + 1).alias("_b"), F.col("_last").alias("_gone"))
    heads = ends.join(before, ["_k", "_b"], "left").filter(F.col("_gone").isNull() | (F.col("_first") - F.col("_gone") >= gap))

    nothing = F.lit(None).cast("long")
    seen = each.select("_k", "_b", F.col("_t").alias("_at"), F.col("_t").alias("_alert"), nothing.alias("_from"))
    asked = each.select("_k", F.col("_b") + 1, F.col("_t") + gap, nothing, "_t")
    late = Window.partitionBy("_k", "_b").orderBy(F.desc("_at"), F.col("_from").asc_nulls_first())  # an alert before who asks for its time
    found = seen.unionAll(asked).withColumn("_inside", F.last("_alert", ignorenulls=True).over(late)).filter(F.col("_from").isNotNull())
    after = ends.select("_k", (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_after"))
    step = found.join(after, ["_k", "_b"], "left").select("_k", F.col("_from").alias("_t"), F.coalesce("_inside", "_after").alias("_next"))

    step, fired = cut(step.filter(F.col("_next").isNotNull())), cut(heads.select("_k", F.col("_first").alias("_t")))
    while not step.isEmpty():
        fired = cut(fired.unionAll(fired.join(step, ["_k", "_t"]).select("_k", "_next")).distinct())
        step = cut(step.join(step.toDF("_k", "_next", "_then"), ["_k", "_next"]).select("_k", "_t", F.col("_then").alias("_next")))
    return each.join(fired, ["_k", "_t"], "left_semi").select(*keys, ts)


def categories(columns: Sequence[str]) -> Column:
    """Alert categories of a scan row from its flags and personal-data lists."""
    found = [F.when(F.col(c) == 1, name) for c, name in FLAG_CATEGORIES.items() if c in columns]
    pii = [F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 for c in ("pii_entities_prompt", "pii_entities_response") if c in columns]
    if pii:
        found.append(F.when(pii[0] if len(pii) == 1 else pii[0] | pii[1], "pii_detected"))
    return F.array_compact(F.array(*found))


def security_alerts(scans: DataFrame, settings: DataFrame) -> DataFrame:
    """Scans that pass the blocked-only, risk-level and category filters of their organization."""
    on = settings.filter(F.col("security_enabled") & F.col("webhook").isNotNull()).select(
        "organization_id", "digest", "security_alert_on", "security_categories", "security_blocked_only")
    level = F.coalesce(F.nullif("security_risk_level", F.lit("")), F.lit("clean"))
    block = F.coalesce("should_block", F.lit(0)) == 1
    rows = scans.withColumns({"risk_level": level, "_block": block, "categories": categories(scans.columns)}).join(on, "organization_id")
    keep = (
        (~F.col("security_blocked_only") | F.col("_block")) & F.array_contains("security_alert_on", F.col("risk_level"))
        & ((F.size("security_categories") == 0) | F.arrays_overlap("security_categories", "categories"))
    )
    verb = F.when(F.col("_block"), "blocked").otherwise("flagged")
    names = F.coalesce(F.nullif(F.array_join("categories", ", "), F.lit("")), F.lit("unknown"))
    return rows.filter(keep).withColumns({
        "kind": F.lit("security"), "summary": F.concat(F.lit("Security "), verb, F.lit(": "), "risk_level", F.lit(" ("), names, F.lit(")")),
    }).drop("_block", "security_alert_on", "security_categories", "security_blocked_only")


def alert_digest(alerts: DataFrame, digest: str, ts: str = "ingested_at", tie: Sequence[str] = ("summary",), *, most: int) -> DataFrame:
    """Alerts per organization and clock-aligned window: the first ``most`` lines and how many more (a top-k report)."""
    rows = alerts.filter(F.col("digest") == digest).withColumn("window_start", F.window(ts, DIGEST_WINDOWS[digest])["start"])
    keys = ["organization_id", "window_start"]
    total = rows.groupBy(*keys).agg(F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *tie))
    kept = rows.withColumn("_n", rank).filter(F.col("_n") <= most)
    lines = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "summary"))).alias("_l"))
    return total.join(lines, keys).select(
        *keys, "events", F.transform("_l", lambda x: x.summary).alias("lines"),
        F.greatest(F.col("events") - most, F.lit(0)).alias("more"))


def running_traces(events: DataFrame, as_of, ttl_seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Runs started and not finished at ``as_of`` (batch form of the streaming registry)."""
    from spanquarry.functions.common import moment
    from spanquarry.operators.versioned import latest

    seen = events.filter((F.col("ts") <= moment(as_of)) & F.col("kind").isin("started", "persisted", "enriched"))
    tie = [c for c in ("event_id",) if c in events.columns]
    now = latest(seen, ["organization_id", "trace_id"], "ts", tie).filter(F.col("kind") == "started")
    return now.filter(F.col("ts") >= moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
