"""Evaluation runs: summaries, trials, gates, comparison of runs, composites, rankings."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import avg_where, count_where, page_of, trailing
from spanquarry.operators.versioned import latest
from spanquarry.schemas import AUTO_EVAL, RUN_LAYER, THREATS, TRACE_KEY

# Fixed values.
COMPARE_EPSILON = 0.05
DEFAULT_THRESHOLD = 0.7
STATUS_ORDER = ["regressed", "improved", "unchanged", "added", "pending"]


def run_items(items: DataFrame, examples: DataFrame) -> DataFrame:
    """Items with the input and expected output of their example."""
    return items.join(examples.select("example_id", "input", "expected_output"), "example_id", "left")


def with_child_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children; children are counted before the join."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def recent_evals(evals: DataFrame, traces: DataFrame, as_of, minutes: int) -> DataFrame:
    """Scores of traces that arrived in the window."""
    recent = traces.filter(trailing("ingested_at", as_of, minutes=minutes)).select(
        *TRACE_KEY, F.col("ingested_at").alias("trace_at"))
    return evals.join(recent, TRACE_KEY)


def recent_page(rows: DataFrame, limit: int = 200, tie: Sequence[str] = ()) -> DataFrame:
    order = [F.col("trace_at").desc(), *[F.col(c) for c in (*TRACE_KEY, "metric", *tie)]]
    return page_of(rows, order, limit)


def eval_gate(rows: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts a continuous-integration job decides on."""
    s = F.col("score")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), count_where(s >= threshold).alias("passed"),
        count_where(s < threshold).alias("failed"), F.round(F.avg(s), 4).alias("avg_score"))


def gated(scores: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Pass and failure of each score; ``error`` marks a judge that never answered.

    A missing threshold is the default one, zero never fails, and a judge error is
    reported but does not fail the answer.
    """
    rows = scores if thresholds is None else scores.join(thresholds.select("metric", "threshold"), "metric", "left")
    limit = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    passed = F.coalesce("error", F.lit(False)) | (F.col("score") >= limit)
    return rows.withColumns({"threshold": limit, "passed": passed, "failed": ~passed & (limit > 0)})


def threshold_gate(scores: DataFrame, thresholds: DataFrame | None = None, keys=TRACE_KEY) -> DataFrame:
    """A trace passes when none of its metrics failed."""
    per_metric = gated(scores, thresholds).groupBy(*keys, "metric").agg(F.bool_or("failed").alias("failed"))
    return per_metric.groupBy(*keys).agg(
        (~F.bool_or("failed")).alias("passed"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("metric")))).alias("failures"))


def _map_of(name: str, value: str) -> Column:
    entries = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(name).alias("key"), F.col(value).alias("value"))))
    return F.map_from_entries(F.array_sort(entries))


def _item_rows(evals: DataFrame, items: DataFrame) -> DataFrame:
    return evals.join(items.select("run_id", "trace_id").distinct(), "trace_id")


def _totals(items: DataFrame) -> DataFrame:
    return items.groupBy("run_id").agg(F.count("*").alias("total"))


def _averages(rows: DataFrame, name: str, out: str) -> DataFrame:
    """``{name: mean score}`` per run; as long as the number of metrics."""
    means = rows.groupBy("run_id", name).agg(F.round(F.avg("score"), 4).alias("_avg"))
    return means.groupBy("run_id").agg(_map_of(name, "_avg").alias(out))


def summarize_agentic(evals: DataFrame, items: DataFrame) -> DataFrame:
    """Run score, pass rate and per-layer / per-metric means of agentic runs."""
    rows = _item_rows(evals, items)
    run_row = (F.col("layer") == RUN_LAYER) & F.col("run_score").isNotNull()
    heads = rows.groupBy("run_id").agg(
        F.count_distinct("trace_id").alias("completed"),
        F.round(avg_where("run_score", run_row), 4).alias("avg_run_score"),
        F.round(avg_where(F.col("run_passed").cast("double"), run_row), 4).alias("pass_rate"))
    layered = F.coalesce("layer", F.lit("")) != ""
    layers = _averages(rows.filter(layered & F.col("score").isNotNull()), "layer", "layers")
    metrics = _averages(rows.filter(~layered & (F.col("evaluator") == AUTO_EVAL)), "metric", "metrics")
    return _totals(items).join(heads, "run_id", "left").join(layers, "run_id", "left").join(metrics, "run_id", "left")


def summarize_metrics(evals: DataFrame, items: DataFrame) -> DataFrame:
    """Mean of per-example means, and per-metric means."""
    rows = _item_rows(evals.filter((F.col("evaluator") == AUTO_EVAL) & F.col("score").isNotNull()), items)
    per_example = rows.groupBy("run_id", "trace_id").agg(F.avg("score").alias("_avg"))
    heads = per_example.groupBy("run_id").agg(
        F.count("*").alias("completed"), F.round(F.avg("_avg"), 4).alias("avg_score"))
    return _totals(items).join(heads, "run_id", "left").join(_averages(rows, "metric", "metrics"), "run_id", "left")


def summarize_security(scans: DataFrame, items: DataFrame) -> DataFrame:
    """Risk levels, flagged, blocked and threat counts, one scan per trace."""
    tie = [c for c in ("event_id",) if c in scans.columns]
    rows = _item_rows(latest(scans, ["trace_id"], "ingested_at", tie), items)
    flags = {t: F.coalesce(F.col(f"{t}_detected"), F.lit(0)) > 0 for t in THREATS if f"{t}_detected" in scans.columns}
    level = F.coalesce(F.nullif("security_risk_level", F.lit("")), F.lit("clean"))
    is_blocked = F.coalesce("should_block", F.lit(0)) == 1
    detected = F.lit(False)
    for f in flags.values():
        detected = detected | f
    heads = rows.groupBy("run_id").agg(
        F.count("*").alias("completed"),
        count_where(is_blocked | detected | level.isin("medium", "high")).alias("flagged"),
        count_where(is_blocked).alias("blocked"),
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(t) for t in flags]),
                                       F.array(*[count_where(f) for f in flags.values()])),
                     lambda _, n: n > 0).alias("threats"))
    by_level = rows.groupBy("run_id", level.alias("_level")).agg(F.count("*").alias("_n"))
    levels = by_level.groupBy("run_id").agg(_map_of("_level", "_n").alias("risk_levels"))
    return _totals(items).join(heads, "run_id", "left").join(levels, "run_id", "left")


def run_status(items: DataFrame, completed: DataFrame) -> DataFrame:
    """A run is complete once every item that produced an output has a result."""
    n = items.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count("gen_error").alias("gen_failed"),
        count_where(F.coalesce("generated", F.lit(True))).alias("generated"))
    done = F.coalesce("completed", F.lit(0))
    expected = F.col("total") - F.col("gen_failed")
    return n.join(completed.select("run_id", "completed"), "run_id", "left").select(
        "run_id", "total", "gen_failed", done.alias("completed"), expected.alias("expected"),
        F.when((F.col("generated") >= F.col("total")) & (done >= expected), "complete").otherwise("running").alias("status"))


def fold_trials(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Repeated trials of an example as one row: mean and spread per metric.

    ``items`` has a row per trial, ``scores`` a row per (trace_id, metric).  Cost adds
    up over trials, latency is averaged, and an example is done when all trials are.
    """
    keys = ["run_id", "example_id"]
    heads = items.groupBy(*keys).agg(
        F.count("*").alias("trials"), F.bool_and("done").alias("done"), F.avg("latency_ms").alias("latency_ms"),
        F.sum("cost_usd").alias("cost_usd"), F.min("trace_id").alias("first_trace_id"))
    rows = scores.select("trace_id", "metric", "score").join(items.select(*keys, "trace_id"), "trace_id")
    folded = rows.groupBy(*keys, "metric").agg(
        F.avg("score").alias("score"), (F.max("score") - F.min("score")).alias("spread"), F.count("score").alias("trials"))
    result = folded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("metric", "score", "spread", "trials"))).alias("result"))
    return heads.join(result, keys, "left")


def example_scores(rows: DataFrame, kind: str, keys=("run_id", "example_id")) -> DataFrame:
    """Overall score of each example, and per-metric scores as a map.

    Agentic: the run score, else the weakest layer.  Metrics: the mean metric.
    """
    if kind == "agentic":
        per = rows.filter((F.col("layer") != "") & F.col("score").isNotNull()).groupBy(*keys, F.col("layer").alias("metric")).agg(
            F.avg("score").alias("score"), F.max(F.when(F.col("layer") == RUN_LAYER, F.col("run_score"))).alias("_run"))
        overall = F.coalesce(F.max("_run"), F.min("score"))
    else:
        per = rows.filter((F.col("evaluator") == AUTO_EVAL) & F.col("score").isNotNull()).groupBy(*keys, "metric").agg(
            F.avg("score").alias("score"))
        overall = F.avg("score")
    return per.groupBy(*keys).agg(overall.alias("score"), _map_of("metric", "score").alias("scores"))


def compare_examples(run: DataFrame, baseline: DataFrame, key="example_id") -> DataFrame:
    """Per-example change against a baseline (columns ``example_id``, ``score`` on both sides).

    An example is ``added`` when the baseline lacks it, ``missing`` when the run lacks
    it, and ``pending`` when a side has no score yet.
    """
    a = run.select(key, F.col("score").alias("score"), F.lit(True).alias("_a"))
    b = baseline.select(key, F.col("score").alias("baseline_score"), F.lit(True).alias("_b"))
    # Ties are decided on the decimal value, not on the last bits of a difference of means.
    d = F.round(F.col("score") - F.col("baseline_score"), 9)
    status = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "missing")
        .when(d.isNull(), "pending").when(d < -COMPARE_EPSILON, "regressed")
        .when(d > COMPARE_EPSILON, "improved").otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(
        key, "score", "baseline_score", F.round(d, 4).alias("delta"), status.alias("status"))


def comparison_order(key="example_id") -> list[Column]:
    """Regressions first, the biggest drop on top."""
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(STATUS_ORDER)], F.lit(len(STATUS_ORDER)))
    return [rank.asc(), F.coalesce("delta", F.lit(0.0)).asc(), F.col(key).asc()]


def compare_metrics(run: DataFrame, baseline: DataFrame, key="example_id") -> DataFrame:
    """Per-metric means over examples both runs have, so a changed mix is no movement."""
    b = baseline.select(key, "metric", F.col("score").alias("_b"))
    return run.select(key, "metric", "score").join(b, [key, "metric"]).groupBy("metric").agg(
        F.round(F.avg("score"), 4).alias("avg"), F.round(F.avg("_b"), 4).alias("baseline_avg"),
        F.round(F.avg(F.col("score") - F.col("_b")), 4).alias("delta"))


def matrix(per_metric: DataFrame, runs: Sequence[str]) -> DataFrame:
    """A row per metric, a mean-score column per run."""
    return per_metric.groupBy("metric").agg(
        *[F.round(avg_where("score", F.col("run_id") == r), 4).alias(r) for r in runs])


def example_matrix(per_metric: DataFrame, runs: Sequence[str], metric: str | None = None) -> DataFrame:
    """A row per example, a score column per run, and the spread between runs.

    Without ``metric`` each run's overall score (the mean of its metrics) is shown.
    Rows: (run_id, example_id, metric, score).
    """
    rows = per_metric.filter(F.col("run_id").isin(list(runs)))
    if metric is not None:
        rows = rows.withColumn("score", F.when(F.col("metric") == metric, F.col("score")))
    table = rows.groupBy("example_id").agg(*[avg_where("score", F.col("run_id") == r).alias(r) for r in runs])
    present = F.array_compact(F.array(*[F.col(r) for r in runs]))
    spread = F.when(F.size(present) >= 2, F.round(F.array_max(present) - F.array_min(present), 4))
    return table.withColumn("spread", spread)


def widest_first() -> list[Column]:
    return [F.col("spread").desc_nulls_last(), F.col("example_id").asc()]


def run_overview(per_metric: DataFrame) -> DataFrame:
    """Mean overall score and number of scored examples per run."""
    overall = per_metric.groupBy("run_id", "example_id").agg(F.avg("score").alias("_o"))
    return overall.groupBy("run_id").agg(F.round(F.avg("_o"), 4).alias("overall"), F.count("_o").alias("completed"))


def composites(scores: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted composites over whatever was scored, with the names that were missing.

    ``components`` has (organization_id, slug, metric, weight); missing metrics are left
    out and the other weights renormalised; nothing scored gives null, not zero.
    """
    subjects = scores.select("organization_id", *keys).distinct()
    wanted = subjects.join(components, "organization_id")
    rows = wanted.join(scores.select("organization_id", *keys, "metric", "score"),
                       ["organization_id", *keys, "metric"], "left")
    has = F.col("score").isNotNull()
    weight = F.sum(F.when(has, F.col("weight")))
    return rows.groupBy("organization_id", *keys, "slug").agg(
        F.try_divide(F.sum(F.col("score") * F.col("weight")), weight).alias("value"),
        F.array_sort(F.collect_list(F.when(has, F.col("metric")))).alias("present"),
        F.array_sort(F.collect_list(F.when(~has, F.col("metric")))).alias("missing"),
        F.bool_and(has).alias("complete"))


def expand_trials(examples: DataFrame, trials: int, run_id: str, order: Sequence[Column],
                  cap: int | None = None) -> DataFrame:
    """Each example ``trials`` times with its own id; a ``cap`` bounds calls, so trials share it (by default none)."""
    n = max(1, int(trials))
    rows = examples if cap is None else page_of(examples, order, cap // n)
    ids = F.sha2(F.concat_ws(":", F.lit(run_id), F.col("example_id"), F.col("trial")), 256)
    return rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("trace_id", ids)


def pairwise(verdicts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Preference between two answers judged in both orders: a winner must win both.

    Rows: (prompt_id, first, second, pick) with pick ``A``, ``B`` or anything else for a tie.
    """
    first, second = F.col("first"), F.col("second")
    winner = F.when(F.col("pick") == "A", first).when(F.col("pick") == "B", second).otherwise("tie")
    both = verdicts.groupBy(key, F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).agg(
        F.max(F.when(first < second, winner)).alias("_f"), F.max(F.when(first > second, winner)).alias("_r"))
    agreed = (F.col("_f") == F.col("_r")) & (F.col("_f") != "tie")
    return both.select(key, "a", "b", F.when(agreed, F.col("_f")).alias("winner"),
                       (~F.coalesce(agreed, F.lit(False))).alias("tie"))


def repair_ranking(ranking: Column, n: Column) -> Column:
    """A judge's ranking made whole: valid numbers once each, omitted ones at the end."""
    every = F.sequence(F.lit(1), n)
    valid = F.filter(F.array_distinct(ranking), lambda i: i.isNotNull() & (i >= 1) & (i <= n))
    return F.array_union(valid, every)


def agentic_summary(evals: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Runs, pass rate, run score and per-layer means of agentic evaluations."""
    run_row = F.col("layer") == RUN_LAYER
    cols = []
    for layer in layers:
        here = F.col("layer") == layer
        cols += [avg_where("score", here).alias(f"{layer}_score"), count_where(here).alias(f"{layer}_count")]
    return evals.groupBy("organization_id").agg(
        count_where(run_row).alias("runs"), avg_where(F.col("run_passed").cast("double"), run_row).alias("pass_rate"),
        avg_where("run_score", run_row).alias("avg_run_score"), *cols)
