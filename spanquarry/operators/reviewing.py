"""Human review: queue, judge / human pairs, agreement, matrix, rubric answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import count_where, mean_where, page_of, trailing
from spanquarry.operators.filters import is_human, is_root
from spanquarry.operators.versioned import latest
from spanquarry.schemas import TRACE_KEY

REVIEW_THRESHOLD = 0.5
# Fixed values of the agreement report.
WEAK_CORRELATION = 0.3
CONSTANT_TOLERANCE = 1e-9
MIN_LABELS = 10
BASE_RATE_SLACK = 0.05
BIAS_LIMIT = 0.15
GOOD_AGREEMENT = 0.8
DISAGREEMENT_GAP = 0.34


def score_summary(evals: DataFrame) -> DataFrame:
    """Mean judge and mean human score of each trace; null where a side is missing."""
    aggs = [mean_where("score", ~is_human()).alias("judge_score"), mean_where("score", is_human()).alias("human_score")]
    if "comment" in evals.columns:
        aggs.append(F.min(F.when(is_human(), F.col("comment"))).alias("comment"))
    return evals.groupBy(*TRACE_KEY).agg(*aggs)


def review_queue(traces: DataFrame, evals: DataFrame, flags: DataFrame, as_of, hours: int = 168,
                 source: str = "all") -> DataFrame:
    """Recent roots that someone flagged, a user disliked or a judge scored low.

    The three sources are one OR over a per-trace summary, so a trace with several
    reasons appears once.  Resolved flags leave the queue.
    """
    roots = traces.filter(trailing("ingested_at", as_of, hours=hours) & is_root())
    tie = [c for c in ("event_id",) if c in flags.columns]
    state = latest(flags, TRACE_KEY, "updated_at", tie).select(
        *TRACE_KEY, F.col("status").alias("flag_status"), F.col("reason").alias("flag_reason"))
    reasons = {
        "flagged": F.col("flag_status") == "open",
        "feedback": F.col("human_score") < REVIEW_THRESHOLD,
        "low_score": F.col("judge_score") < REVIEW_THRESHOLD,
    }
    wanted = reasons.get(source, reasons["flagged"] | reasons["feedback"] | reasons["low_score"])
    return (
        roots.join(score_summary(evals), TRACE_KEY, "left").join(state, TRACE_KEY, "left")
        .filter(F.coalesce(wanted, F.lit(False)))
        .filter(F.coalesce(F.col("flag_status"), F.lit("")) != "resolved")
    )


def queue_page(queue: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Worst first: human verdict, then judge score, then newest."""
    order = [F.col("human_score").asc_nulls_last(), F.col("judge_score").asc_nulls_last(),
             F.col("ingested_at").desc_nulls_last(), F.col("organization_id"), F.col("trace_id")]
    return page_of(queue, order, limit, offset)


def agreement_pairs(evals: DataFrame, judge_metric: str, as_of, human_field: str | None = None,
                    hours: int = 720) -> DataFrame:
    """Traces that carry both a score of this judge and a human label."""
    judge = ~is_human() & (F.col("metric") == judge_metric)
    human = is_human() if human_field is None else is_human() & (F.col("metric") == human_field)
    recent = evals.filter(trailing("ingested_at", as_of, hours=hours))
    return (
        recent.groupBy(*TRACE_KEY).agg(
            mean_where("score", judge).alias("judge"), mean_where("score", human).alias("human"),
            count_where(judge).alias("_j"), count_where(human).alias("_h"))
        .filter((F.col("_j") > 0) & (F.col("_h") > 0)).drop("_j", "_h")
    )


def pairs_with_preview(pairs: DataFrame, traces: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Attach previews from the trace; pairs whose trace is gone are dropped."""
    return pairs.join(traces.select(*TRACE_KEY, *[c.alias(n) for n, c in cols.items()]), TRACE_KEY)


def judge_agreement(pairs: DataFrame, threshold: float = REVIEW_THRESHOLD, keys=("organization_id",)) -> DataFrame:
    """Agreement, correlation, error and bias per group, from moments in one aggregation.

    Correlation is null when a side does not vary: its deviations must exceed a small
    tolerance, because averaging equal numbers leaves rounding noise.
    """
    p = pairs.filter(F.col("judge").isNotNull() & F.col("human").isNotNull())
    j, h = F.col("judge"), F.col("human")
    stats = p.groupBy(*keys).agg(
        F.count("*").alias("compared"),
        F.avg(((j >= threshold) == (h >= threshold)).cast("double")).alias("agreement"),
        F.covar_pop(j, h).alias("_cov"), F.stddev_pop(j).alias("_sj"), F.stddev_pop(h).alias("_sh"),
        F.avg(F.abs(j - h)).alias("mean_error"), F.avg(j - h).alias("bias"),
        (F.min(j) == F.max(j)).alias("constant_judge"),
        F.avg((h >= 0.5).cast("double")).alias("_pos"),
    )
    root_n = F.sqrt("compared")
    flat = (F.col("_sj") * root_n < CONSTANT_TOLERANCE) | (F.col("_sh") * root_n < CONSTANT_TOLERANCE) | (F.col("compared") < 2)
    r = F.try_divide(F.col("_cov"), F.col("_sj") * F.col("_sh"))
    return stats.select(
        *keys, "compared", "agreement",
        F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("correlation"),
        "mean_error", "bias", "constant_judge", F.greatest("_pos", 1 - F.col("_pos")).alias("base_rate"),
    )


def agreement_verdict(stats: DataFrame) -> DataFrame:
    """The first rule that applies names what the numbers mean."""
    at_base = F.col("agreement") >= F.col("base_rate") - BASE_RATE_SLACK
    weak = F.col("correlation") < WEAK_CORRELATION
    verdict = (
        F.when(F.col("compared") == 0, "no_data").when(F.col("compared") < MIN_LABELS, "insufficient")
        .when(F.col("constant_judge") & at_base, "matches_base_rate").when(F.col("constant_judge"), "weak")
        .when(F.col("correlation").isNull(), "undetermined")
        .when(weak & at_base, "matches_base_rate").when(weak, "weak")
        .when(F.col("bias") > BIAS_LIMIT, "lenient").when(F.col("bias") < -BIAS_LIMIT, "harsh")
        .when(F.col("agreement") >= GOOD_AGREEMENT, "good").otherwise("mixed")
    )
    return stats.withColumn("verdict", verdict)


def disagreements(pairs: DataFrame, threshold: float = REVIEW_THRESHOLD, limit: int = 20) -> DataFrame:
    """Largest gaps first among pairs with opposite verdicts or a wide gap."""
    j, h = F.col("judge"), F.col("human")
    gap = F.round(F.abs(j - h), 9)
    rows = pairs.filter(((j >= threshold) != (h >= threshold)) | (gap >= DISAGREEMENT_GAP)).withColumns({
        "gap": gap, "direction": F.when(j > h, "lenient").otherwise("harsh")})
    return page_of(rows, [F.col("gap").desc(), F.col("organization_id"), F.col("trace_id")], limit)


def _per_trace(evals: DataFrame, as_of, hours: int) -> DataFrame:
    return evals.filter(trailing("ingested_at", as_of, hours=hours)).groupBy(*TRACE_KEY).agg(
        mean_where("score", is_human()).alias("human"), mean_where("score", ~is_human()).alias("judge"),
        count_where(is_human()).alias("n_human"), count_where(~is_human()).alias("n_judge"))


def review_matrix(evals: DataFrame, as_of, hours: int = 168, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Human verdict against judge verdict, per organization; the threshold itself is good."""
    t = _per_trace(evals, as_of, hours).filter((F.col("n_human") > 0) & (F.col("n_judge") > 0))
    hg, jg = F.col("human") >= threshold, F.col("judge") >= threshold
    return t.groupBy("organization_id").agg(
        count_where(hg & jg).alias("agreed_good"), count_where(hg & ~jg).alias("judge_harsh"),
        count_where(~hg & jg).alias("judge_lenient"), count_where(~hg & ~jg).alias("agreed_bad"))


def review_coverage(evals: DataFrame, as_of, hours: int = 168) -> DataFrame:
    t = _per_trace(evals, as_of, hours)
    h, j = F.col("n_human") > 0, F.col("n_judge") > 0
    return t.groupBy("organization_id").agg(
        count_where(h & j).alias("both"), count_where(~h & j).alias("judge_only"), count_where(h & ~j).alias("human_only"))


def labelled_metrics(evals: DataFrame, as_of, hours: int = 720) -> DataFrame:
    """Scored rows and distinct traces per metric and side."""
    recent = evals.filter(trailing("ingested_at", as_of, hours=hours) & (F.col("metric") != ""))
    return recent.groupBy("organization_id", "metric", is_human().alias("is_human")).agg(
        F.count("*").alias("scored"), F.count_distinct("trace_id").alias("traces"))


def top_labelled(metrics: DataFrame, limit: int = 200) -> DataFrame:
    return page_of(metrics, [F.col("traces").desc(), F.col("organization_id"), F.col("metric"), F.col("is_human")], limit)


def review_score(answers: DataFrame, keys=("organization_id", "trace_id")) -> DataFrame:
    """A reviewer's overall verdict: the mean of the scored answers only."""
    return answers.groupBy(*keys).agg(F.avg("score").alias("score"))


def reviewed_to_examples(traces: DataFrame, ids: DataFrame, question: Column, model: str = "model") -> DataFrame:
    """Reviewed traces as examples; the expected output stays empty on purpose."""
    rows = traces.join(ids.select(*TRACE_KEY).distinct(), TRACE_KEY, "left_semi").withColumn("input", question)
    return rows.filter(F.length(F.trim(F.coalesce("input", F.lit("")))) > 0).select(
        "organization_id", "input", F.lit(None).cast("string").alias("expected_output"),
        F.col("trace_id").alias("source_trace_id"), F.lit(True).alias("from_review"), F.col(model).alias("model"))
