"""Review queue, agreement of judges with humans, review matrix."""
from pyspark.sql import functions as F

from spanquarry.operators import reviewing as R
from spanquarry.plans.registry import query
from spanquarry.schemas import TRACE_KEY

AT = "2024-01-31 00:00:00"
HUMAN = "evaluator LIKE 'human.%'"
RECENT = "ingested_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 720 HOUR"
SUMMARY = f"""SELECT organization_id, trace_id, round(avg(score) FILTER (WHERE NOT ({HUMAN})), 9) AS judge_score,
  round(avg(score) FILTER (WHERE {HUMAN}), 9) AS human_score FROM v_evals GROUP BY 1, 2"""
FLAGS = """SELECT organization_id, trace_id, status AS flag_status, reason AS flag_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY organization_id, trace_id ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM v_flag_log) x WHERE rn = 1"""


def _queue_sql(reason, tail=""):
    return f"""WITH e AS ({SUMMARY}), f AS ({FLAGS})
SELECT organization_id, trace_id, ingested_at, round(judge_score, 6) AS judge_score, round(human_score, 6) AS human_score, flag_status, flag_reason
FROM v_traces LEFT JOIN e USING (organization_id, trace_id) LEFT JOIN f USING (organization_id, trace_id)
WHERE (is_root = 1 OR trace_id = root_trace_id) AND ({reason}) AND coalesce(flag_status, '') <> 'resolved' {tail}"""


ANY = "flag_status = 'open' OR human_score < 0.5 OR judge_score < 0.5"


def _queue(lake, source="all"):
    return R.review_queue(lake.traces, lake.evals, lake.flag_log, "2001-12-01 00:00:00", 24 * 3000, source)


def _show(df):
    return df.select(*TRACE_KEY, "ingested_at", F.round("judge_score", 6).alias("judge_score"),
                     F.round("human_score", 6).alias("human_score"), "flag_status", "flag_reason")


@query("c06_review_queue", _queue_sql(ANY))
def _(lake):
    return _show(_queue(lake))


@query("g01_queue_feedback", _queue_sql("human_score < 0.5"))
def _(lake):
    return _show(_queue(lake, "feedback"))


@query("f03_queue_page", _queue_sql(ANY, "ORDER BY human_score ASC NULLS LAST, judge_score ASC NULLS LAST, ingested_at DESC, organization_id, trace_id LIMIT 100"))
def _(lake):
    return _show(R.queue_page(_queue(lake), 100))


def _pairs_sql(field=None):
    human = HUMAN + (f" AND metric = '{field}'" if field else "")
    judge = f"NOT ({HUMAN}) AND metric = 'm1'"
    return f"""SELECT organization_id, trace_id, round(avg(score) FILTER (WHERE {judge}), 9) AS judge, round(avg(score) FILTER (WHERE {human}), 9) AS human
FROM v_evals WHERE {RECENT} GROUP BY 1, 2
HAVING count(*) FILTER (WHERE {judge}) > 0 AND count(*) FILTER (WHERE {human}) > 0"""


def _rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("d18_agreement_pairs", f"SELECT organization_id, trace_id, round(judge, 6) AS judge, round(human, 6) AS human FROM ({_pairs_sql()}) p")
def _(lake):
    return _rounded(R.agreement_pairs(lake.evals, "m1", AT), "judge", "human")


@query("d18_agreement_pairs_field", f"SELECT organization_id, trace_id, round(judge, 6) AS judge, round(human, 6) AS human FROM ({_pairs_sql('m2')}) p")
def _(lake):
    return _rounded(R.agreement_pairs(lake.evals, "m1", AT, "m2"), "judge", "human")


@query("c07_pairs_with_preview", f"""SELECT organization_id, trace_id, round(judge, 6) AS judge, round(human, 6) AS human, substring(model, 1, 300) AS preview
FROM ({_pairs_sql()}) p JOIN v_traces USING (organization_id, trace_id)""")
def _(lake):
    pairs = R.agreement_pairs(lake.evals, "m1", AT)
    return _rounded(R.pairs_with_preview(pairs, lake.traces, {"preview": F.substring("model", 1, 300)}), "judge", "human")


STATS = f"""SELECT organization_id, count(*) AS compared,
  avg(CASE WHEN (judge >= 0.5) = (human >= 0.5) THEN 1.0 ELSE 0.0 END) AS agreement,
  CASE WHEN count(*) >= 2 AND stddev_pop(judge) * sqrt(count(*)) >= 1e-9 AND stddev_pop(human) * sqrt(count(*)) >= 1e-9
       THEN covar_pop(judge, human) / (stddev_pop(judge) * stddev_pop(human)) END AS correlation,
  avg(abs(judge - human)) AS mean_error, avg(judge - human) AS bias, min(judge) = max(judge) AS constant_judge,
  greatest(avg(CASE WHEN human >= 0.5 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN human >= 0.5 THEN 1.0 ELSE 0.0 END)) AS base_rate
FROM ({_pairs_sql()}) p GROUP BY 1"""


@query("d19_judge_agreement", f"""SELECT organization_id, compared, round(agreement, 6) AS agreement, round(correlation, 6) AS correlation,
  round(mean_error, 6) AS mean_error, round(bias, 6) AS bias FROM ({STATS}) s""")
def _(lake):
    s = R.judge_agreement(R.agreement_pairs(lake.evals, "m1", AT))
    return _rounded(s.drop("constant_judge", "base_rate"), "agreement", "correlation", "mean_error", "bias")


@query("k20_agreement_verdict", f"""SELECT organization_id, CASE WHEN compared < 10 THEN 'insufficient'
  WHEN constant_judge AND agreement >= base_rate - 0.05 THEN 'matches_base_rate' WHEN constant_judge THEN 'weak'
  WHEN correlation IS NULL THEN 'undetermined'
  WHEN correlation < 0.3 AND agreement >= base_rate - 0.05 THEN 'matches_base_rate' WHEN correlation < 0.3 THEN 'weak'
  WHEN bias > 0.15 THEN 'lenient' WHEN bias < -0.15 THEN 'harsh' WHEN agreement >= 0.8 THEN 'good' ELSE 'mixed' END AS verdict
FROM ({STATS}) s""")
def _(lake):
    s = R.judge_agreement(R.agreement_pairs(lake.evals, "m1", AT))
    return R.agreement_verdict(s).select("organization_id", "verdict")


@query("f08_disagreements", f"""SELECT organization_id, trace_id, round(judge, 6) AS judge, round(human, 6) AS human, round(abs(judge - human), 6) AS gap,
  CASE WHEN judge > human THEN 'lenient' ELSE 'harsh' END AS direction FROM ({_pairs_sql()}) p
WHERE (judge >= 0.5) <> (human >= 0.5) OR round(abs(judge - human), 9) >= 0.34
ORDER BY round(abs(judge - human), 9) DESC, organization_id, trace_id LIMIT 20""")
def _(lake):
    pairs = R.agreement_pairs(lake.evals, "m1", AT)
    return _rounded(R.disagreements(pairs), "judge", "human", "gap")


PER_TRACE = f"""SELECT organization_id, trace_id, round(avg(score) FILTER (WHERE {HUMAN}), 9) AS h, round(avg(score) FILTER (WHERE NOT ({HUMAN})), 9) AS j
FROM v_evals WHERE {RECENT} GROUP BY 1, 2"""


@query("d15_review_matrix", f"""SELECT organization_id, count(*) FILTER (WHERE h >= 0.5 AND j >= 0.5) AS agreed_good,
  count(*) FILTER (WHERE h >= 0.5 AND j < 0.5) AS judge_harsh, count(*) FILTER (WHERE h < 0.5 AND j >= 0.5) AS judge_lenient,
  count(*) FILTER (WHERE h < 0.5 AND j < 0.5) AS agreed_bad
FROM ({PER_TRACE}) t WHERE h IS NOT NULL AND j IS NOT NULL GROUP BY 1""")
def _(lake):
    return R.review_matrix(lake.evals, AT, 720)


@query("d16_review_coverage", f"""SELECT organization_id, count(*) FILTER (WHERE h IS NOT NULL AND j IS NOT NULL) AS both,
  count(*) FILTER (WHERE h IS NULL AND j IS NOT NULL) AS judge_only, count(*) FILTER (WHERE h IS NOT NULL AND j IS NULL) AS human_only
FROM ({PER_TRACE}) t GROUP BY 1""")
def _(lake):
    return R.review_coverage(lake.evals, AT, 720)


@query("d17_labelled_metrics", f"""SELECT organization_id, metric, {HUMAN} AS is_human, count(*) AS scored, count(DISTINCT trace_id) AS traces
FROM v_evals WHERE {RECENT} AND metric <> '' GROUP BY 1, 2, 3 ORDER BY traces DESC, organization_id, metric, is_human LIMIT 200""")
def _(lake):
    return R.top_labelled(R.labelled_metrics(lake.evals, AT))


@query("d42_review_score", """SELECT organization_id, trace_id, round(avg(CASE WHEN evaluator = 'human.annotation' THEN score END), 6) AS score
FROM v_evals GROUP BY 1, 2""")
def _(lake):
    answers = lake.evals.withColumn("score", F.when(F.col("evaluator") == "human.annotation", F.col("score")))
    return _rounded(R.review_score(answers), "score")


@query("k18_reviewed_to_examples", f"""WITH f AS ({FLAGS}) SELECT organization_id, model AS input, CAST(NULL AS VARCHAR) AS expected_output,
  trace_id AS source_trace_id, true AS from_review, model
FROM v_traces WHERE (organization_id, trace_id) IN (SELECT (organization_id, trace_id) FROM f WHERE flag_status = 'resolved')""")
def _(lake):
    from spanquarry.operators.versioned import latest
    done = latest(lake.flag_log, TRACE_KEY, "updated_at", ["event_id"]).filter(F.col("status") == "resolved")
    return R.reviewed_to_examples(lake.traces, done, F.col("model"))
