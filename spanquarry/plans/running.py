"""Evaluation runs, gates, comparisons, composites."""
from pyspark.sql import functions as F

from spanquarry.operators import running as R
from spanquarry.plans.registry import query
from spanquarry.schemas import LAYERS, TRACE_KEY

RUNS = ["A", "N", "R"]


def _r(df, n=6, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _text(col, digits=4):
    """A map or struct array as text, for comparison with the oracle."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat_ws("=", e.key, e.value)), ",")


@query("c09_run_items", """SELECT run_id, trace_id, example_id, e.input, e.expected_output
FROM v_run_items i LEFT JOIN (SELECT example_id, input, expected_output FROM v_examples WHERE source_trace_id IS NOT NULL) e USING (example_id)""")
def _(lake):
    examples = lake.examples.filter(F.col("source_trace_id").isNotNull())
    return R.run_items(lake.run_items, examples).select("run_id", "trace_id", "example_id", "input", "expected_output")


@query("c10_runs_with_counts", """SELECT dataset_id, example_id, (SELECT count(*) FROM v_run_items i WHERE i.example_id = e.example_id) AS item_count FROM v_examples e""")
def _(lake):
    parents = lake.examples.select("dataset_id", "example_id")
    return R.with_child_count(parents, lake.run_items, "example_id", "item_count")


RECENT = """SELECT e.organization_id, e.trace_id, e.metric, e.score, e.event_id, t.ingested_at AS trace_at FROM v_evals e
JOIN v_traces t ON t.organization_id = e.organization_id AND t.trace_id = e.trace_id"""


def _recent(lake):
    return R.recent_evals(lake.evals, lake.traces, "2001-12-01 00:00:00", 60 * 24 * 3000)


@query("c04_recent_evals", f"SELECT * FROM ({RECENT}) r ORDER BY trace_at DESC, organization_id, trace_id, metric, event_id LIMIT 200")
def _(lake):
    return R.recent_page(_recent(lake).select(*TRACE_KEY, "metric", "score", "event_id", "trace_at"), 200, ["event_id"])


@query("d26_eval_gate", f"""SELECT organization_id, count(*) AS total, count(*) FILTER (WHERE score >= 0.7) AS passed,
  count(*) FILTER (WHERE score < 0.7) AS failed, round(avg(score), 4) AS avg_score FROM ({RECENT}) r GROUP BY 1""")
def _(lake):
    return R.eval_gate(_recent(lake), 0.7, ["organization_id"])


@query("d27_threshold_gate", """WITH m AS (SELECT organization_id, trace_id, metric,
  bool_or(NOT (event_id % 10 = 0 OR score >= CASE metric WHEN 'm0' THEN 0.2 WHEN 'm1' THEN 0.0 ELSE 0.7 END) AND metric <> 'm1') AS failed FROM v_evals GROUP BY 1, 2, 3)
SELECT organization_id, trace_id, NOT bool_or(failed) AS passed, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE failed), '') AS failures FROM m GROUP BY 1, 2""")
def _(lake):
    limits = lake.spark.createDataFrame([("m0", 0.2), ("m1", 0.0)], "metric string, threshold double")
    scores = lake.evals.withColumn("error", F.col("event_id") % 10 == 0)
    return R.threshold_gate(scores, limits).withColumn("failures", F.array_join("failures", ","))


def _agentic(lake):
    return lake.evals.withColumns({
        "run_score": F.when(F.col("event_id") % 4 == 0, F.col("score")), "run_passed": F.col("score") >= 0.5,
        "layer": F.when(F.col("event_id") % 7 != 0, F.col("layer")).otherwise("")})


def _items(lake):
    return lake.raw("orders").select(
        F.col("o_orderstatus").alias("run_id"), F.col("o_orderkey").alias("example_id"), F.concat(F.lit("r"), "o_orderkey").alias("trace_id"))


ITEMS = "items AS (SELECT o_orderstatus AS run_id, o_orderkey AS example_id, concat('r', o_orderkey) AS trace_id FROM orders)"
AGENTIC = """ev AS (SELECT organization_id, trace_id, evaluator, metric, score, event_id, CASE WHEN event_id % 4 = 0 THEN score END AS run_score,
  score >= 0.5 AS run_passed, CASE WHEN event_id % 7 <> 0 THEN layer ELSE '' END AS layer FROM v_evals)"""


@query("d29_summarize_agentic", f"""WITH {ITEMS}, {AGENTIC}, j AS (SELECT ev.*, run_id FROM ev JOIN items USING (trace_id)),
n AS (SELECT run_id, count(*) AS total FROM items GROUP BY 1),
h AS (SELECT run_id, count(DISTINCT trace_id) AS completed, round(avg(run_score) FILTER (WHERE layer = 'deterministic'), 4) AS avg_run_score,
  round(avg(CASE WHEN run_passed THEN 1.0 ELSE 0.0 END) FILTER (WHERE layer = 'deterministic' AND run_score IS NOT NULL), 4) AS pass_rate FROM j GROUP BY 1),
l AS (SELECT run_id, string_agg(k || '=' || v, ',' ORDER BY k) AS layers FROM (SELECT run_id, layer AS k, round(avg(score), 4) AS v FROM j WHERE layer <> '' GROUP BY 1, 2) x GROUP BY 1),
m AS (SELECT run_id, string_agg(k || '=' || v, ',' ORDER BY k) AS metrics FROM (SELECT run_id, metric AS k, round(avg(score), 4) AS v FROM j WHERE layer = '' AND evaluator = 'auto.eval' GROUP BY 1, 2) x GROUP BY 1)
SELECT run_id, total, completed, avg_run_score, pass_rate, layers, metrics FROM n LEFT JOIN h USING (run_id) LEFT JOIN l USING (run_id) LEFT JOIN m USING (run_id)""")
def _(lake):
    s = R.summarize_agentic(_agentic(lake), _items(lake))
    return s.withColumns({"layers": _text("layers"), "metrics": _text("metrics")})


@query("d30_summarize_metrics", f"""WITH {ITEMS}, j AS (SELECT v_evals.*, run_id FROM v_evals JOIN items USING (trace_id) WHERE evaluator = 'auto.eval'),
n AS (SELECT run_id, count(*) AS total FROM items GROUP BY 1),
h AS (SELECT run_id, count(*) AS completed, round(avg(a), 4) AS avg_score FROM (SELECT run_id, trace_id, avg(score) AS a FROM j GROUP BY 1, 2) x GROUP BY 1),
m AS (SELECT run_id, string_agg(k || '=' || v, ',' ORDER BY k) AS metrics FROM (SELECT run_id, metric AS k, round(avg(score), 4) AS v FROM j GROUP BY 1, 2) x GROUP BY 1)
SELECT run_id, total, completed, avg_score, metrics FROM n LEFT JOIN h USING (run_id) LEFT JOIN m USING (run_id)""")
def _(lake):
    s = R.summarize_metrics(lake.evals, _items(lake))
    return s.withColumn("metrics", _text("metrics"))


@query("d31_summarize_security", f"""WITH {ITEMS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ingested_at DESC, event_id DESC) AS rn FROM v_scans) x WHERE rn = 1),
j AS (SELECT s.*, run_id FROM s JOIN items USING (trace_id)), n AS (SELECT run_id, count(*) AS total FROM items GROUP BY 1),
h AS (SELECT run_id, count(*) AS completed, count(*) FILTER (WHERE should_block = 1 OR injection_detected + jailbreak_detected + secrets_detected > 0 OR security_risk_level IN ('medium', 'high')) AS flagged,
  count(*) FILTER (WHERE should_block = 1) AS blocked,
  concat('injection=', sum(injection_detected), ',jailbreak=', sum(jailbreak_detected), ',secrets=', sum(secrets_detected)) AS threats FROM j GROUP BY 1),
l AS (SELECT run_id, string_agg(k || '=' || v, ',' ORDER BY k) AS risk_levels FROM (SELECT run_id, security_risk_level AS k, count(*) AS v FROM j GROUP BY 1, 2) x GROUP BY 1)
SELECT run_id, total, completed, flagged, blocked, threats, risk_levels FROM n LEFT JOIN h USING (run_id) LEFT JOIN l USING (run_id)""")
def _(lake):
    s = R.summarize_security(lake.scans, _items(lake))
    return s.withColumns({"threats": _text("threats"), "risk_levels": _text("risk_levels")})


@query("d32_run_status", """WITH c AS (SELECT run_id, count(*) FILTER (WHERE done AND gen_error IS NULL) AS completed FROM v_run_items GROUP BY 1)
SELECT run_id, count(*) AS total, count(gen_error) AS gen_failed, max(completed) AS completed, count(*) - count(gen_error) AS expected,
  CASE WHEN max(completed) >= count(*) - count(gen_error) THEN 'complete' ELSE 'running' END AS status FROM v_run_items JOIN c USING (run_id) GROUP BY 1""")
def _(lake):
    items = lake.run_items.withColumn("generated", F.lit(True))
    done = items.groupBy("run_id").agg(F.count_if(F.col("done") & F.col("gen_error").isNull()).alias("completed"))
    return R.run_status(items, done)


@query("d33_fold_trials", """WITH f AS (SELECT run_id, example_id, metric, avg(score) AS score, max(score) - min(score) AS spread, count(*) AS n FROM v_run_items GROUP BY 1, 2, 3),
r AS (SELECT run_id, example_id, string_agg(metric || ':' || n, ',' ORDER BY metric) AS metrics, round(sum(score), 6) AS score_sum, round(max(spread), 6) AS spread FROM f GROUP BY 1, 2)
SELECT run_id, example_id, count(*) AS trials, bool_and(done) AS done, round(avg(latency_ms), 4) AS latency_ms, round(sum(cost_usd), 6) AS cost_usd,
  min(trace_id) AS first_trace_id, any_value(metrics) AS metrics, any_value(score_sum) AS score_sum, any_value(spread) AS spread
FROM v_run_items JOIN r USING (run_id, example_id) GROUP BY 1, 2""")
def _(lake):
    f = R.fold_trials(lake.run_items, lake.run_items)
    return f.select(
        "run_id", "example_id", "trials", "done", F.round("latency_ms", 4).alias("latency_ms"), F.round("cost_usd", 6).alias("cost_usd"),
        "first_trace_id", F.array_join(F.transform("result", lambda x: F.concat_ws(":", x.metric, x.trials)), ",").alias("metrics"),
        F.round(F.aggregate("result", F.lit(0.0), lambda a, x: a + x.score), 6).alias("score_sum"),
        F.round(F.array_max(F.transform("result", lambda x: x.spread)), 6).alias("spread"))


PER = "per AS (SELECT run_id, example_id, metric, avg(score) AS score FROM v_run_scores GROUP BY 1, 2, 3)"


def _per(lake):
    return lake.run_scores.groupBy("run_id", "example_id", "metric").agg(F.avg("score").alias("score"))


def _side(lake, run):
    # One in twenty examples of each run has no score yet.
    overall = _per(lake).filter(F.col("run_id") == run).groupBy("example_id").agg(F.avg("score").alias("score"))
    pending = F.pmod(F.col("example_id") + (7 if run == "A" else 0), F.lit(20)) == 3
    return overall.withColumn("score", F.when(~pending, F.round("score", 9)))


EXAMPLES = f"""WITH {PER}, o AS (SELECT run_id, example_id, round(avg(score), 9) AS score FROM per GROUP BY 1, 2),
a AS (SELECT example_id, CASE WHEN (example_id + 7) % 20 <> 3 THEN score END AS score FROM o WHERE run_id = 'A'),
b AS (SELECT example_id, CASE WHEN example_id % 20 <> 3 THEN score END AS baseline_score FROM o WHERE run_id = 'R'),
cmp AS (SELECT coalesce(a.example_id, b.example_id) AS example_id, score, baseline_score, CAST(round(CAST(round(score - baseline_score, 9) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS delta,
  CASE WHEN b.example_id IS NULL THEN 'added' WHEN a.example_id IS NULL THEN 'missing' WHEN score - baseline_score IS NULL THEN 'pending'
       WHEN round(score - baseline_score, 9) < -0.05 THEN 'regressed' WHEN round(score - baseline_score, 9) > 0.05 THEN 'improved' ELSE 'unchanged' END AS status
  FROM a FULL OUTER JOIN b ON a.example_id = b.example_id)"""


@query("d34_compare_runs", f"{EXAMPLES} SELECT example_id, round(score, 6) AS score, round(baseline_score, 6) AS baseline_score, delta, status FROM cmp")
def _(lake):
    return _r(R.compare_examples(_side(lake, "A"), _side(lake, "R")), 6, "score", "baseline_score")


@query("c11_compare_counts", f"{EXAMPLES} SELECT status, count(*) AS n FROM cmp GROUP BY 1")
def _(lake):
    return R.compare_examples(_side(lake, "A"), _side(lake, "R")).groupBy("status").agg(F.count("*").alias("n"))


@query("f05_comparison_order", f"""{EXAMPLES} SELECT example_id, delta, status FROM cmp
ORDER BY CASE status WHEN 'regressed' THEN 0 WHEN 'improved' THEN 1 WHEN 'unchanged' THEN 2 WHEN 'added' THEN 3 WHEN 'pending' THEN 4 ELSE 5 END,
  coalesce(delta, 0), example_id LIMIT 100""")
def _(lake):
    from spanquarry.functions.common import page_of
    rows = R.compare_examples(_side(lake, "A"), _side(lake, "R"))
    return page_of(rows, R.comparison_order(), 100).select("example_id", "delta", "status")


@query("g04_example_sets", """SELECT example_id FROM v_run_scores WHERE run_id = 'R' AND score = 1
EXCEPT SELECT example_id FROM v_run_scores WHERE run_id = 'A' AND score = 1""")
def _(lake):
    # Examples the baseline got fully right at least once and the other run never did.
    ids = lambda run: lake.run_scores.filter((F.col("run_id") == run) & (F.col("score") == 1)).select("example_id").distinct()
    return ids("R").join(ids("A"), "example_id", "left_anti")


@query("d34_compare_metrics", f"""WITH {PER} SELECT a.metric, round(avg(a.score), 4) AS avg, round(avg(b.score), 4) AS baseline_avg, round(avg(a.score - b.score), 4) AS delta
FROM per a JOIN per b ON a.example_id = b.example_id AND a.metric = b.metric WHERE a.run_id = 'A' AND b.run_id = 'R' GROUP BY 1""")
def _(lake):
    per = _per(lake)
    return R.compare_metrics(per.filter(F.col("run_id") == "A"), per.filter(F.col("run_id") == "R"))


@query("d35_metric_matrix", f"""WITH {PER} SELECT metric, round(avg(score) FILTER (WHERE run_id = 'A'), 4) AS "A", round(avg(score) FILTER (WHERE run_id = 'N'), 4) AS "N",
  round(avg(score) FILTER (WHERE run_id = 'R'), 4) AS "R" FROM per GROUP BY 1""")
def _(lake):
    return R.matrix(_per(lake), RUNS)


def _matrix_sql(value="score", tail=""):
    return f"""WITH {PER}, t AS (SELECT example_id, avg({value}) FILTER (WHERE run_id = 'A') AS a, avg({value}) FILTER (WHERE run_id = 'N') AS n,
  avg({value}) FILTER (WHERE run_id = 'R') AS r FROM per GROUP BY 1)
SELECT example_id, round(a, 6) AS "A", round(n, 6) AS "N", round(r, 6) AS "R",
  CASE WHEN (a IS NOT NULL)::INT + (n IS NOT NULL)::INT + (r IS NOT NULL)::INT >= 2 THEN round(greatest(a, n, r) - least(a, n, r), 4) END AS spread FROM t {tail}"""


@query("c12_example_matrix", _matrix_sql())
def _(lake):
    return _r(R.example_matrix(_per(lake), RUNS), 6, *RUNS)


@query("d35_matrix_drill", _matrix_sql("CASE WHEN metric = 'F' THEN score END"))
def _(lake):
    return _r(R.example_matrix(_per(lake), RUNS, "F"), 6, *RUNS)


@query("f06_widest_disagreement", _matrix_sql(tail="ORDER BY spread DESC NULLS LAST, example_id LIMIT 100"))
def _(lake):
    from spanquarry.functions.common import page_of
    return _r(page_of(R.example_matrix(_per(lake), RUNS), R.widest_first(), 100), 6, *RUNS)


@query("d35_run_overview", f"""WITH {PER} SELECT run_id, round(avg(o), 4) AS overall, count(o) AS completed FROM (SELECT run_id, example_id, avg(score) AS o FROM per GROUP BY 1, 2) x GROUP BY 1""")
def _(lake):
    return R.run_overview(_per(lake))


@query("d36_example_scores", f"""WITH {AGENTIC}, p AS (SELECT organization_id, trace_id, layer, avg(score) AS s, max(run_score) FILTER (WHERE layer = 'deterministic') AS rs FROM ev WHERE layer <> '' GROUP BY 1, 2, 3)
SELECT organization_id, trace_id, round(coalesce(max(rs), min(s)), 6) AS score, count(*) AS layers FROM p GROUP BY 1, 2""")
def _(lake):
    s = R.example_scores(_agentic(lake), "agentic", TRACE_KEY)
    return s.select(*TRACE_KEY, F.round("score", 6).alias("score"), F.size("scores").cast("bigint").alias("layers"))


@query("d36_metric_scores", """WITH p AS (SELECT organization_id, trace_id, metric, avg(score) AS s FROM v_evals WHERE evaluator = 'auto.eval' GROUP BY 1, 2, 3)
SELECT organization_id, trace_id, round(avg(s), 6) AS score, string_agg(metric, ',' ORDER BY metric) AS metrics FROM p GROUP BY 1, 2""")
def _(lake):
    s = R.example_scores(lake.evals, "metrics", TRACE_KEY)
    return s.select(*TRACE_KEY, F.round("score", 6).alias("score"), F.array_join(F.array_sort(F.map_keys("scores")), ",").alias("metrics"))


COMPONENTS = [("org0", "quality", "O", 0.5), ("org0", "quality", "F", 0.3), ("org0", "quality", "tone", 0.2), ("org1", "tone_only", "tone", 1.0), ("org2", "open", "O", 2.0)]


@query("d37_composites", f"""WITH {PER}, s AS (SELECT concat('org', example_id % 5) AS organization_id, run_id, example_id, metric, score FROM per),
d(organization_id, slug, metric, weight) AS (VALUES {", ".join(str(c) for c in COMPONENTS)}),
w AS (SELECT DISTINCT s.organization_id, run_id, example_id, slug, d.metric, weight FROM s JOIN d USING (organization_id)),
j AS (SELECT w.*, score FROM w LEFT JOIN s USING (organization_id, run_id, example_id, metric))
SELECT organization_id, run_id, example_id, slug, round(CAST(sum(score * weight) / sum(weight) FILTER (WHERE score IS NOT NULL) AS DOUBLE), 6) AS value,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE score IS NOT NULL), '') AS present,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE score IS NULL), '') AS missing, bool_and(score IS NOT NULL) AS complete
FROM j GROUP BY 1, 2, 3, 4""")
def _(lake):
    scores = _per(lake).withColumn("organization_id", F.concat(F.lit("org"), F.col("example_id") % 5))
    parts = lake.spark.createDataFrame(COMPONENTS, "organization_id string, slug string, metric string, weight double")
    out = R.composites(scores, parts, ["run_id", "example_id"])
    return out.withColumns({"value": F.round("value", 6), "present": F.array_join("present", ","), "missing": F.array_join("missing", ",")})


@query("k12_expand_trials", """SELECT example_id, trial, sha256(concat('run1', ':', example_id, ':', trial)) AS trace_id
FROM (SELECT example_id FROM v_examples) e, (SELECT unnest(range(1, 4)) AS trial) t""")
def _(lake):
    return R.expand_trials(lake.examples.select("example_id"), 3, "run1", [F.col("example_id")])


@query("k16_pairwise", """WITH v AS (SELECT doc_id AS prompt_id, 'x' AS a, 'y' AS b, CASE doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'tie' END AS f,
  CASE doc_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'x' ELSE 'tie' END AS r FROM documents)
SELECT prompt_id, a, b, CASE WHEN f = r AND f <> 'tie' THEN f END AS winner, NOT (f = r AND f <> 'tie') AS tie FROM v""")
def _(lake):
    d = lake.raw("documents").select(F.col("doc_id").alias("prompt_id"))
    pick = lambda m: F.when(F.col("prompt_id") % m == 0, "A").when(F.col("prompt_id") % m == 1, "B").otherwise("tie")
    one = d.select("prompt_id", F.lit("x").alias("first"), F.lit("y").alias("second"), pick(3).alias("pick"))
    two = d.select("prompt_id", F.lit("y").alias("first"), F.lit("x").alias("second"), pick(4).alias("pick"))
    return R.pairwise(one.unionByName(two))


@query("k16_repair_ranking", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN a BETWEEN 1 AND 3 THEN
   CASE a WHEN 1 THEN '1,2,3' WHEN 2 THEN '2,1,3' ELSE '3,1,2' END ELSE '1,2,3' END
  ELSE CASE a WHEN 2 THEN '3,2,1' ELSE '3,1,2' END END AS ranking FROM (SELECT doc_id, doc_id % 5 AS a FROM documents) d""")
def _(lake):
    a = (F.col("doc_id") % 5).cast("int")
    raw = F.when(F.col("doc_id") % 2 == 0, F.array(a, a, F.lit(9))).otherwise(F.array(F.lit(3), a, a))
    fixed = R.repair_ranking(raw, F.lit(3))
    return lake.raw("documents").select("doc_id", F.array_join(fixed, ",").alias("ranking"))


@query("d25_agentic_health", """SELECT organization_id, count(*) FILTER (WHERE layer = 'deterministic') AS runs,
  round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE layer = 'deterministic'), 6) AS pass_rate,
  round(avg(score) FILTER (WHERE layer = 'deterministic'), 6) AS avg_run_score,
  round(avg(score) FILTER (WHERE layer = 'tool_selection'), 6) AS tool_selection_score, count(*) FILTER (WHERE layer = 'tool_selection') AS tool_selection_count,
  round(avg(score) FILTER (WHERE layer = 'trajectory'), 6) AS trajectory_score, count(*) FILTER (WHERE layer = 'trajectory') AS trajectory_count,
  round(avg(score) FILTER (WHERE layer = 'coordination'), 6) AS coordination_score, count(*) FILTER (WHERE layer = 'coordination') AS coordination_count
FROM v_evals WHERE evaluator = 'auto.eval' GROUP BY 1""")
def _(lake):
    ev = lake.evals.filter(F.col("evaluator") == "auto.eval").withColumns({"run_score": F.col("score"), "run_passed": F.col("score") >= 0.5})
    s = R.agentic_summary(ev, LAYERS)
    return _r(s.drop("deterministic_score", "deterministic_count"), 6, "pass_rate", "avg_run_score", "tool_selection_score", "trajectory_score", "coordination_score")
