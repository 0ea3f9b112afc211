"""Trace list, its filters, and the reads of versioned logs."""
from pyspark.sql import functions as F

from spanquarry.functions.common import page_of
from spanquarry.operators import filters as P, trace_list as TL, versioned as V
from spanquarry.operators.trace_list import TraceQuery
from spanquarry.plans.registry import query
from spanquarry.schemas import RUN_KEY, TRACE_KEY

ROOT = "(is_root = 1 OR trace_id = root_trace_id)"
BLOCKED = "coalesce(status, '') = 'blocked'"
FAILED = "success IS NOT NULL AND success = false AND coalesce(status, '') <> 'blocked'"
CLASS_COUNTS = "SELECT {cls} AS bucket, count(*) AS n FROM {src} GROUP BY 1"

COSTS = "SELECT organization_id, trace_id, sum(total_cost) AS total_cost FROM v_costs GROUP BY ALL"
SCORES = "SELECT organization_id, trace_id, count(*) AS n_evaluations, min(score) AS min_score FROM v_evals GROUP BY ALL"
SCANS = """SELECT organization_id, trace_id, security_risk_level, security_risk_score, should_block FROM (
  SELECT *, row_number() OVER (PARTITION BY organization_id, trace_id ORDER BY ingested_at DESC, event_id DESC) AS rn
  FROM v_scans) x WHERE rn = 1"""
LIVE_TAGS = """SELECT organization_id, trace_id, tag FROM (
  SELECT *, row_number() OVER (PARTITION BY organization_id, trace_id, tag ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM v_tag_log) x WHERE rn = 1 AND deleted = 0"""


def listing(where="true", order="ingested_at DESC", limit="LIMIT 100"):
    return f"""WITH c AS ({COSTS}), e AS ({SCORES}), s AS ({SCANS}), live AS ({LIVE_TAGS})
SELECT t.organization_id, t.trace_id, t.root_trace_id, t.ingested_at, t.latency, t.model,
       round(CAST(c.total_cost AS DOUBLE), 6) AS cost, coalesce(e.n_evaluations, 0) AS n_evaluations,
       e.min_score, s.security_risk_level, s.should_block
FROM v_traces t LEFT JOIN c USING (organization_id, trace_id) LEFT JOIN e USING (organization_id, trace_id)
     LEFT JOIN s USING (organization_id, trace_id)
WHERE {where}
ORDER BY {order}, t.organization_id, t.trace_id {limit}"""


def _list(lake, **kw):
    q = TraceQuery(**kw)
    rows = TL.list_traces(q, lake.traces, lake.costs, lake.evals, lake.scans, lake.tag_log)
    return rows.select(
        *TRACE_KEY, "root_trace_id", "ingested_at", "latency", "model",
        F.round(F.col("total_cost").cast("double"), 6).alias("cost"), "n_evaluations", "min_score",
        "security_risk_level", "should_block",
    )


@query("c01_trace_list", listing())
def _(lake):
    return _list(lake)


@query("c01_trace_list_roots_failed", listing(
    f"{ROOT} AND (organization_id, root_trace_id) IN (SELECT (organization_id, root_trace_id) FROM v_traces WHERE {FAILED})"))
def _(lake):
    return _list(lake, roots_only=True, status="failed")


@query("c02_trace_list_by_cost", listing(order="c.total_cost DESC NULLS LAST"))
def _(lake):
    return _list(lake, sort="cost_desc")


@query("c02_trace_list_low_quality", listing("e.n_evaluations > 0 AND e.min_score < 0.5"))
def _(lake):
    return _list(lake, quality="low")


@query("b01_org_scope", "SELECT organization_id, count(*) AS n FROM v_traces WHERE organization_id = 'org3' GROUP BY 1")
def _(lake):
    from spanquarry.functions.common import scoped
    return scoped(lake.traces, "org3").groupBy("organization_id").agg(F.count("*").alias("n"))


@query("b02_key_scope", "SELECT organization_id, api_key_prefix, count(*) AS n FROM v_traces WHERE api_key_prefix = 'k1' GROUP BY 1, 2")
def _(lake):
    rows = TL.base_rows(TraceQuery(api_key_prefix="k1"), lake.traces, lake.scans, lake.costs, lake.tag_log)
    return rows.groupBy("organization_id", "api_key_prefix").agg(F.count("*").alias("n"))


@query("b03_run_spans", "SELECT trace_id, root_trace_id, ingested_at FROM v_traces WHERE root_trace_id = 'r77'")
def _(lake):
    rows = TL.base_rows(TraceQuery(root_trace_id="r77"), lake.traces, lake.scans, lake.costs, lake.tag_log)
    return rows.select("trace_id", "root_trace_id", "ingested_at")


@query("b04_roots", f"SELECT organization_id, count(*) AS roots FROM v_traces WHERE {ROOT} GROUP BY 1")
def _(lake):
    return lake.traces.filter(P.is_root()).groupBy("organization_id").agg(F.count("*").alias("roots"))


@query("b05_agent", f"""SELECT organization_id, count(*) AS runs FROM v_traces
WHERE {ROOT} AND agent_key = '2-high' AND agent_kind = 'chain' GROUP BY 1""")
def _(lake):
    return P.by_agent(lake.traces, "2-high", "chain").groupBy("organization_id").agg(F.count("*").alias("runs"))


@query("b05_agent_llm", """SELECT t.organization_id, count(*) AS spans FROM
(SELECT organization_id, trace_id, 1 AS is_root FROM v_traces) t
WHERE (organization_id, trace_id) IN (SELECT (organization_id, trace_id) FROM v_costs WHERE provider || ':' || model = 'OpenAI:model-2')
GROUP BY 1""")
def _(lake):
    # Costs sit on child spans in these tables, so every span is offered as its own root.
    spans = lake.traces.withColumn("is_root", F.lit(1))
    hit = P.by_agent(spans, "OpenAI:model-2", "llm", lake.costs)
    return hit.groupBy("organization_id").agg(F.count("*").alias("spans"))


@query("b06_status", f"""SELECT organization_id, CASE WHEN coalesce(status, '') = 'running' THEN 'running'
  WHEN {BLOCKED} THEN 'blocked' WHEN {FAILED} THEN 'failed' ELSE 'completed' END AS status, count(*) AS n
FROM v_traces GROUP BY 1, 2""")
def _(lake):
    return lake.traces.groupBy("organization_id", P.status_label().alias("status")).agg(F.count("*").alias("n"))


for _status, _pred in (("blocked", BLOCKED), ("failed", FAILED)):
    @query(f"b07_runs_{_status}", f"""WITH hit AS (SELECT DISTINCT organization_id AS o, root_trace_id AS r FROM v_traces WHERE {_pred})
      SELECT organization_id, trace_id FROM v_traces t JOIN hit ON o = organization_id AND r = root_trace_id WHERE {ROOT}""")
    def _(lake, status=_status):
        return P.by_status(lake.traces.filter(P.is_root()), status, lake.traces, True).select(*TRACE_KEY)


@query("b08_integration", "SELECT organization_id, count(*) AS n FROM v_traces WHERE coalesce(integration, '') = 'OPENAI' GROUP BY 1")
def _(lake):
    rows = TL.base_rows(TraceQuery(integration="OPENAI"), lake.traces, lake.scans, lake.costs, lake.tag_log)
    return rows.groupBy("organization_id").agg(F.count("*").alias("n"))


FLAGGED = f"""SELECT organization_id, root_trace_id FROM v_traces WHERE {BLOCKED} UNION
SELECT organization_id, root_trace_id FROM v_scans WHERE security_risk_level IN ('low', 'medium', 'high')"""


@query("b09_flagged_runs", f"""SELECT organization_id, trace_id FROM v_traces WHERE {ROOT}
AND (organization_id, root_trace_id) IN (SELECT (organization_id, root_trace_id) FROM ({FLAGGED}) f)""")
def _(lake):
    q = TraceQuery(roots_only=True, security="flagged")
    return TL.base_rows(q, lake.traces, lake.scans, lake.costs, lake.tag_log).select(*TRACE_KEY)


@query("g03_flagged_set", FLAGGED)
def _(lake):
    return P.flagged_runs(lake.traces, lake.scans)


@query("b10_security_level", f"""WITH s AS ({SCANS}) SELECT coalesce(security_risk_level, '') AS level,
CASE WHEN coalesce(security_risk_level, '') = '' THEN true ELSE false END AS clean, count(*) AS n
FROM v_traces LEFT JOIN s USING (organization_id, trace_id) GROUP BY 1, 2""")
def _(lake):
    rows = lake.traces.join(TL.scan_per_trace(lake.scans), TRACE_KEY, "left")
    level = F.coalesce("security_risk_level", F.lit(""))
    return rows.groupBy(level.alias("level"), P.security_is("clean").alias("clean")).agg(F.count("*").alias("n"))


@query("b11_quality_bands", f"""WITH e AS ({SCORES}) SELECT CASE WHEN coalesce(n_evaluations, 0) = 0 THEN 'none'
  WHEN min_score < 0.5 THEN 'low' WHEN min_score < 0.8 THEN 'medium' ELSE 'high' END AS band, count(*) AS n
FROM v_traces LEFT JOIN e USING (organization_id, trace_id) GROUP BY 1""")
def _(lake):
    rows = lake.traces.join(TL.scores_per_trace(lake.evals), TRACE_KEY, "left")
    return rows.groupBy(P.quality_band().alias("band")).agg(F.count("*").alias("n"))


@query("b12_tags_all", f"""WITH live AS ({LIVE_TAGS}) SELECT organization_id, trace_id FROM v_traces
WHERE (organization_id, trace_id) IN (SELECT (organization_id, trace_id) FROM live WHERE tag = 'tag-1')
  AND (organization_id, trace_id) IN (SELECT (organization_id, trace_id) FROM live WHERE tag = 'tag-2')""")
def _(lake):
    return P.with_tags(lake.traces, lake.tag_log, ["tag-1", "tag-2"]).select(*TRACE_KEY)


@query("b13_windows", """SELECT organization_id,
  count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 MINUTE AND ingested_at <= TIMESTAMP '2001-08-01 00:00:00') AS last_minutes,
  count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 48 HOUR AND ingested_at <= TIMESTAMP '2001-08-01 00:00:00') AS last_hours,
  count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY AND ingested_at <= TIMESTAMP '2001-08-01 00:00:00') AS last_days,
  count(*) FILTER (WHERE ingested_at >= date_trunc('month', TIMESTAMP '2001-07-20 00:00:00')) AS month
FROM v_traces GROUP BY 1""")
def _(lake):
    from spanquarry.functions.common import count_where, moment, trailing
    at = "2001-08-01 00:00:00"
    month = F.col("ingested_at") >= F.date_trunc("month", moment("2001-07-20 00:00:00"))
    return lake.traces.groupBy("organization_id").agg(
        count_where(trailing("ingested_at", at, minutes=90)).alias("last_minutes"),
        count_where(trailing("ingested_at", at, hours=48)).alias("last_hours"),
        count_where(trailing("ingested_at", at, days=30)).alias("last_days"),
        count_where(month).alias("month"),
    )


@query("b15_evaluator_class", """SELECT CASE WHEN evaluator = 'human.feedback' THEN 'feedback' WHEN evaluator LIKE 'human.%' THEN 'human'
  WHEN evaluator = 'auto.security' THEN 'security' ELSE 'judge' END AS class, count(*) AS n FROM v_evals GROUP BY 1""")
def _(lake):
    return lake.evals.groupBy(P.evaluator_class().alias("class")).agg(F.count("*").alias("n"))


@query("b16_audit_search", """SELECT event_id, organization_id, actor, event_type, created_at FROM (
  SELECT event_id, concat('org', event_id % 5) AS organization_id, concat('u', user_id) AS actor, event_type, ts AS created_at FROM events) a
WHERE event_type = 'error' ORDER BY created_at DESC, event_id LIMIT 200 OFFSET 50""")
def _(lake):
    log = lake.raw("events").select(
        "event_id", F.concat(F.lit("org"), F.col("event_id") % 5).alias("organization_id"),
        F.concat(F.lit("u"), "user_id").alias("actor"), "event_type", F.col("ts").alias("created_at"),
    )
    return page_of(P.audit_search(log, event_type="error"), [F.col("created_at").desc(), F.col("event_id")], 200, 50)


@query("b17_search", """SELECT user_id, email, user_type FROM v_users
WHERE (email LIKE '%building%' OR lower(name) LIKE '%building%') AND user_type = 'Team'""")
def _(lake):
    return P.search(lake.users, "BUILDING", ["email", "name"], user_type="Team").select("user_id", "email", "user_type")


@query("b17_search_total", """SELECT count(*) AS total FROM v_users WHERE email LIKE '%99%' OR lower(name) LIKE '%99%'""")
def _(lake):
    return P.search_total(lake.users, "99", ["email", "name"])


@query("b18_has_tag", """WITH live AS (""" + LIVE_TAGS + """)
SELECT organization_id, trace_id FROM live GROUP BY 1, 2 HAVING count(*) FILTER (WHERE tag = 'tag-3') > 0""")
def _(lake):
    live = V.latest(lake.tag_log, [*TRACE_KEY, "tag"], "updated_at", ["event_id"], "deleted")
    tagged = live.groupBy(*TRACE_KEY).agg(F.collect_list("tag").alias("tags"))
    return tagged.filter(P.has_tag("tags", "tag-3")).select(*TRACE_KEY)


@query("b20_trace_record", f"""WITH s AS ({SCANS}), page AS (
  SELECT organization_id, trace_id, ingested_at FROM v_traces WHERE {ROOT}
  ORDER BY ingested_at, organization_id, trace_id LIMIT 500),
m AS (SELECT organization_id, trace_id, metric, evaluator, avg(score) AS score, count(*) AS n FROM v_evals GROUP BY ALL),
e AS (SELECT organization_id, trace_id, string_agg(metric || '/' || evaluator || '/' || n, ',' ORDER BY metric, evaluator) AS scores,
             round(avg(score), 6) AS mean_score FROM m GROUP BY ALL)
SELECT organization_id, trace_id, ingested_at, coalesce(scores, '') AS scores, mean_score,
       security_risk_level AS level, should_block = 1 AS blocked
FROM page LEFT JOIN e USING (organization_id, trace_id) LEFT JOIN s USING (organization_id, trace_id)""")
def _(lake):
    q = TraceQuery(roots_only=True, sort="oldest", limit=500)
    rows = TL.list_traces(q, lake.traces, lake.costs, lake.evals, lake.scans, lake.tag_log)
    record = TL.trace_record(rows, lake.evals)
    size = F.size("evaluations")
    return record.select(
        *TRACE_KEY, "ingested_at",
        F.array_join(F.transform("evaluations", lambda e: F.concat_ws("/", e.metric, e.evaluator, e.n)), ",").alias("scores"),
        F.when(size > 0, F.round(
            F.aggregate("evaluations", F.lit(0.0), lambda a, e: a + e.score) / size, 6)).alias("mean_score"),
        F.col("security.security_risk_level").alias("level"), F.col("security.should_block").alias("blocked"),
    )


@query("c01_page_evaluations", f"""WITH page AS (SELECT organization_id, trace_id FROM v_traces
  WHERE {ROOT} ORDER BY ingested_at, organization_id, trace_id LIMIT 1000)
SELECT e.organization_id, e.trace_id, e.event_id, e.metric, e.evaluator, e.score
FROM v_evals e JOIN page USING (organization_id, trace_id)""")
def _(lake):
    page = page_of(lake.traces.filter(P.is_root()), TL.order_of("oldest"), 1000)
    return TL.page_evaluations(page, lake.evals, 1000).select(
        *TRACE_KEY, "event_id", "metric", "evaluator", "score")


@query("c08_detect_roots", """SELECT t.organization_id, t.trace_id,
  CASE WHEN t.trace_id <> t.root_trace_id AND p.trace_id IS NOT NULL THEN 0 ELSE 1 END AS is_root
FROM v_traces t LEFT JOIN (SELECT DISTINCT trace_id FROM v_traces) p ON t.root_trace_id = p.trace_id""")
def _(lake):
    from spanquarry.operators.agents import detect_roots
    return detect_roots(lake.traces.drop("is_root")).select(*TRACE_KEY, "is_root")


@query("e01_latest_tags", LIVE_TAGS)
def _(lake):
    return V.latest(lake.tag_log, [*TRACE_KEY, "tag"], "updated_at", ["event_id"], "deleted").select(*TRACE_KEY, "tag")


@query("a22_flag_state", """SELECT organization_id, trace_id, status, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY organization_id, trace_id ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM v_flag_log) x WHERE rn = 1""")
def _(lake):
    return V.latest(lake.flag_log, TRACE_KEY, "updated_at", ["event_id"]).select(*TRACE_KEY, "status", "reason")


_VERSIONS = """SELECT user_id AS prompt_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
       event_type AS template, ts AS created_at FROM events"""


def _prompt_log(lake):
    from pyspark.sql import Window
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return lake.raw("events").select(
        F.col("user_id").alias("prompt_id"), F.row_number().over(ordered).alias("version"),
        F.col("event_type").alias("template"), F.col("ts").alias("created_at"),
    )


@query("e06_version_history", _VERSIONS)
def _(lake):
    return V.versions(_prompt_log(lake), ["prompt_id"])


@query("e06_restore", f"""WITH log AS ({_VERSIONS}), top AS (SELECT prompt_id, max(version) AS top FROM log GROUP BY 1)
SELECT prompt_id, top + 1 AS version, template FROM log JOIN top USING (prompt_id) WHERE version = 2""")
def _(lake):
    log = _prompt_log(lake)
    wanted = log.select("prompt_id").distinct().withColumn("version", F.lit(2))
    return V.restore(log, wanted, ["prompt_id"]).select("prompt_id", "version", "template")


@query("e08_next_version", f"""WITH log AS (SELECT * FROM ({_VERSIONS}) v WHERE template <> 'signup'),
top AS (SELECT prompt_id, max(version) AS top FROM log GROUP BY 1),
fresh AS (SELECT user_id AS prompt_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
          FROM events WHERE event_type = 'signup')
SELECT prompt_id, event_id, coalesce(top, 0) + n AS version FROM fresh LEFT JOIN top USING (prompt_id)""")
def _(lake):
    log = _prompt_log(lake).filter(F.col("template") != "signup")
    fresh = lake.raw("events").filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("prompt_id"), "event_id", "ts")
    return V.next_versions(fresh, log, ["prompt_id"], [F.col("ts"), F.col("event_id")]).select(
        "prompt_id", "event_id", "version")


def _leads(lake):
    return lake.raw("events").select(
        "event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "User").otherwise("user"), "user_id", F.lit("@x.example")).alias("email"),
        F.col("event_type").alias("source_page"), F.col("ts").alias("created_at"),
    )


_LEADS = """SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END, user_id, '@x.example') AS email,
  event_type AS source_page, ts AS created_at FROM events"""


@query("a33_insert_if_absent", f"""WITH leads AS ({_LEADS}), old AS (SELECT * FROM leads WHERE created_at < TIMESTAMP '2024-01-02 00:00:00'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY lower(email), source_page ORDER BY created_at, event_id) AS rn
          FROM leads WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00')
SELECT event_id, email, source_page FROM fresh f WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM old o WHERE lower(o.email) = lower(f.email) AND o.source_page = f.source_page)""")
def _(lake):
    from spanquarry.functions.common import moment
    leads, cut = _leads(lake), moment("2024-01-02 00:00:00")
    fresh = leads.filter(F.col("created_at") >= cut)
    out = V.insert_if_absent(fresh, leads.filter(F.col("created_at") < cut),
                             [F.lower("email"), "source_page"], [F.col("created_at"), F.col("event_id")])
    return out.select("event_id", "email", "source_page")


@query("a34_upsert_prompts", """WITH stored AS (
  SELECT p_partkey AS name, p_type AS template, p_type AS default_template, p_size % 3 = 0 AS is_overridden
  FROM part WHERE p_size < 30),
pushed AS (SELECT p_partkey AS name, p_brand AS template, p_brand AS default_template FROM part WHERE p_size > 10)
SELECT coalesce(s.name, p.name) AS name,
  CASE WHEN p.name IS NOT NULL AND NOT coalesce(s.is_overridden, false) THEN p.template ELSE s.template END AS template,
  CASE WHEN p.name IS NOT NULL THEN p.default_template ELSE s.default_template END AS default_template, s.is_overridden
FROM stored s FULL OUTER JOIN pushed p ON s.name = p.name""")
def _(lake):
    part = lake.raw("part")
    stored = part.filter(F.col("p_size") < 30).select(
        F.col("p_partkey").alias("name"), F.col("p_type").alias("template"),
        F.col("p_type").alias("default_template"), (F.col("p_size") % 3 == 0).alias("is_overridden"))
    pushed = part.filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("name"), F.col("p_brand").alias("template"), F.col("p_brand").alias("default_template"))
    return V.upsert(pushed, stored, ["name"], keep={"template": F.col("old_is_overridden")})


@query("f01_latency_order", """SELECT organization_id, trace_id, latency FROM v_traces
ORDER BY latency DESC NULLS LAST, organization_id, trace_id LIMIT 200""")
def _(lake):
    return page_of(lake.traces.select(*TRACE_KEY, "latency"), TL.order_of("latency_desc"), 200)


@query("f02_paging", """SELECT organization_id, trace_id, ingested_at FROM v_traces
ORDER BY ingested_at ASC NULLS LAST, organization_id, trace_id LIMIT 50 OFFSET 150""")
def _(lake):
    return page_of(lake.traces.select(*TRACE_KEY, "ingested_at"), TL.order_of("oldest"), 50, 150)


@query("g02_with_running", f"""WITH page AS (SELECT organization_id, trace_id, ingested_at FROM v_traces WHERE {ROOT}
  ORDER BY ingested_at DESC, organization_id, trace_id LIMIT 300)
SELECT organization_id, trace_id, ingested_at, false AS in_flight FROM page
UNION ALL SELECT organization_id, trace_id, ingested_at, true FROM v_traces t
WHERE {ROOT} AND coalesce(status, '') = 'blocked' AND ingested_at >= TIMESTAMP '2001-07-01 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM page p WHERE p.organization_id = t.organization_id AND p.trace_id = t.trace_id)""")
def _(lake):
    from spanquarry.functions.common import moment
    cols = [*TRACE_KEY, "root_trace_id", "ingested_at"]
    page = page_of(lake.traces.filter(P.is_root()).select(*cols), TL.order_of("newest"), 300)
    live = lake.traces.filter(P.blocked() & (F.col("ingested_at") >= moment("2001-07-01 00:00:00"))).select(*cols)
    return TL.with_running(page, live, offset=0, roots_only=True).select(*TRACE_KEY, "ingested_at", "in_flight")
