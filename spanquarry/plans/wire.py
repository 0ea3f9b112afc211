"""Ingest transforms, table maintenance, alerts (batch forms of the streaming operators)."""
import uuid

from pyspark.sql import functions as F

from spanquarry.functions import ids as I
from spanquarry.functions.common import moment
from spanquarry.operators import alerts as AL
from spanquarry.operators.filters import is_root
from spanquarry.plans.registry import query
from spanquarry.plans.scoring import UUIDS, _rules
from spanquarry.schemas import ALERT_SETTINGS
from spanquarry.sources import otlp as O, tables as TB, tabular as CSV, vendors as VN
from spanquarry.streaming import ingest as IN, topics as TP

TURN = "concat('s', conv_id, '-', turn)"


def _turns(lake):
    return lake.raw("conversations").withColumn("span_id", F.concat(F.lit("s"), "conv_id", F.lit("-"), "turn"))


def _kv(key, value, kind="stringValue"):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


def _payloads(lake):
    """One OTLP payload per conversation turn, every attribute in its wire form."""
    any_ = lambda kind, v: F.struct(
        (v if kind == "s" else F.lit(None).cast("string")).alias("stringValue"), (v if kind == "i" else F.lit(None).cast("string")).alias("intValue"))
    kv = lambda k, kind, v: F.struct(F.lit(k).alias("key"), any_(kind, v).alias("value"))
    tool = F.col("role") == "system"
    attrs = F.array(
        kv("openinference.span.kind", "s", F.when(tool, "TOOL").otherwise("LLM")), kv("llm.model_name", "s", F.concat(F.lit("model-"), F.col("conv_id") % 3)),
        kv("llm.input_messages.10.message.content", "s", F.lit("last")), kv("llm.input_messages.10.message.role", "s", F.lit("assistant")),
        kv("llm.input_messages.2.message.role", "s", F.col("role")), kv("llm.input_messages.2.message.content", "s", F.col("text")),
        kv("llm.token_count.total", "i", F.length("text").cast("string")), kv("output.value", "s", F.concat(F.lit("re: "), "text")),
        kv("tool.name", "s", F.lit("lookup")), kv("tool.parameters", "s", F.lit('{"q":1}')),
        kv("llm.output_messages.0.message.tool_calls.0.tool_call.function.name", "s", F.lit("find")),
        kv("llm.output_messages.0.message.tool_calls.0.tool_call.function.arguments", "s", F.lit("{}")))
    span = F.struct(F.col("span_id").alias("spanId"), F.concat(F.lit("v"), "conv_id").alias("traceId"),
                    F.when(F.col("turn") > 0, F.concat(F.lit("s"), "conv_id", F.lit("-0"))).alias("parentSpanId"), F.lit("step").alias("name"), attrs.alias("attributes"))
    doc = F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return _turns(lake).select(F.to_json(doc).alias("payload"))


@query("a03_otlp_spans", f"SELECT {TURN} AS span_id, CAST(0 AS INTEGER) AS pos FROM conversations")
def _(lake):
    return O.payload_spans(_payloads(lake)).select(F.try_variant_get("span", "$.spanId", "string").alias("span_id"), "pos")


@query("a04_otlp_attributes", f"SELECT {TURN} AS span_id, concat('model-', conv_id % 3) AS model, CAST(length(text) AS BIGINT) AS total, 12 AS n FROM conversations")
def _(lake):
    rows = O.payload_spans(_payloads(lake)).withColumn("a", O.otlp_attrs(F.try_variant_get("span", "$.attributes", "variant")))
    return rows.select(F.try_variant_get("span", "$.spanId", "string").alias("span_id"), O.attr_text("a", "llm.model_name").alias("model"),
                       F.try_variant_get(O.attr("a", "llm.token_count.total"), "$", "bigint").alias("total"), F.size("a").alias("n"))


EVENTS = f"""SELECT {TURN} AS trace_id, concat('v', conv_id) AS root_trace_id, CASE WHEN turn > 0 THEN concat('s', conv_id, '-0') END AS parent_id,
  CASE role WHEN 'system' THEN 'tool' ELSE 'llm' END AS type, CASE role WHEN 'system' THEN 'lookup' ELSE 'step' END AS function,
  CASE role WHEN 'system' THEN NULL ELSE concat('model-', conv_id % 3) END AS model, concat('re: ', text) AS response, CASE WHEN role <> 'system' THEN length(text) END AS total,
  CASE role WHEN 'system' THEN concat({TURN}, '/lookup/{{"q":1}}') ELSE 'llm.output_messages.0.message.tool_calls.0/find/{{}}' END AS calls,
  concat(role, ':', text, '|assistant:last') AS messages FROM conversations"""


@query("a06_spans_to_events", EVENTS)
def _(lake):
    from spanquarry.functions.scalars import text_of
    e = O.spans_to_events(O.payload_spans(_payloads(lake)), "phoenix")
    call = F.get("tool_calls", F.lit(0))
    return e.select("trace_id", "root_trace_id", "parent_id", "type", "function", "model", "response", F.col("tokens.total").alias("total"),
                    F.concat_ws("/", call["id"], call["name"], call["arguments"]).alias("calls"),
                    F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), text_of(m.content))), "|").alias("messages"))


@query("a05_flat_spans", f"SELECT {TURN} AS trace_id, {TURN} AS root_trace_id, CASE WHEN length(text) > 0 THEN text ELSE '' END AS input, 'chain' AS type FROM conversations WHERE NOT regexp_matches(trim(text), '^[\\[{{]')")
def _(lake):
    attrs = F.map_from_arrays(F.array(F.lit("input.value")), F.array("text"))
    span = F.struct("span_id", F.lit("custom").alias("span_kind"), attrs.alias("attributes"))
    rows = _turns(lake).filter(~F.trim("text").rlike(r"^[\[{]")).select(F.to_json(F.struct(F.array(span).alias("spans"))).alias("payload"))
    return O.spans_to_events(O.payload_spans(rows), "x").select("trace_id", "root_trace_id", "input", "type")


@query("a07_media_messages", f"SELECT {TURN} AS span_id, concat('look', '|', substr(sha256(concat('http://x/', turn)), 1, 16)) AS parts FROM conversations")
def _(lake):
    base = "m.0.message.contents"
    keys = ["m.0.message.role", f"{base}.1.message_content.image.image.url", f"{base}.0.message_content.text", f"{base}.0.message_content.type"]
    values = [F.lit("user"), F.concat(F.lit("http://x/"), "turn"), F.lit("look"), F.lit("text")]
    attrs = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.parse_json(F.to_json(F.struct(v.alias("v")))) for v in values]))
    attrs = F.transform_values(attrs, lambda _, v: F.try_variant_get(v, "$.v", "variant"))
    content = F.get(O.collect_messages(attrs, "m"), F.lit(0))["content"]
    get = lambda p: F.try_variant_get(content, p, "string")
    return _turns(lake).select("span_id", F.concat_ws("|", get("$[0].text"), get("$[1]._media_ref.sha256")).alias("parts"))


@query("a08_tools", f"SELECT {TURN} AS span_id, 'alpha,beta' AS tools FROM conversations")
def _(lake):
    v = lambda c: F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")
    schema = lambda n: F.concat(F.lit('{"name":"'), F.lit(n), F.lit('"}'))
    attrs = F.map_from_arrays(F.array(F.lit("llm.tools.10.tool.json_schema"), F.lit("llm.tools.9.tool.json_schema")), F.array(v(schema("beta")), v(schema("alpha"))))
    names = F.transform(O.collect_tools(attrs), lambda t: F.try_variant_get(t, "$.name", "string"))
    return _turns(lake).select("span_id", F.array_join(names, ",").alias("tools"))


@query("a09_premapped", f"SELECT {TURN} AS trace_id, {TURN} AS root_trace_id, 'puller' AS source FROM conversations WHERE turn > 0")
def _(lake):
    ev = F.struct(F.when(F.col("turn") > 0, F.col("span_id")).alias("trace_id"), F.lit("llm").alias("type"))
    rows = _turns(lake).select(F.to_json(F.struct(F.array(ev).alias("events"))).alias("payload"))
    return O.premapped_events(rows, "puller").select("trace_id", "root_trace_id", "source")


@query("a10_langsmith_runs", f"""SELECT {TURN} AS trace_id, 'llm' AS type, turn % 2 = 0 AS success, text AS response, 'gpt' AS model, role AS first_role, CAST(turn AS BIGINT) AS total, 'f' AS call FROM conversations""")
def _(lake):
    msg = F.struct(F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("m"))
    run = F.struct(
        F.col("span_id").alias("id"), F.lit("chat").alias("run_type"), F.lit("r").alias("name"), F.when(F.col("turn") % 2 == 1, "boom").alias("error"),
        F.struct(F.array(F.array(F.struct("role", F.col("text").alias("content")))).alias("messages")).alias("inputs"),
        F.struct(F.col("text").alias("output"), F.struct(F.struct(F.col("turn").alias("total_tokens")).alias("token_usage")).alias("llm_output"),
                 F.struct(F.array(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("args"))).alias("tool_calls")).alias("deep")).alias("outputs"),
        F.struct(F.struct(F.lit("gpt").alias("model_name")).alias("invocation_params")).alias("extra"))
    e = VN.langsmith_runs_to_events(_turns(lake).select(F.parse_json(F.to_json(run)).alias("run")))
    return e.select("trace_id", "type", "success", "response", "model", F.get("messages", F.lit(0))["role"].alias("first_role"),
                    F.col("tokens.total").alias("total"), F.get("tool_calls", F.lit(0))["name"].alias("call"))


@query("a11_braintrust_spans", f"""SELECT {TURN} AS trace_id, concat('v', conv_id) AS root_trace_id, CASE WHEN turn > 0 THEN 'tool' ELSE 'chain' END AS type, text AS response FROM conversations""")
def _(lake):
    span = F.struct(F.col("span_id"), F.concat(F.lit("v"), "conv_id").alias("root_span_id"), F.struct(F.when(F.col("turn") > 0, "function").otherwise("score").alias("type")).alias("span_attributes"),
                    F.col("text").alias("input"), F.col("text").alias("output"))
    return VN.braintrust_spans_to_events(_turns(lake).select(F.parse_json(F.to_json(span)).alias("span"))).select("trace_id", "root_trace_id", "type", "response")


@query("a12_coerce_messages", f"""SELECT {TURN} AS span_id, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'system' END AS role, text AS content FROM conversations""")
def _(lake):
    t = F.col("turn") % 3
    kw = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("kwargs"), F.array(F.lit("x"), F.when(t == 1, "AIMessage").otherwise("SystemMessage")).alias("id")))
    raw = F.when(t == 0, F.to_json(F.struct(F.col("text").alias("question")))).otherwise(kw)
    m = F.get("m", F.lit(0))
    return _turns(lake).withColumn("m", VN.coerce_messages(raw)).select("span_id", m["role"].alias("role"), m["content"].alias("content"))


@query("a13_find_tool_calls", f"""SELECT {TURN} AS span_id, 'f:call_0:{{"a": 1}}' AS call FROM conversations WHERE turn % 2 = 0""")
def _(lake):
    raw = F.when(F.col("turn") % 2 == 0, '{"x": [{"y": {"tool_calls": [{"name": "f", "args": {"a": 1}}, {"id": "nameless"}]}}]}').otherwise('{"tool_calls": []}')
    c = F.get("c", F.lit(0))
    rows = _turns(lake).withColumn("c", VN.find_tool_calls(raw)).filter(F.col("c").isNotNull())
    return rows.select("span_id", F.concat_ws(":", c["name"], c["id"], c["arguments"]).alias("call"))


@query("a16_rows_to_examples", """SELECT trim(p_name) AS input, nullif(trim(p_type), 'ECONOMY') AS expected_output, p_brand AS brand FROM part WHERE p_partkey % 4 <> 0""")
def _(lake):
    sheet = lake.raw("part").select(
        F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.col("p_name")).alias("Question"),
        F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.col("p_type")).alias("Answer"), F.col("p_brand").alias("Brand"), F.lit(" ").alias("Blank"))
    pick = CSV.suggest_columns(sheet.columns)
    out = CSV.rows_to_examples(sheet, pick["input"], pick["expected_output"], "part.csv")
    return out.filter(F.size("columns") == 1).select("input", "expected_output", F.col("columns")["Brand"].alias("brand"))


@query("a18_evaluation_rows", """SELECT organization_id, trace_id, metric, round(avg(score), 6) AS score FROM v_evals GROUP BY 1, 2, 3""")
def _(lake):
    m = lake.evals.groupBy("organization_id", "trace_id", "metric").agg(F.avg("score").alias("s"))
    maps = m.groupBy("organization_id", "trace_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "s"))).alias("results"))
    return TB.evaluation_rows(maps, "judge").select("organization_id", "trace_id", "metric", F.round("score", 6).alias("score"))


@query("a19_human_scores", "SELECT trace_id, trace_id AS root_trace_id, 'human.annotation' AS evaluator, metric, score FROM v_evals WHERE evaluator = 'human.annotation'")
def _(lake):
    rows = lake.evals.filter(F.col("evaluator") == "human.annotation").withColumns({"details": F.lit("{}"), "root_trace_id": F.lit(None).cast("string")})
    return TB.human_score_rows(rows).select("trace_id", "root_trace_id", "evaluator", "metric", "score")


@query("a20_feedback", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN least(1.0, greatest(0.0, value / 10))::DOUBLE END AS score,
  CASE event_id % 3 WHEN 0 THEN 'user_feedback' WHEN 1 THEN event_type ELSE '9bad' END AS name, event_id % 4 <> 3 AND event_id % 3 <> 2 AS valid FROM events""")
def _(lake):
    i = F.col("event_id")
    value = F.when(i % 4 == 0, "True").when(i % 4 == 1, "false").when(i % 4 == 2, (F.col("value") / 10).cast("string")).otherwise("great")
    name = F.when(i % 3 == 0, " ").when(i % 3 == 1, F.upper("event_type")).otherwise("9bad")
    name = F.when(i % 3 == 0, F.lit(None)).otherwise(name)
    rows = lake.raw("events").select("event_id", value.alias("value"), name.alias("name"), F.lit(" x ").alias("comment"))
    return TB.coerce_feedback(rows).select("event_id", "score", "name", "valid")


@query("a21_audit_types", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'auth_register' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'api_key_deleted' WHEN event_type = 'click' THEN 'api_key_created' ELSE 'api_request' END AS event_type FROM events""")
def _(lake):
    t = F.col("event_type")
    rows = lake.raw("events").select(
        "event_id", F.when((t == "click") & (F.col("event_id") % 2 == 0), "DELETE").otherwise("POST").alias("http_method"), F.lit("org0").alias("organization_id"), F.lit("u").alias("actor"),
        F.when(t == "signup", "/auth/register/x").when(t == "click", "/api-keys/7").otherwise("/metrics").alias("http_path"), F.col("ts").alias("created_at"))
    return TB.audit_rows(rows, "secret").select("event_id", "event_type")


@query("a25_retention", """SELECT organization_id, count(*) AS kept FROM v_traces WHERE organization_id IN ('org1', 'org2') OR ingested_at + INTERVAL 14 DAY > TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1""")
def _(lake):
    from spanquarry.functions.common import lookup
    org = F.col("organization_id")
    tiers = lake.traces.select("organization_id").distinct().filter(org != "org4").withColumn("tier", lookup({"org0": "Free", "org1": "Team", "org2": "Growth", "org3": "Trial"}, org))
    kept = TB.expire(TB.stamp_retention(lake.traces, tiers), "2001-08-01 00:00:00")
    return kept.groupBy("organization_id").agg(F.count("*").alias("kept"))


@query("a26_audit_retention", "SELECT event_id FROM events WHERE ts + INTERVAL 10 YEAR > TIMESTAMP '2034-01-11 12:00:00'")
def _(lake):
    return TB.expire_audit(lake.raw("events").withColumnRenamed("ts", "created_at"), "2034-01-11 12:00:00").select("event_id")


@query("a28_erase_org", "SELECT organization_id, count(*) AS n FROM v_costs WHERE organization_id <> 'org2' GROUP BY 1")
def _(lake):
    return TB.erase_org(lake.costs, "org2").groupBy("organization_id").agg(F.count("*").alias("n"))


@query("a31_resource_push", """WITH o AS (SELECT concat('org', p_partkey % 3) AS organization_id, 'prompt' AS resource, concat('s', p_partkey) AS k, p_brand AS kind FROM part WHERE p_size <= 30),
n AS (SELECT concat('org', p_partkey % 3) AS organization_id, 'prompt' AS resource, concat('s', p_partkey) AS k, CASE WHEN p_size % 4 = 0 THEN 'other' ELSE p_brand END AS kind FROM part WHERE p_size >= 20)
SELECT organization_id, resource, k AS key, CASE WHEN n.kind IS NULL THEN 'kept' WHEN o.kind IS NULL THEN 'created' WHEN o.kind <> n.kind THEN 'error' ELSE 'updated' END AS action FROM n FULL JOIN o USING (organization_id, resource, k)""")
def _(lake):
    base = lake.raw("part").select("p_size", F.concat(F.lit("org"), F.col("p_partkey") % 3).alias("organization_id"), F.lit("prompt").alias("resource"), F.concat(F.lit("s"), "p_partkey").alias("key"), F.col("p_brand").alias("kind"))
    old = base.filter(F.col("p_size") <= 30)
    new = base.filter(F.col("p_size") >= 20).withColumns({"kind": F.when(F.col("p_size") % 4 == 0, "other").otherwise(F.col("kind")), "key": F.upper("key")})
    return TB.plan_resource_push(old.drop("p_size"), new.drop("p_size")).select("organization_id", "resource", "key", "action")


# -- ingest routing -----------------------------------------------------------

def _raw_events(lake):
    t = lake.traces.filter(is_root())
    i = F.substring("trace_id", 2, 20).cast("bigint")
    config = F.when(i % 4 == 0, F.struct(F.array(F.lit("m1")).alias("metrics")))
    doc = F.struct("trace_id", "root_trace_id", F.when(i % 5 == 0, "vectorstore").otherwise("llm").alias("type"), F.when(i % 5 == 0, "query").alias("api"), "integration", "model",
                   F.when(i % 7 == 0, "running").alias("status"), F.when(i % 3 == 0, True).alias("_eval"), config.alias("_eval_config"),
                   F.when(i % 6 == 0, F.struct(F.lit("default").alias("guardrail"))).alias("_security_config"), F.array(F.lit(" Tag-A"), F.lit("tag-a"), F.lit("?")).alias("_tags"),
                   F.struct(F.lit("eu").alias("region"), F.array(F.lit(1)).alias("nested")).alias("_metadata"))
    return t.select("organization_id", "api_key_prefix", F.to_json(doc).alias("event"), i.alias("i"), (F.col("organization_id") == "org3").alias("eval_over"))


def _routed(lake):
    return IN.route_events(IN.normalize_events(_raw_events(lake)), _rules(lake))


@query("a01_normalize_events", """SELECT o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 THEN 'vectorstore' ELSE 'llm' END AS type, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AS eval_enabled, 'tag-a' AS tags, 'eu' AS region, false AS has_control FROM orders""")
def _(lake):
    e = IN.normalize_events(_raw_events(lake))
    doc = F.parse_json("event")
    return e.select("i", "type", "eval_enabled", F.array_join("tags", ",").alias("tags"), F.try_variant_get(doc, "$.user_metadata.region", "string").alias("region"),
                    F.contains("event", F.lit('"_')).alias("has_control"))


@query("j01_route_events", """SELECT o_orderkey AS i, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 3 AND ((o_orderkey % 5 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0)) OR (o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0)) THEN true ELSE false END AS inline,
  o_orderkey % 7 <> 0 AND o_orderkey % 6 = 0 AS secure, o_orderkey % 7 <> 0 AND o_orderkey % 5 = 3 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) AS eval_skipped FROM orders""")
def _(lake):
    r = _routed(lake)
    return r.select("i", (F.array_contains("routes", "evaluate") & F.col("rule").isNull()).alias("inline"), F.array_contains("routes", "secure").alias("secure"), "eval_skipped")


BUCKET = "CAST(CAST('0x' || substr(sha256('{r}:' || uuid), 1, 4) AS BIGINT) AS DOUBLE) / 65535 * 100"
RULED = f"""SELECT * FROM (SELECT *, CASE WHEN organization_id = 'org0' AND {BUCKET.format(r='r1')} < 10 THEN 'r1'
  WHEN organization_id = 'org0' AND integration = 'OPENAI' AND {BUCKET.format(r='r2')} < 40 THEN 'r2'
  WHEN organization_id = 'org1' AND model IN ('model-1', 'model-2') AND {BUCKET.format(r='r5')} < 25 THEN 'r5'
  WHEN organization_id = 'org2' AND integration = 'ANTHROPIC' THEN 'r7' END AS rule_id
  FROM (SELECT *, CAST(substr(trace_id, 2, 20) AS BIGINT) AS i FROM ({UUIDS}) u WHERE trace_id = root_trace_id) t
  WHERE i % 5 <> 0 AND i % 4 <> 0 AND i % 7 <> 0 AND organization_id <> 'org3') s WHERE rule_id IS NOT NULL"""


@query("j09_online_scoring", f"SELECT i, rule_id FROM ({RULED}) r")
def _(lake):
    return _routed(lake).filter(F.col("rule").isNotNull()).select("i", F.col("rule.rule_id").alias("rule_id"))


# -- alerts ------------------------------------------------------------------

SETTINGS = [
    ("org0", "hook", "hourly", True, [], 0.5, 40.0, True, ["high", "medium"], [], False), ("org1", "hook", "daily", True, ["m1"], 0.3, 25.0, True, ["high"], ["jailbreak"], True),
    ("org2", None, "daily", True, [], 0.9, 1.0, True, ["high"], [], False), ("org3", "hook", "realtime", False, [], 0.9, 1.0, False, ["high"], [], False),
]
SQL_SETTINGS = """st(organization_id, digest, below, rate) AS (VALUES ('org0', 'hourly', 0.5::DOUBLE, 40.0::DOUBLE), ('org1', 'daily', 0.3::DOUBLE, 25.0::DOUBLE)),
w AS (SELECT v_evals.*, digest, below, rate, score < below AS failed FROM v_evals JOIN st USING (organization_id) WHERE organization_id = 'org0' OR metric = 'm1')"""


def _settings(lake):
    return lake.spark.createDataFrame(SETTINGS, ALERT_SETTINGS)


def _watched(lake):
    return AL.watched_evals(lake.evals, _settings(lake))


@query("j04_eval_alerts", f"WITH {SQL_SETTINGS} SELECT event_id, concat('Eval `', metric, '` scored ', printf('%.2f', score), ' (< ', printf('%.2f', below), ')') AS summary FROM w WHERE failed")
def _(lake):
    return AL.eval_alerts(_watched(lake)).select("event_id", "summary")


RATES = f"""{SQL_SETTINGS}, r AS (SELECT *, count(*) OVER x AS samples, sum(failed::INT) OVER x * 100.0::DOUBLE / count(*) OVER x AS failure_rate FROM w
  WINDOW x AS (PARTITION BY organization_id, metric ORDER BY ingested_at, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query("e04_failure_rate", f"WITH {RATES} SELECT event_id, samples, round(failure_rate, 6) AS failure_rate FROM r")
def _(lake):
    return AL.failure_rate(_watched(lake), piece=50).select("event_id", "samples", F.round("failure_rate", 6).alias("failure_rate"))


@query("j05_rate_breaches", f"WITH {RATES} SELECT event_id FROM r WHERE samples >= 10 AND failure_rate > rate")
def _(lake):
    return AL.rate_breaches(AL.failure_rate(_watched(lake))).select("event_id")


@query("e05_cooldown", f"""WITH RECURSIVE {RATES}, b AS (SELECT DISTINCT organization_id, metric, ingested_at FROM r WHERE samples >= 10 AND failure_rate > rate),
f(organization_id, metric, ingested_at) AS (SELECT organization_id, metric, min(ingested_at) FROM b GROUP BY ALL
  UNION ALL SELECT f.organization_id, f.metric, min(b.ingested_at) FROM f JOIN b ON b.organization_id = f.organization_id AND b.metric = f.metric AND b.ingested_at >= f.ingested_at + INTERVAL 10 MINUTE GROUP BY 1, 2)
SELECT organization_id, metric, ingested_at FROM f""")
def _(lake):
    return AL.with_cooldown(AL.rate_breaches(AL.failure_rate(_watched(lake))), ["organization_id", "metric"])


SEC = """SELECT event_id, concat('Security ', CASE should_block WHEN 1 THEN 'blocked' ELSE 'flagged' END, ': ', security_risk_level, ' (', coalesce(nullif(concat_ws(', ', CASE WHEN injection_detected = 1 THEN 'prompt_injection' END,
  CASE WHEN jailbreak_detected = 1 THEN 'jailbreak' END, CASE WHEN secrets_detected = 1 THEN 'secrets_detected' END), ''), 'unknown'), ')') AS summary, organization_id, ingested_at FROM v_scans
WHERE (organization_id = 'org0' AND security_risk_level IN ('high', 'medium')) OR (organization_id = 'org1' AND security_risk_level = 'high' AND should_block = 1 AND jailbreak_detected = 1)"""


@query("j06_security_alerts", f"SELECT event_id, summary FROM ({SEC}) s")
def _(lake):
    return AL.security_alerts(lake.scans, _settings(lake)).select("event_id", "summary")


@query("j07_alert_digest", f"""SELECT organization_id, time_bucket(INTERVAL 1 HOUR, ingested_at) AS window_start, count(*) AS events, arg_min(summary, (ingested_at, event_id)) AS first_line FROM ({SEC}) s WHERE organization_id = 'org0' GROUP BY 1, 2""")
def _(lake):
    d = AL.alert_digest(AL.security_alerts(lake.scans, _settings(lake)), "hourly", tie=["event_id"], most=40)
    return d.select("organization_id", "window_start", "events", F.get("lines", F.lit(0)).alias("first_line"))


def _feed(lake):
    t = F.col("event_type")
    return lake.raw("events").select(
        "event_id", F.concat(F.lit("org"), F.col("event_id") % 5).alias("organization_id"), F.concat(F.lit("k"), F.col("user_id") % 3).alias("api_key_prefix"),
        F.concat(F.lit("u"), "user_id").alias("trace_id"), F.when(t == "error", "persisted").when(t == "signup", "enriched").when(t == "view", "started").otherwise("note").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "evaluation").otherwise("security").alias("enrichment"), F.lit("{}").alias("event"), "ts")


@query("j02_running_traces", """SELECT organization_id, trace_id, event_id FROM (SELECT concat('org', event_id % 5) AS organization_id, concat('u', user_id) AS trace_id, event_id, event_type, ts,
  row_number() OVER (PARTITION BY event_id % 5, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'signup', 'error') AND ts <= TIMESTAMP '2024-01-20 00:00:00') x
WHERE rn = 1 AND event_type = 'view' AND ts >= TIMESTAMP '2024-01-19 00:00:00'""")
def _(lake):
    return AL.running_traces(_feed(lake), "2024-01-20 00:00:00", 86400).select("organization_id", "trace_id", "event_id")


@query("j03_live_feed", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'trace.enriched' WHEN 'view' THEN 'trace.started' ELSE 'trace' END AS event_name FROM events WHERE event_id % 5 = 2 AND user_id % 3 = 1""")
def _(lake):
    return TP.live_feed(_feed(lake), "org2", "k1").select("event_id", "event_name")


@query("b21_enriched", "SELECT event_id FROM events WHERE event_type = 'signup' AND event_id % 2 = 0")
def _(lake):
    return TP.enriched(_feed(lake), "evaluation").select("event_id")
