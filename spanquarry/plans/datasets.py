"""Datasets, trajectories, judging jobs."""
from pyspark.sql import functions as F

from spanquarry.functions import scalars as S
from spanquarry.functions.common import page_of
from spanquarry.operators import datasets as D, judging as J, trajectories as TJ
from spanquarry.operators.filters import is_root
from spanquarry.plans.registry import query

RUN = TJ.RUN


def _spans(lake):
    return lake.traces.withColumn("seq", F.col("trace_id"))


TREE = """WITH RECURSIVE t AS (SELECT organization_id, root_trace_id, trace_id, parent_id FROM v_traces),
walk AS (SELECT t.*, 0 AS depth, trace_id AS path FROM t WHERE parent_id IS NULL
  UNION ALL SELECT t.*, depth + 1, path || '/' || t.trace_id FROM t JOIN walk ON t.root_trace_id = walk.root_trace_id AND t.parent_id = walk.trace_id)
SELECT root_trace_id, trace_id, depth, path FROM walk"""


@query("k04_trajectory_steps", TREE)
def _(lake):
    steps = TJ.trajectory_steps(_spans(lake))
    return steps.select("root_trace_id", "trace_id", "depth", F.array_join("path", "/").alias("path"))


@query("c21_parents", "SELECT root_trace_id, trace_id AS span_id, parent_id AS parent FROM v_traces")
def _(lake):
    return TJ.parents(_spans(lake)).select("root_trace_id", "span_id", "parent")


IO = """(SELECT organization_id, root_trace_id, trace_id, CASE WHEN is_root = 0 AND model <> 'model-1' THEN trace_id ELSE ' ' END AS input,
  CASE WHEN is_root = 0 AND integration = 'OPENAI' THEN model ELSE '' END AS output FROM v_traces)"""


def _io(lake):
    child = F.col("is_root") == 0
    return lake.traces.select(
        *RUN, "trace_id", F.when(child & (F.col("model") != "model-1"), F.col("trace_id")).otherwise(" ").alias("input"),
        F.when(child & (F.col("integration") == "OPENAI"), F.col("model")).otherwise("").alias("output"), F.col("trace_id").alias("seq"))


RUN_IO = f"""SELECT organization_id, root_trace_id, arg_min(input, trace_id) FILTER (WHERE trim(input) <> '') AS input,
  arg_max(output, trace_id) FILTER (WHERE output <> '') AS output FROM {IO} s GROUP BY 1, 2"""


@query("k02_trajectory_io", RUN_IO)
def _(lake):
    return TJ.trajectory_io(_io(lake))


@query("k03_root_event", """SELECT organization_id, root_trace_id, trace_id, latency FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, root_trace_id
  ORDER BY (trace_id = root_trace_id) DESC, trace_id) AS rn FROM v_traces WHERE latency > 1 OR is_root = 0) x WHERE rn = 1""")
def _(lake):
    rows = _spans(lake).filter((F.col("latency") > 1) | (F.col("is_root") == 0))
    return TJ.root_event(rows).select(*RUN, "trace_id", "latency")


@query("a23_pin_trajectories", """SELECT organization_id, trace_id FROM v_traces WHERE (organization_id, root_trace_id) IN (SELECT (organization_id, root_trace_id) FROM v_scans WHERE should_block = 1)""")
def _(lake):
    runs = lake.scans.filter(F.col("should_block") == 1)
    return TJ.pin_trajectories(lake.traces, runs, F.lit("2024-02-01")).select("organization_id", "trace_id")


@query("a24_read_trajectories", """SELECT organization_id, root_trace_id, trace_id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, root_trace_id, trace_id ORDER BY captured_at DESC) AS rn FROM (
  SELECT organization_id, root_trace_id, trace_id, '2024-02-01' AS captured_at FROM v_traces UNION ALL SELECT organization_id, root_trace_id, trace_id, '2024-03-01' FROM v_traces WHERE integration = 'OPENAI') p) x WHERE rn = 1""")
def _(lake):
    once = TJ.pin_trajectories(lake.traces, lake.traces, F.lit("2024-02-01"))
    again = TJ.pin_trajectories(lake.traces.filter(F.col("integration") == "OPENAI"), lake.traces, F.lit("2024-03-01"))
    return TJ.read_trajectories(once.unionByName(again)).select(*RUN, "trace_id", "captured_at")


@query("c22_new_runs", """SELECT organization_id, trace_id FROM v_traces t WHERE (is_root = 1 OR trace_id = root_trace_id) AND NOT EXISTS (SELECT 1 FROM v_examples e WHERE e.source_trace_id = t.trace_id)""")
def _(lake):
    return D.new_runs(lake.traces.filter(is_root()), lake.examples).select("organization_id", "trace_id")


@query("c25_route_runs", """SELECT t.organization_id, t.trace_id, l.dataset_id FROM v_traces t JOIN (SELECT DISTINCT concat('org', c_custkey % 5) AS organization_id, CASE c_custkey % 3 WHEN 0 THEN '2-high' WHEN 1 THEN '5-low' ELSE '1-urgent' END AS agent_key,
  CASE c_custkey % 2 WHEN 0 THEN 'chain' ELSE 'function' END AS agent_kind, c_mktsegment AS dataset_id FROM customer) l USING (organization_id, agent_key, agent_kind) WHERE (is_root = 1 OR trace_id = root_trace_id)""")
def _(lake):
    c = F.col("c_custkey")
    links = lake.raw("customer").select(
        F.concat(F.lit("org"), c % 5).alias("organization_id"), F.when(c % 3 == 0, "2-high").when(c % 3 == 1, "5-low").otherwise("1-urgent").alias("agent_key"),
        F.when(c % 2 == 0, "chain").otherwise("function").alias("agent_kind"), F.col("c_mktsegment").alias("dataset_id")).distinct()
    return D.route_runs(lake.traces.filter(is_root()), links).select("organization_id", "trace_id", "dataset_id")


def _events(lake):
    """One event per conversation turn, as a variant, with calls of every shape on some."""
    i = F.col("conv_id")
    call = F.struct(F.struct(F.lit("lookup").alias("name"), F.to_json(F.struct("turn")).alias("arguments")).alias("function"), F.lit("c1").alias("id"))
    mcp = F.struct(F.lit("fetch").alias("name"), F.lit("docs").alias("server_label"), F.struct("turn").alias("arguments"), F.col("text").alias("output"))
    doc = F.struct(
        F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("trace_id"), F.when(F.col("role") == "system", "tool").otherwise("llm").alias("type"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.when(F.col("role") == "system", F.col("text")).alias("output"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("response"), F.concat(F.lit("model-"), i % 3).alias("model"), F.lit("search").alias("name"),
        F.when(i % 2 == 0, F.array(call)).alias("tool_calls"), F.when(i % 5 == 0, F.array(mcp)).alias("mcp_calls"),
        F.when(i % 3 == 0, F.concat(F.lit("planner-"), i % 2)).alias("agent"))
    return lake.raw("conversations").select(
        F.lit("org0").alias("organization_id"), F.concat(F.lit("v"), "conv_id").alias("root_trace_id"), F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("trace_id"),
        "conv_id", F.col("turn").alias("seq"), "role", "text", F.parse_json(F.to_json(doc)).alias("event"))


STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("h19_question_of", f"SELECT conv_id, turn AS seq, CASE WHEN role = 'user' AND {STRIPPED} <> '' THEN text ELSE '' END AS question FROM conversations")
def _(lake):
    return _events(lake).select("conv_id", "seq", S.question_of("event").alias("question"))


def _examples(rows):
    return rows.select("conv_id", "seq", S.event_input("event").alias("input"), S.event_output("event").alias("expected"),
                       S.event_metadata("event")["model"].alias("model"))


@query("h20_event_to_example_all", """SELECT conv_id, turn AS seq, concat('[{"content":', to_json(text), ',"role":"', role, '"}]') AS input, CASE WHEN role IN ('system', 'assistant') THEN text END AS expected,
  concat('model-', conv_id % 3) AS model FROM conversations""")
def _(lake):
    return _examples(_events(lake))


@query("h20_event_to_example", """SELECT conv_id, turn AS seq, concat('[{"content":', to_json(text), ',"role":"', role, '"}]') AS input, CASE WHEN role IN ('system', 'assistant') THEN text END AS expected,
  concat('model-', conv_id % 3) AS model FROM conversations WHERE NOT regexp_matches(text, '[^ -~]')""")
def _(lake):
    return _examples(_events(lake).filter(~F.col("text").rlike("[^ -~]")))


@query("h21_step_agent", "SELECT conv_id, turn AS seq, CASE WHEN conv_id % 3 = 0 THEN concat('planner-', conv_id % 2) END AS agent FROM conversations")
def _(lake):
    return _events(lake).select("conv_id", "seq", S.step_agent("event").alias("agent"))


@query("k05_tool_calls", """SELECT conv_id, turn AS seq, concat_ws(',', CASE WHEN conv_id % 2 = 0 THEN concat('tool/lookup/{"turn":', turn, '}') END, CASE WHEN conv_id % 5 = 0 THEN concat('mcp/fetch/{"turn":', turn, '}') END) AS calls FROM conversations""")
def _(lake):
    calls = F.transform(TJ.tool_calls("event"), lambda c: F.concat_ws("/", c["kind"], c["name"], c["arguments"]))
    return _events(lake).select("conv_id", "seq", F.array_join(calls, ",").alias("calls"))


@query("d43_trajectory_stats", """WITH c AS (SELECT concat('v', conv_id) AS root_trace_id, conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE 'llm' END AS type FROM conversations),
y AS (SELECT root_trace_id, string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM (SELECT root_trace_id, type, count(*) AS n FROM c GROUP BY 1, 2) x GROUP BY 1)
SELECT root_trace_id, count(*) AS spans, CAST(sum(CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tools, CAST(sum(CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS mcp,
  any_value(CASE WHEN conv_id % 3 = 0 THEN concat('planner-', conv_id % 2) ELSE '' END) AS agents, any_value(concat('model-', conv_id % 3)) AS models, any_value(types) AS types FROM c JOIN y USING (root_trace_id) GROUP BY 1""")
def _(lake):
    s = TJ.trajectory_stats(TJ.display_steps(_events(lake).drop("text")))
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return s.select("root_trace_id", "spans", "tools", "mcp", F.array_join("agents", ",").alias("agents"), F.array_join("models", ",").alias("models"), types.alias("types"))


@query("k06_grounding")
def _(lake):
    return TJ.grounding_rows(_events(lake)).select("root_trace_id", "block")


@query("c20_call_results", f"""SELECT conv_id, count(*) AS tool_spans FROM conversations WHERE role = 'system' AND {STRIPPED} <> '' GROUP BY 1""")
def _(lake):
    own = F.filter(TJ.grounding_blocks("event"), lambda b: b.startswith('Tool "search"'))
    rows = _events(lake).withColumn("n", F.size(own))
    return rows.filter(F.col("n") > 0).groupBy("conv_id").agg(F.sum("n").alias("tool_spans"))


@query("k07_media_refs", """SELECT conv_id, turn AS seq, 'image:abc' AS media FROM conversations WHERE conv_id % 4 = 0""")
def _(lake):
    ref = '{"kind":"image","mime":"image/png","sha256":"abc"}'
    doc = F.when(F.col("conv_id") % 4 == 0, F.lit(f'{{"messages":[{{"content":[{{"_media_ref":{ref}}},{{"x":{{"_media_ref":{ref}}}}}]}}]}}')).otherwise("{}")
    rows = lake.raw("conversations").withColumn("media", TJ.media_refs(doc))
    return rows.select("conv_id", F.col("turn").alias("seq"), F.explode("media").alias("m")).select("conv_id", "seq", F.concat_ws(":", "m.kind", "m.sha256").alias("media"))


@query("k08_synthetic_events", """SELECT example_id, input, expected_output AS response, example_id % 2 = 0 AS has_messages FROM v_examples""")
def _(lake):
    text = F.when(F.col("example_id") % 2 == 0, F.concat(F.lit('[{"role":"user","content":"'), "input", F.lit('"}]'))).otherwise(F.col("input"))
    e = F.parse_json(D.synthetic_event(text, F.col("expected_output"), F.col("example_id").cast("string")))
    return lake.examples.select("example_id", "input", F.try_variant_get(e, "$.response", "string").alias("response"),
                                F.coalesce(F.try_variant_get(e, "$.messages[0].content", "string") == F.col("input"), F.lit(False)).alias("has_messages"))


@query("k09_task_variables", """SELECT p_partkey, p_name AS input, p_type AS expected, p_brand AS brand, 4 + 1 AS n FROM part""")
def _(lake):
    meta = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("input"), F.lit("shadow"))
    v = D.task_variables(F.col("p_name"), F.col("p_type"), meta, F.lit(""))
    return lake.raw("part").select("p_partkey", v["input"].alias("input"), v["expected"].alias("expected"), v["brand"].alias("brand"), F.size(v).alias("n"))


SHOTS = "[{'i': p_name, 'o': p_type}, {'i': '', 'o': ''}, {'i': p_brand, 'o': 'x'}]"


@query("k10_few_shot", """SELECT p_partkey, concat('Input: ', p_name, chr(10), 'Output: ', p_type, chr(10), chr(10), 'Input: ', p_brand, chr(10), 'Output: x') AS few_shot FROM part""")
def _(lake):
    pair = lambda a, b: F.struct(a.alias("input"), b.alias("output"))
    shots = F.array(pair(F.col("p_name"), F.col("p_type")), pair(F.lit(" "), F.lit("")), pair(F.col("p_brand"), F.lit("x ")))
    return lake.raw("part").select("p_partkey", D.few_shot_text(shots).alias("few_shot"))


@query("k11_render_tasks", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('Classify ', p_name, ' of ', p_brand) ELSE concat('Classify it.', chr(10), chr(10), p_name) END AS prompt, 2 AS turns FROM part""")
def _(lake):
    meta = F.create_map(F.lit("brand"), F.col("p_brand"))
    v = D.task_variables(F.col("p_name"), F.col("p_type"), meta, F.lit(""))
    t = F.when(F.col("p_partkey") % 2 == 0, "Classify {{input}} of ${brand}").otherwise("Classify it.  ")
    turns = D.render_turns(t, v, system="Be brief.")
    return lake.raw("part").select("p_partkey", F.element_at(turns, -1)["content"].alias("prompt"), F.size(turns).alias("turns"))


@query("k13_run_jobs", """SELECT example_id, CASE WHEN model IS NOT NULL THEN 'trace' ELSE 'text' END AS source, coalesce(model, expected_output) AS answer, CASE WHEN model IS NOT NULL AND expected_output <> model THEN expected_output END AS reference
FROM v_examples LEFT JOIN (SELECT root_trace_id, model FROM v_traces WHERE is_root = 1) r ON r.root_trace_id = source_trace_id""")
def _(lake):
    roots = lake.traces.filter(F.col("is_root") == 1).select("root_trace_id", F.col("model").alias("response"))
    blocks = lake.traces.filter(F.col("is_root") == 1).select("root_trace_id", F.array("model").alias("grounding"))
    return D.run_jobs(lake.examples, roots, blocks, "run1", "metrics").select("example_id", "source", "answer", "reference")


@query("k19_local_results", "SELECT example_id, 'relevance' AS metrics, nullif(expected_output, 'ECONOMY') AS reference FROM v_examples")
def _(lake):
    rows = lake.examples.withColumn("expected", F.when(F.col("expected_output") != "ECONOMY", F.col("expected_output")).otherwise(""))
    return D.local_results(rows, None).select("example_id", F.array_join("metrics", ",").alias("metrics"), "reference")


@query("k21_agentic_jobs", """SELECT organization_id, root_trace_id, count(*) AS n, arg_min(trace_id, (ingested_at, trace_id)) AS first_span FROM v_traces
WHERE (organization_id, root_trace_id) IN (SELECT (organization_id, root_trace_id) FROM v_evals) GROUP BY 1, 2""")
def _(lake):
    spans = TJ.agentic_job_rows(lake.traces, lake.evals, F.col("trace_id"))
    return spans.groupBy(*RUN).agg(F.count("*").alias("n"), F.max(F.when(F.col("position") == 0, F.col("event"))).alias("first_span"))


@query("k01_import_runs", f"""SELECT organization_id, root_trace_id, coalesce(input, '') AS input, output AS expected_output FROM ({RUN_IO}) io JOIN v_traces t USING (organization_id, root_trace_id)
WHERE t.is_root = 1 AND agent_key = '2-high' AND NOT EXISTS (SELECT 1 FROM v_examples e WHERE e.source_trace_id = t.trace_id) AND (trim(coalesce(input, '')) <> '' OR trim(coalesce(output, '')) <> '')""")
def _(lake):
    roots = lake.traces.filter(is_root() & (F.col("agent_key") == "2-high")).withColumn("event", F.parse_json(F.to_json(F.struct("trace_id", "model"))))
    order = [F.col("ingested_at").desc(), F.col("organization_id"), F.col("trace_id")]
    return D.import_runs(roots, lake.examples, TJ.trajectory_io(_io(lake)), order).select(*RUN, "input", "expected_output")


@query("c18_enrich_examples", """WITH m AS (SELECT trace_id, layer AS name, round(avg(score), 4) AS s FROM v_evals GROUP BY 1, 2), e AS (SELECT trace_id, string_agg(name || '=' || s, ',' ORDER BY name) AS scores FROM m GROUP BY 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ingested_at DESC, event_id DESC) AS rn FROM v_scans) x WHERE rn = 1),
c AS (SELECT root_trace_id, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost FROM v_costs GROUP BY 1)
SELECT example_id, coalesce(scores, '') AS scores, security_risk_level AS risk_level, should_block = 1 AS blocked, cost FROM v_examples x LEFT JOIN e ON e.trace_id = source_trace_id LEFT JOIN s ON s.trace_id = source_trace_id LEFT JOIN c ON c.root_trace_id = source_trace_id""")
def _(lake):
    r = D.enrich_examples(lake.examples, lake.evals, lake.scans, lake.costs)
    text = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return r.select("example_id", F.coalesce(text, F.lit("")).alias("scores"), "risk_level", "blocked", F.round("cost", 6).alias("cost"))


@query("k14_judge", """SELECT doc_id, metric, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE CAST(doc_id % 5 AS DOUBLE) / 4 END AS score, doc_id % 10 = 0 AS error FROM documents, (VALUES ('relevance'), ('custom')) t(metric)""")
def _(lake):
    def scorer(prompt: str) -> str:
        doc = int(prompt.split("#")[1])
        if doc % 10 == 0:
            raise RuntimeError("unreachable")
        return 'Verdict: {"score": %s, "reason": "ok"}' % (doc % 5 / 4)

    rows = lake.raw("documents").select("doc_id", F.concat(F.lit("#"), "doc_id", F.lit("#")).alias("question"), F.col("source").alias("answer"), F.lit("").alias("context"))
    out = J.judge(rows, {"relevance": "Rate {{answer}} for {{question}}", "custom": "score $question"}, scorer, ["doc_id"])
    return out.select("doc_id", "metric", "score", "error")


@query("k15_chain", """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN concat('<second <first ', lang, '> for ', lang, '>') END AS output, doc_id % 10 = 0 AS failed FROM documents""")
def _(lake):
    def model(prompt: str) -> str:
        if prompt.startswith("first bad"):
            raise ValueError("bad input")
        return f"<{prompt}>"

    lang = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("bad"), "lang")).otherwise(F.col("lang"))
    rows = lake.raw("documents").select("doc_id", F.create_map(F.lit("input"), lang).alias("values"))
    out = J.run_chain(rows, ["first {{input}}", "second {{previous}} for {{input}}"], model)
    return out.select("doc_id", "output", F.col("gen_error").isNotNull().alias("failed"))


@query("k17_code_checks", """SELECT doc_id, contains(lower(text), 'the')::INT::DOUBLE AS mentions, least(1.0::DOUBLE, len(regexp_extract_all(text, '\\S+')) / 100.0::DOUBLE) AS length FROM documents""")
def _(lake):
    rows = lake.raw("documents").select("doc_id", F.col("text").alias("output"))
    out = J.score_checks(rows, {"mentions": J.contains("output", "THE"), "length": J.clamp(J.word_count("output") / 100), "bad": "length(output)"}, ["doc_id"])
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m)
    return out.groupBy("doc_id").agg(pick("mentions"), pick("length"))
