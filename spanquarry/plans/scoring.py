"""Prices, sampling rules, and scalar expressions."""
import datetime as dt

from pyspark.sql import functions as F

from spanquarry.functions import ids as I, scalars as S
from spanquarry.operators import costing as C, filters as P, rules as RU
from spanquarry.plans.registry import query
from spanquarry.schemas import SCORING_RULES, TRACE_KEY


def _calls(lake):
    """One call per line item; the model names only partly occur on the price sheet."""
    return lake.costs.select(
        "trace_id", "provider", F.upper("model").alias("model"),
        F.when(F.col("input_tokens") % 300 == 0, "Text").otherwise("Video").alias("modality"),
        "input_tokens", (F.col("cached_input_tokens") * 3).alias("cached_input_tokens"), "output_tokens")


CALLS = """calls AS (SELECT trace_id, provider, upper(model) AS model, CASE WHEN input_tokens % 300 = 0 THEN 'Text' ELSE 'Video' END AS modality,
  input_tokens, cached_input_tokens * 3 AS cached_input_tokens, output_tokens FROM v_costs),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(provider), lower(model), lower(modality) ORDER BY id) AS rn FROM v_prices) x WHERE rn = 1),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(provider), lower(model) ORDER BY id) AS rn FROM v_prices) x WHERE rn = 1),
picked AS (SELECT c.*, coalesce(ex.id, an.id) AS price_id FROM calls c
  LEFT JOIN ex ON lower(c.provider) = lower(ex.provider) AND lower(c.model) = lower(ex.model) AND lower(c.modality) = lower(ex.modality)
  LEFT JOIN an ON lower(c.provider) = lower(an.provider) AND lower(c.model) = lower(an.model))"""


@query("c13_price_lookup", f"WITH {CALLS} SELECT trace_id, price_id FROM picked")
def _(lake):
    return C.attach_price(_calls(lake), lake.prices).select("trace_id", F.col("price.id").alias("price_id"))


@query("e03_price_rows", """SELECT provider, model, modality, min(id) AS id FROM v_prices GROUP BY 1, 2, 3""")
def _(lake):
    from spanquarry.operators.versioned import pick_first
    keys = ["provider", "model", "modality"]
    return pick_first(lake.prices, keys, [F.col("id")]).select(*keys, "id")


# Rates are whole thousandths, so the cost is a whole number of 1e-9 and is rounded
# half-even to 1e-8 in integers.
@query("d40_estimate_cost", f"""WITH {CALLS}, n AS (SELECT trace_id, price_id, coalesce(input_tokens > long_over, false) AS long_context,
  greatest(input_tokens - cached_input_tokens, 0) AS bill, cached_input_tokens AS cached, output_tokens AS outp,
  CAST(round(1000 * CASE WHEN coalesce(input_tokens > long_over, false) THEN long_in_rate ELSE in_rate END) AS BIGINT) AS r1,
  CAST(round(1000 * CASE WHEN coalesce(input_tokens > long_over, false) THEN long_cached_rate ELSE cached_rate END) AS BIGINT) AS r2,
  CAST(round(1000 * coalesce(CASE WHEN coalesce(input_tokens > long_over, false) THEN long_out_rate ELSE out_rate END, 0)) AS BIGINT) AS r3
  FROM picked LEFT JOIN v_prices p ON p.id = price_id),
u AS (SELECT trace_id, price_id, long_context, bill * r1 + cached * r2 + outp * r3 AS nano FROM n)
SELECT trace_id, long_context, CASE WHEN price_id IS NOT NULL THEN
  CAST(nano // 10 + CASE WHEN nano % 10 > 5 OR (nano % 10 = 5 AND (nano // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100000000 END AS cost_usd FROM u""")
def _(lake):
    priced = C.attach_price(_calls(lake), lake.prices)
    return C.estimate_cost(priced).select("trace_id", "long_context", "cost_usd")


MODELS = ["gpt-4o", "GPT-4o-mini", "claude-sonnet-4", "claude-haiku-4-5", "gemini-2.5-pro", "o3-deep", "llama-8b", "grok-3",
          "glm-4.6", "groq/llama", "chatgpt-x", "unknown", "", "gpt-4-turbo-2024", "kimi-k2"]
MODEL_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "][CAST(l_partkey % 15 AS INTEGER) + 1]"


def _models(lake):
    names = F.array(*[F.lit(m) for m in MODELS])
    return lake.raw("lineitem").select(F.element_at(names, (F.col("l_partkey") % 15 + 1).cast("int")).alias("model"))


# "gemini" itself contains the mark "mini", so that family never gets a hint.
@query("d41_downgrade_hint", f"""SELECT model, hint, count(*) AS n FROM (SELECT {MODEL_SQL} AS model,
  [NULL][1] AS x, CASE CAST(l_partkey % 15 AS INTEGER) WHEN 0 THEN 'gpt-4o-mini@0.9' WHEN 2 THEN 'claude-haiku-4-5@0.85'
  WHEN 5 THEN 'o4-mini@0.75' WHEN 13 THEN 'gpt-4o-mini@0.9' END AS hint FROM lineitem) m GROUP BY 1, 2""")
def _(lake):
    h = C.downgrade_hint("model")
    text = F.when(h.isNotNull(), F.concat_ws("@", h["model"], h["savings"]))
    return _models(lake).withColumn("hint", text).groupBy("model", "hint").agg(F.count("*").alias("n"))


@query("h13_provider_for_model", f"""SELECT model, CASE WHEN model ILIKE 'groq/%' THEN 'groq' WHEN model ILIKE 'chatgpt%' THEN 'openai' WHEN model ILIKE 'gpt%' OR model ILIKE 'o3%' THEN 'openai'
  WHEN model ILIKE 'claude%' THEN 'anthropic' WHEN model ILIKE 'gemini%' THEN 'gemini' WHEN model ILIKE 'grok%' THEN 'xai' WHEN model ILIKE 'glm%' THEN 'zai'
  WHEN model ILIKE 'kimi%' THEN 'moonshot' END AS provider, count(*) AS n FROM (SELECT {MODEL_SQL} AS model FROM lineitem) m GROUP BY 1, 2""")
def _(lake):
    rows = _models(lake).withColumn("provider", S.provider_for_model("model"))
    return rows.groupBy("model", "provider").agg(F.count("*").alias("n"))


@query("b19_priced_models", "SELECT id, provider, model FROM v_prices WHERE lower(modality) = 'text' AND in_rate IS NOT NULL AND out_rate IS NOT NULL")
def _(lake):
    return C.priced_models(lake.prices).select("id", "provider", "model")


@query("b19_chat_models", """SELECT DISTINCT concat(m, '-', p_partkey % 12) AS id, CASE lower(provider) WHEN 'openai' THEN 'openai' WHEN 'anthropic' THEN 'anthropic' WHEN 'google' THEN 'gemini' END AS provider
FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' WHEN 2 THEN 'Google' ELSE 'Mistral' END AS provider,
  CASE p_size % 5 WHEN 0 THEN 'gpt-3.5' WHEN 1 THEN 'omni-audio' WHEN 2 THEN 'chat-2024' WHEN 3 THEN 'chat' ELSE 'omni' END AS m FROM part) x
WHERE provider <> 'Mistral' AND p_size % 5 IN (3, 4)""")
def _(lake):
    size = F.col("p_size") % 5
    base = (F.when(size == 0, "gpt-3.5").when(size == 1, "omni-audio").when(size == 2, "chat-2024").when(size == 3, "chat").otherwise("omni"))
    part = lake.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", base, F.col("p_partkey") % 12).alias("model"))
    sheet = lake.prices.select("id", "provider", F.lit("Text").alias("modality")).join(part, "id")
    return C.chat_models(sheet)


@query("a17_clean_price_rows", """SELECT p_partkey AS id FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0""")
def _(lake):
    sheet = lake.raw("part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, "OpenAI").alias("provider"),
        F.col("p_name").alias("model"), F.when(F.col("p_size") % 5 != 0, "Text").otherwise("").alias("modality"))
    return C.clean_price_rows(sheet).select("id")


# -- rules ------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)
RULES = [
    # org, id, name, enabled, metrics, judges, rate, scope, integrations, models
    ("org0", "r1", "tenth", True, ["m1"], None, 10.0, "root", [], []),
    ("org0", "r2", "rest", True, ["m2"], None, 40.0, "root", ["openai"], []),
    ("org1", "r3", "off", False, ["m1"], None, 100.0, "root", [], []),
    ("org1", "r4", "empty", True, [], {}, 100.0, "all", [], []),
    ("org1", "r5", "judged", True, [], {"tone": 0.5}, 25.0, "all", [], ["MODEL-1", "model-2"]),
    ("org2", "r6", "none", True, ["m1"], None, 0.0, "all", [], []),
    ("org2", "r7", "all", True, ["m1"], None, 100.0, "all", ["ANTHROPIC"], []),
]


def _rules(lake):
    rows = [(*r, T0 + dt.timedelta(days=i)) for i, r in enumerate(RULES)]
    return lake.spark.createDataFrame(rows, SCORING_RULES)


def _typed(lake):
    return lake.traces.withColumn("type", F.when(F.col("latency") > 2.5, "tool").otherwise("llm"))


BUCKET = "CAST(CAST('0x' || substr(sha256('{r}:' || trace_id), 1, 4) AS BIGINT) AS DOUBLE) / 65535 * 100"
SELECTED = f"""SELECT organization_id, trace_id, CASE
  WHEN organization_id = 'org0' AND root AND {BUCKET.format(r='r1')} < 10 THEN 'r1'
  WHEN organization_id = 'org0' AND root AND integration = 'OPENAI' AND {BUCKET.format(r='r2')} < 40 THEN 'r2'
  WHEN organization_id = 'org1' AND model IN ('model-1', 'model-2') AND {BUCKET.format(r='r5')} < 25 THEN 'r5'
  WHEN organization_id = 'org2' AND integration = 'ANTHROPIC' THEN 'r7' END AS rule_id
FROM (SELECT *, trace_id = root_trace_id AS root FROM v_traces WHERE coalesce(latency, 0) <= 2.5) t"""


@query("c19_select_rule", f"SELECT * FROM ({SELECTED}) s WHERE rule_id IS NOT NULL")
def _(lake):
    return RU.scoring_jobs(RU.select_rule(_typed(lake), _rules(lake))).select(*TRACE_KEY, "rule_id")


@query("e02_first_rule", f"SELECT rule_id, count(*) AS n FROM ({SELECTED}) s GROUP BY 1 HAVING rule_id IS NOT NULL")
def _(lake):
    jobs = RU.scoring_jobs(RU.select_rule(_typed(lake), _rules(lake)))
    return jobs.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("e07_sample", f"""SELECT trace_id, round({BUCKET.format(r='rule-a')}, 6) AS bucket, {BUCKET.format(r='rule-a')} < 12.5 AS sampled FROM v_traces""")
def _(lake):
    rule = F.lit("rule-a")
    return lake.traces.select("trace_id", F.round(I.sample_bucket("trace_id", rule), 6).alias("bucket"),
                              I.in_sample("trace_id", rule, 12.5).alias("sampled"))


# -- scalars ----------------------------------------------------------------

@query("h01_json_paths", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events""")
def _(lake):
    v = F.parse_json("props")
    return lake.raw("events").select("event_id", S.json_field(v, "$.k", "bigint", -1).alias("k"),
                                     S.json_field(v, "$.missing", "string", "").alias("missing"))


@query("h02_preview", """SELECT doc_id, CASE WHEN length(s) > 300 THEN concat(substr(s, 1, 300), '…') WHEN s = '' THEN NULL ELSE s END AS preview
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents) d""")
def _(lake):
    return lake.raw("documents").select("doc_id", S.preview("text", 300).alias("preview"))


@query("h03_provider_model", "SELECT provider || ':' || model AS agent_key, count(*) AS n FROM v_costs GROUP BY 1")
def _(lake):
    return lake.costs.groupBy(F.concat_ws(":", "provider", "model").alias("agent_key")).agg(F.count("*").alias("n"))


@query("h04_time_buckets", """SELECT event_id, time_bucket(INTERVAL 240 MINUTE, ts) AS bucket, date_trunc('month', ts) AS month, CAST(ts AS DATE) AS day FROM events""")
def _(lake):
    return lake.raw("events").select(
        "event_id", F.window("ts", "240 minutes")["start"].alias("bucket"),
        F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), F.to_date("ts").alias("day"))


@query("h05_array_min", """SELECT organization_id, trace_id, min(m) AS weakest, count(*) AS n FROM (SELECT organization_id, trace_id, metric, evaluator, round(avg(score), 6) AS m FROM v_evals GROUP BY ALL) x GROUP BY 1, 2""")
def _(lake):
    from spanquarry.operators.trace_list import evaluation_entries
    e = evaluation_entries(lake.evals)
    return e.select(*TRACE_KEY, F.array_min(F.transform("evaluations", lambda x: F.round(x.score, 6))).alias("weakest"),
                    F.size("evaluations").cast("bigint").alias("n"))


@query("h06_conditional_aggregates", """SELECT organization_id, round(sum(score) FILTER (WHERE metric = 'm1'), 4) AS s, round(avg(score) FILTER (WHERE metric = 'm2'), 6) AS a,
  count(*) FILTER (WHERE score >= 0.5) AS n, min(evaluator) FILTER (WHERE metric = 'm0') AS any_evaluator FROM v_evals GROUP BY 1""")
def _(lake):
    from spanquarry.functions.common import avg_where, count_where
    m = F.col("metric")
    return lake.evals.groupBy("organization_id").agg(
        F.round(F.sum(F.when(m == "m1", F.col("score"))), 4).alias("s"), F.round(avg_where("score", m == "m2"), 6).alias("a"),
        count_where(F.col("score") >= 0.5).alias("n"), F.min(F.when(m == "m0", F.col("evaluator"))).alias("any_evaluator"))


@query("h08_decimal_cost", "SELECT provider, round(CAST(sum(total_cost) AS DOUBLE), 4) AS cost, max(round(total_cost, 8))::DOUBLE AS top FROM v_costs GROUP BY 1")
def _(lake):
    return lake.costs.groupBy("provider").agg(
        F.round(F.sum("total_cost").cast("double"), 4).alias("cost"), F.max(F.round("total_cost", 8)).cast("double").alias("top"))


@query("h10_metric_names", """SELECT event_id, regexp_replace(lower(concat(CASE event_id % 4 WHEN 0 THEN 'RAGAS.' WHEN 1 THEN 'auto.' WHEN 2 THEN 'ragas_' ELSE '' END, event_type)), '^(ragas\\.|auto\\.|ragas_)', '') AS metric FROM events""")
def _(lake):
    r = F.col("event_id") % 4
    raw = F.concat(F.when(r == 0, "RAGAS.").when(r == 1, "auto.").when(r == 2, "ragas_").otherwise(""), "event_type")
    return lake.raw("events").select("event_id", S.normalize_metric(raw).alias("metric"))


@query("h11_substitute", """SELECT doc_id, concat('Q ', doc_id, ' in {{source}} of ', source, ', {{unknown}} ends ', doc_id) AS prompt, 'doc_id,lang,source,unknown,doc_id' AS names FROM documents""")
def _(lake):
    t = F.lit("Q {{ doc_id }} in ${lang} of $source, {{unknown}} ends {{doc_id}}")
    values = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("lang"), F.lit("{{source}}"), F.lit("source"), F.col("source"))
    return lake.raw("documents").select("doc_id", S.substitute(t, values).alias("prompt"),
                                        F.array_join(S.placeholders(t), ",").alias("names"))


@query("h12_normalize_tags", """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(trim(source)), '^[a-z0-9][a-z0-9._\\-/]{0,62}$') THEN lower(trim(source)) END,
  CASE WHEN regexp_matches(lower(trim(lang)) || '-x', '^[a-z0-9][a-z0-9._\\-/]{0,62}$') THEN lower(trim(lang)) || '-x' END) AS tags FROM documents""")
def _(lake):
    raw = F.array(F.concat(F.lit("  "), F.upper("source")), F.lit("bad tag!"), F.lit(None), F.lit("-lead"),
                  F.concat(F.col("lang"), F.lit("-X ")), F.col("source"))
    return lake.raw("documents").select("doc_id", F.array_join(S.normalize_tags(raw), ",").alias("tags"))


OPTIONS = "array(named_struct('label', 'Good', 'score', 1.0D), named_struct('label', ' OK ', 'score', 0.5D), named_struct('label', 'Bad', 'score', 0.0D))"


@query("h14_choice_scores", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS score,
  CASE doc_id % 5 WHEN 3 THEN 'no choice' WHEN 4 THEN concat(lang, ' is not one of: Good,  OK , Bad') END AS error FROM documents""")
def _(lake):
    r, options = F.col("doc_id") % 5, F.expr(OPTIONS)
    answer = F.when(r == 0, " good").when(r == 1, "ok").when(r == 2, "BAD ").when(r == 3, " ").otherwise(F.col("lang"))
    return lake.raw("documents").select("doc_id", S.choice_score(answer, options).alias("score"), S.choice_error(answer, options).alias("error"))


@query("h15_rubric_scores", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END
  WHEN 1 THEN CASE WHEN doc_id % 200 <= 100 THEN (doc_id % 200) / 100.0 END WHEN 2 THEN CASE WHEN doc_id % 3 = 1 THEN 1.0 END END AS score,
  CASE doc_id % 4 WHEN 1 THEN doc_id % 200 > 100 WHEN 2 THEN doc_id % 3 <> 1 ELSE false END AS rejected FROM documents""")
def _(lake):
    i, options = F.col("doc_id"), F.expr(OPTIONS)
    kind = F.when(i % 4 == 0, "boolean").when(i % 4 == 1, "slider").when(i % 4 == 2, "choice").otherwise("text")
    answer = (F.when(i % 4 == 0, F.when(i % 3 == 0, "true").otherwise("false")).when(i % 4 == 1, ((i % 200) / 100).cast("string"))
              .when(i % 4 == 2, F.when(i % 3 == 1, "GOOD").otherwise("great")).otherwise(F.col("lang")))
    return lake.raw("documents").select("doc_id", S.rubric_score(kind, answer, options).alias("score"),
                                        S.rubric_error(kind, answer, options).isNotNull().alias("rejected"))


@query("h16_reply_scores", """SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS score FROM documents""")
def _(lake):
    r = F.col("doc_id") % 5
    raw = (F.when(r == 0, '{"score": 0.25, "reason": "x"}').when(r == 1, 'Sure: {"score": 7}').when(r == 2, F.concat("lang", F.lit(' {"score": "0.75"} done')))
           .when(r == 3, "no json").otherwise('{"score": "high"}'))
    return lake.raw("documents").select("doc_id", S.reply_score(S.reply_json(raw)).alias("score"))


@query("h17_output_contract", f"""SELECT doc_id, contains(lower(text), 'score') AS asked, length(text) + CASE WHEN contains(lower(text), 'score') THEN 0 ELSE {len(S.OUTPUT_CONTRACT)} END AS chars FROM documents""")
def _(lake):
    t = S.with_contract("text")
    return lake.raw("documents").select("doc_id", F.contains(F.lower("text"), F.lit("score")).alias("asked"), F.length(t).cast("bigint").alias("chars"))


@query("h18_entropy_redact", """SELECT page_id, round(list_entropy(string_split(url, '')), 6) AS entropy, concat(substr(url, 1, 4), repeat('•', least(length(url) - 4, 12))) AS redacted FROM pages""")
def _(lake):
    return lake.raw("pages").select("page_id", F.round(S.entropy("url"), 6).alias("entropy"), S.redact("url").alias("redacted"))


@query("h22_slugs", """SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")
def _(lake):
    return lake.raw("pages").select("page_id", S.slug("url").alias("slug"))


@query("g05_ordered_distinct", """SELECT conv_id, min(role) AS first_role, count(*) AS roles FROM (SELECT DISTINCT conv_id, role FROM conversations) c GROUP BY 1""")
def _(lake):
    d = lake.raw("conversations").select("conv_id", "role").dropDuplicates()
    roles = d.groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    return roles.select("conv_id", F.get("roles", F.lit(0)).alias("first_role"), F.size("roles").cast("bigint").alias("roles"))


@query("g06_check_answers", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tone' ELSE '' END AS missing, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS unknown FROM documents""")
def _(lake):
    i = F.col("doc_id")
    answered = F.array_compact(F.array(F.lit("quality"), F.when(i % 2 == 1, "tone"), F.when(i % 3 == 0, F.col("lang"))))
    required = F.array(F.lit("quality"), F.lit("tone"))
    known = F.array(F.lit("quality"), F.lit("tone"), F.lit("notes"))
    return lake.raw("documents").select("doc_id", F.array_join(F.array_except(required, answered), ",").alias("missing"),
                                        F.array_join(F.array_except(answered, known), ",").alias("unknown"))


@query("b22_retrieval_events", """SELECT event_id, event_type IN ('view', 'click') AND event_id % 3 = 0 AS retrieval FROM events""")
def _(lake):
    type_ = F.when(F.col("event_type").isin("view", "click"), "vectorstore")
    api = F.when(F.col("event_id") % 3 == 0, "near_text").otherwise("upsert")
    return lake.raw("events").select("event_id", P.is_retrieval(type_, api).alias("retrieval"))


# Version 5 UUIDs from SHA-1 of namespace and name.
UUIDS = f"""SELECT *, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1 AS BIGINT), 1),
  substr(h, 18, 3), '-', substr(h, 21, 12)) AS uuid FROM (SELECT *, sha1(unhex('{I.TRACE_NAMESPACE.hex}') || encode(trace_id)) AS h FROM v_traces) x"""


@query("a02_trace_ids", f"SELECT trace_id, uuid FROM ({UUIDS}) u")
def _(lake):
    return lake.traces.select("trace_id", I.coerce_trace_id("trace_id").alias("uuid"))
