"""The trace tables, derived from the benchmark's tables.

Each view exists twice: as DataFrame code for Spark (``Lake``) and as SQL text for the
oracle (``VIEWS``), written separately so that comparing results checks both.
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanquarry.functions.common import lookup

LONG = "bigint"


def _cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast(LONG)


def _child_id() -> Column:
    return F.concat(
        F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey",
        F.lit("-"), "l_suppkey", F.lit("-"), _cents("l_extendedprice"),
    )


def _org(key: str) -> Column:
    return F.concat(F.lit("org"), F.col(key) % 5)


def _run(key) -> Column:
    return F.concat(F.lit("r"), F.col(key) if isinstance(key, str) else key)


class Lake:
    """Lazy access to one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def traces(self) -> DataFrame:
        integration = F.when(F.col("o_custkey") % 2 == 0, "OPENAI").otherwise("ANTHROPIC")
        key = F.concat(F.lit("k"), F.col("o_custkey") % 3)
        orders = self.raw("orders")
        roots = orders.select(
            _run("o_orderkey").alias("trace_id"), _run("o_orderkey").alias("root_trace_id"),
            F.lit(None).cast("string").alias("parent_id"),
            _org("o_orderkey").alias("organization_id"), key.alias("api_key_prefix"),
            F.col("o_orderdate").alias("ingested_at"), F.lit(1).alias("is_root"),
            F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.lower("o_orderpriority")).alias("agent_key"),
            F.when(F.col("o_custkey") % 3 == 0, "function").when(F.col("o_custkey") % 3 == 1, "chain")
             .otherwise("langgraph_node").alias("agent_kind"),
            integration.alias("integration"),
            F.concat(F.lit("model-"), F.col("o_custkey") % 6).alias("model"),
            F.when(F.col("o_orderstatus") == "P", "blocked").alias("status"),
            F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True).alias("success"),
            F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 997).cast("double") / 100).alias("latency"),
        )
        items = self.raw("lineitem")
        spans = items.join(
            orders.select("o_orderkey", "o_custkey"), items.l_orderkey == orders.o_orderkey
        ).select(
            _child_id().alias("trace_id"), _run("l_orderkey").alias("root_trace_id"),
            _run("l_orderkey").alias("parent_id"), _org("l_orderkey").alias("organization_id"),
            key.alias("api_key_prefix"), F.col("l_shipdate").alias("ingested_at"),
            F.lit(0).alias("is_root"), F.lit("").alias("agent_key"), F.lit("").alias("agent_kind"),
            integration.alias("integration"),
            F.concat(F.lit("model-"), F.col("l_partkey") % 6).alias("model"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "blocked").alias("status"),
            F.when(F.col("l_returnflag") == "A", F.col("l_linestatus") == "O").alias("success"),
            (F.col("l_quantity") / 10).alias("latency"),
        )
        return roots.unionByName(spans)

    @cached_property
    def costs(self) -> DataFrame:
        qty = F.col("l_quantity").cast(LONG)
        return self.raw("lineitem").select(
            _org("l_orderkey").alias("organization_id"), _child_id().alias("trace_id"),
            _run("l_orderkey").alias("root_trace_id"),
            F.element_at(
                F.array(*[F.lit(p) for p in ("OpenAI", "Anthropic", "Google", "Mistral")]),
                (F.col("l_suppkey") % 4 + 1).cast("int"),
            ).alias("provider"),
            F.concat(F.lit("model-"), F.col("l_partkey") % 6).alias("model"),
            (qty * 100).alias("input_tokens"), (qty * 10).alias("cached_input_tokens"),
            (qty * 25).alias("output_tokens"),
            (_cents("l_extendedprice").cast("double") / 1000000).cast("decimal(18,10)").alias("total_cost"),
            F.lit("USD").alias("currency"), F.col("l_shipdate").alias("ingested_at"),
        )

    def _event_keys(self) -> list[Column]:
        run = _run(F.col("event_id") % 400)
        return [_org("event_id").alias("organization_id"), run.alias("trace_id"), run.alias("root_trace_id")]

    @cached_property
    def evals(self) -> DataFrame:
        third = F.col("event_id") % 3 == 0
        evaluator = lookup(
            {"purchase": "human.feedback", "signup": "human.annotation", "error": "auto.security"},
            F.col("event_type"), F.lit("auto.eval"),
        )
        layers = F.array(*[F.lit(x) for x in ("deterministic", "tool_selection", "trajectory", "coordination")])
        return self.raw("events").select(
            *self._event_keys(), evaluator.alias("evaluator"),
            F.concat(F.lit("m"), F.regexp_extract("props", "([0-9]+)", 1).cast(LONG) % 3).alias("metric"),
            ((_cents("value") % 101).cast("double") / 100).alias("score"),
            F.element_at(layers, (F.col("event_id") % 4 + 1).cast("int")).alias("layer"),
            F.when(third, F.col("event_id") % 700).otherwise(0).alias("judge_input_tokens"),
            F.when(third, F.col("event_id") % 90).otherwise(0).alias("judge_output_tokens"),
            F.when(third, 1 + F.col("event_id") % 3).otherwise(0).alias("judge_calls"),
            F.col("ts").alias("ingested_at"), "event_id",
        )

    @cached_property
    def scans(self) -> DataFrame:
        pct = _cents("value") % 101
        flag = lambda c: F.when(c, 1).otherwise(0)
        eid = F.col("event_id")
        return self.raw("events").select(
            *self._event_keys(), (pct.cast("double") / 100).alias("security_risk_score"),
            F.when(pct >= 90, "high").when(pct >= 70, "medium").when(pct >= 40, "low")
             .otherwise("clean").alias("security_risk_level"),
            flag(pct >= 90).alias("should_block"), flag(eid % 2 == 0).alias("injection_detected"),
            flag(eid % 3 == 0).alias("jailbreak_detected"), flag(eid % 5 == 0).alias("secrets_detected"),
            F.col("ts").alias("ingested_at"), "event_id",
        )

    @cached_property
    def tag_log(self) -> DataFrame:
        return self.raw("events").select(
            _org("event_id").alias("organization_id"), _run(F.col("event_id") % 400).alias("trace_id"),
            F.concat(F.lit("tag-"), F.regexp_extract("props", "([0-9]+)", 1).cast(LONG) % 5).alias("tag"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("deleted"),
            F.col("ts").alias("updated_at"), "event_id",
        )

    @cached_property
    def flag_log(self) -> DataFrame:
        """Review flags: a sign-up raises one, an error resolves it."""
        return self.raw("events").filter(F.col("event_type").isin("signup", "error")).select(
            _org("event_id").alias("organization_id"), _run(F.col("event_id") % 400).alias("trace_id"),
            F.when(F.col("event_type") == "signup", "open").otherwise("resolved").alias("status"),
            F.concat(F.lit("reason-"), F.col("event_id") % 3).alias("reason"),
            F.col("ts").alias("updated_at"), "event_id",
        )

    @cached_property
    def run_scores(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_returnflag").alias("run_id"), F.col("l_partkey").alias("example_id"),
            F.col("l_linestatus").alias("metric"),
            (_cents("l_discount").cast("double") / 10).alias("score"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        """A price sheet with several rows per model, one line per part."""
        key = F.col("p_partkey")
        micro = (F.round(F.col("p_retailprice") * 100).cast(LONG) % 4000).cast("decimal(20,8)") / 100
        return self.raw("part").select(
            key.alias("id"),
            F.element_at(
                F.array(*[F.lit(p) for p in ("OpenAI", "Anthropic", "Google", "Mistral")]),
                (key % 4 + 1).cast("int"),
            ).alias("provider"),
            F.concat(F.lit("model-"), key % 7).alias("model"),
            F.when(F.col("p_size") % 3 == 0, "Text").when(F.col("p_size") % 3 == 1, "Audio")
             .otherwise("Image").alias("modality"),
            micro.cast("decimal(20,8)").alias("input_token_cost_per_million"),
            (micro / 10).cast("decimal(20,8)").alias("cached_input_token_cost_per_million"),
            F.when(key % 9 != 0, (micro * 4).cast("decimal(20,8)")).alias("output_token_cost_per_million"),
            F.when(F.col("p_size") % 2 == 0, 3000).alias("long_context_consider_token_greater_than"),
            (micro * 2).cast("decimal(20,8)").alias("long_context_input_per_million"),
            (micro / 5).cast("decimal(20,8)").alias("long_context_cached_input_per_million"),
            (micro * 6).cast("decimal(20,8)").alias("long_context_output_per_million"),
        )

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("user_id"), F.col("c_name").alias("name"),
            F.lower(F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".example"))).alias("email"),
            F.when(key % 4 == 0, "Free").when(key % 4 == 1, "Starter").when(key % 4 == 2, "Team")
             .otherwise("Enterprise").alias("user_type"),
            F.when(key % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                   + F.make_dt_interval((key % 60).cast("int"))).alias("trial_ends_at"),
            F.col("c_nationkey").cast(LONG).alias("org_id"),
        )

    @cached_property
    def orgs(self) -> DataFrame:
        """Organizations: one per supplier, owned by the customer of the same number."""
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("org_id"), F.col("s_name").alias("name"), key.alias("user_id"),
            F.when(key % 5 == 0, "Growth").when(key % 5 == 1, "Team").alias("plan_tier"),
            (F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.col("s_nationkey"))).alias("created_at"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Each customer belongs to the organization of its nation's number."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            F.col("c_nationkey").cast(LONG).alias("org_id"), key.alias("user_id"),
            F.when(key % 11 == 0, "owner").when(key % 5 == 0, "admin").otherwise("member").alias("role"),
            (F.lit("2023-06-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval((key % 300).cast("int"))).alias("created_at"),
        )

    @cached_property
    def examples(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            F.col("p_brand").alias("dataset_id"), key.alias("example_id"),
            F.col("p_name").alias("input"), F.col("p_type").alias("expected_output"),
            F.when(key % 2 == 0, _run(key)).alias("source_trace_id"),
        )

    @cached_property
    def run_items(self) -> DataFrame:
        """Items of three evaluation runs; several items of one example are trials."""
        qty = F.col("l_quantity").cast(LONG)
        return self.raw("lineitem").select(
            F.col("l_returnflag").alias("run_id"), F.col("l_partkey").alias("example_id"),
            _child_id().alias("trace_id"), F.col("l_linestatus").alias("metric"),
            (_cents("l_discount").cast("double") / 10).alias("score"),
            (F.col("l_linenumber") != 7).alias("done"),
            F.when(F.col("l_linenumber") == 5, "provider error").alias("gen_error"),
            (qty * 40).alias("latency_ms"),
            F.when(F.col("l_tax") > 0, _cents("l_extendedprice").cast("double") / 1000000).alias("cost_usd"),
            F.col("l_shipdate").alias("created_at"),
        )


VIEWS: dict[str, str] = {
    "v_traces": """
SELECT concat('r', o_orderkey) AS trace_id, concat('r', o_orderkey) AS root_trace_id,
       CAST(NULL AS VARCHAR) AS parent_id,
       concat('org', o_orderkey % 5) AS organization_id, concat('k', o_custkey % 3) AS api_key_prefix,
       o_orderdate AS ingested_at, 1 AS is_root,
       CASE WHEN o_custkey % 7 = 0 THEN '' ELSE lower(o_orderpriority) END AS agent_key,
       CASE o_custkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'chain' ELSE 'langgraph_node' END AS agent_kind,
       CASE WHEN o_custkey % 2 = 0 THEN 'OPENAI' ELSE 'ANTHROPIC' END AS integration,
       concat('model-', o_custkey % 6) AS model,
       CASE o_orderstatus WHEN 'P' THEN 'blocked' END AS status,
       CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS success,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 997 AS DOUBLE) / 100 END AS latency
FROM orders
UNION ALL
SELECT concat('c', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)),
       concat('r', l_orderkey), concat('r', l_orderkey),
       concat('org', o_orderkey % 5), concat('k', o_custkey % 3),
       l_shipdate, 0, '', '',
       CASE WHEN o_custkey % 2 = 0 THEN 'OPENAI' ELSE 'ANTHROPIC' END,
       concat('model-', l_partkey % 6),
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'blocked' END,
       CASE WHEN l_returnflag = 'A' THEN l_linestatus = 'O' END,
       CAST(l_quantity AS DOUBLE) / 10
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_costs": """
SELECT concat('org', o_orderkey % 5) AS organization_id,
       concat('c', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS trace_id,
       concat('r', l_orderkey) AS root_trace_id,
       CASE l_suppkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' WHEN 2 THEN 'Google' ELSE 'Mistral' END AS provider,
       concat('model-', l_partkey % 6) AS model,
       CAST(l_quantity AS BIGINT) * 100 AS input_tokens,
       CAST(l_quantity AS BIGINT) * 10  AS cached_input_tokens,
       CAST(l_quantity AS BIGINT) * 25  AS output_tokens,
       CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 1000000 AS DECIMAL(18,10)) AS total_cost,
       'USD' AS currency, l_shipdate AS ingested_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_evals": """
SELECT concat('org', event_id % 5) AS organization_id,
       concat('r', event_id % 400) AS trace_id, concat('r', event_id % 400) AS root_trace_id,
       CASE event_type WHEN 'purchase' THEN 'human.feedback' WHEN 'signup' THEN 'human.annotation'
                       WHEN 'error' THEN 'auto.security' ELSE 'auto.eval' END AS evaluator,
       concat('m', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3) AS metric,
       CAST(CAST(round(value * 100) AS BIGINT) % 101 AS DOUBLE) / 100 AS score,
       CASE event_id % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'tool_selection'
                         WHEN 2 THEN 'trajectory' ELSE 'coordination' END AS layer,
       CASE WHEN event_id % 3 = 0 THEN event_id % 700 ELSE 0 END AS judge_input_tokens,
       CASE WHEN event_id % 3 = 0 THEN event_id % 90  ELSE 0 END AS judge_output_tokens,
       CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 3 ELSE 0 END AS judge_calls,
       ts AS ingested_at, event_id
FROM events""",
    "v_scans": """
SELECT concat('org', event_id % 5) AS organization_id,
       concat('r', event_id % 400) AS trace_id, concat('r', event_id % 400) AS root_trace_id,
       CAST(CAST(round(value * 100) AS BIGINT) % 101 AS DOUBLE) / 100 AS security_risk_score,
       CASE WHEN CAST(round(value * 100) AS BIGINT) % 101 >= 90 THEN 'high'
            WHEN CAST(round(value * 100) AS BIGINT) % 101 >= 70 THEN 'medium'
            WHEN CAST(round(value * 100) AS BIGINT) % 101 >= 40 THEN 'low' ELSE 'clean' END AS security_risk_level,
       CASE WHEN CAST(round(value * 100) AS BIGINT) % 101 >= 90 THEN 1 ELSE 0 END AS should_block,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS injection_detected,
       CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS jailbreak_detected,
       CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS secrets_detected,
       ts AS ingested_at, event_id
FROM events""",
    "v_tag_log": """
SELECT concat('org', event_id % 5) AS organization_id, concat('r', event_id % 400) AS trace_id,
       concat('tag-', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5) AS tag,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS deleted, ts AS updated_at, event_id
FROM events""",
    "v_flag_log": """
SELECT concat('org', event_id % 5) AS organization_id, concat('r', event_id % 400) AS trace_id,
       CASE event_type WHEN 'signup' THEN 'open' ELSE 'resolved' END AS status,
       concat('reason-', event_id % 3) AS reason, ts AS updated_at, event_id
FROM events WHERE event_type IN ('signup', 'error')""",
    "v_run_scores": """
SELECT l_returnflag AS run_id, l_partkey AS example_id, l_linestatus AS metric,
       CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10 AS score,
       l_shipdate AS created_at
FROM lineitem""",
    "v_prices": """
SELECT p_partkey AS id,
       CASE p_partkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' WHEN 2 THEN 'Google' ELSE 'Mistral' END AS provider,
       concat('model-', p_partkey % 7) AS model,
       CASE p_size % 3 WHEN 0 THEN 'Text' WHEN 1 THEN 'Audio' ELSE 'Image' END AS modality,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) / 100 AS in_rate,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) / 1000 AS cached_rate,
       CASE WHEN p_partkey % 9 <> 0 THEN CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) / 25 END AS out_rate,
       CASE WHEN p_size % 2 = 0 THEN 3000 END AS long_over,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) / 50 AS long_in_rate,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) / 500 AS long_cached_rate,
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 4000 AS DOUBLE) * 6 / 100 AS long_out_rate
FROM part""",
    "v_users": """
SELECT c_custkey AS user_id, c_name AS name,
       lower(concat(c_name, '@', c_mktsegment, '.example')) AS email,
       CASE c_custkey % 4 WHEN 0 THEN 'Free' WHEN 1 THEN 'Starter' WHEN 2 THEN 'Team' ELSE 'Enterprise' END AS user_type,
       CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER)) END AS trial_ends_at,
       CAST(c_nationkey AS BIGINT) AS org_id
FROM customer""",
    "v_orgs": """
SELECT s_suppkey AS org_id, s_name AS name, s_suppkey AS user_id,
       CASE s_suppkey % 5 WHEN 0 THEN 'Growth' WHEN 1 THEN 'Team' END AS plan_tier,
       TIMESTAMP '2023-01-01 00:00:00' + to_days(s_nationkey) AS created_at
FROM supplier""",
    "v_members": """
SELECT CAST(c_nationkey AS BIGINT) AS org_id, c_custkey AS user_id,
       CASE WHEN c_custkey % 11 = 0 THEN 'owner' WHEN c_custkey % 5 = 0 THEN 'admin' ELSE 'member' END AS role,
       TIMESTAMP '2023-06-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INTEGER)) AS created_at
FROM customer""",
    "v_examples": """
SELECT p_brand AS dataset_id, p_partkey AS example_id, p_name AS input, p_type AS expected_output,
       CASE WHEN p_partkey % 2 = 0 THEN concat('r', p_partkey) END AS source_trace_id
FROM part""",
    "v_run_items": """
SELECT l_returnflag AS run_id, l_partkey AS example_id,
       concat('c', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS trace_id,
       l_linestatus AS metric,
       CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10 AS score,
       l_linenumber <> 7 AS done,
       CASE WHEN l_linenumber = 5 THEN 'provider error' END AS gen_error,
       CAST(l_quantity AS BIGINT) * 40 AS latency_ms,
       CASE WHEN l_tax > 0 THEN CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 1000000 END AS cost_usd,
       l_shipdate AS created_at
FROM lineitem""",
}


def oracle(body: str) -> str:
    """Prefix a query with the views it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
