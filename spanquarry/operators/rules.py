"""Which live traces get scored: rules, their order and their samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.ids import in_sample

RULE_FIELDS = ["created_at", "rule_id", "name", "metrics", "custom_judges", "sample_rate", "span_scope", "integrations", "models"]


def rule_book(rules: DataFrame) -> DataFrame:
    """Each organization's usable rules as one array, oldest first.

    Rules are hand-written configuration, a few per organization.  A rule that scores
    nothing is left out, because it would shadow later ones.
    """
    scores_something = (F.size(F.coalesce("metrics", F.array())) > 0) | (
        F.cardinality(F.map_keys(F.coalesce("custom_judges", F.create_map().cast("map<string,double>")))) > 0)
    active = rules.filter(F.coalesce("enabled", F.lit(True)) & scores_something)
    key = F.struct("created_at", "rule_id")
    book = F.collect_list(F.struct(key.alias("k"), F.struct(*RULE_FIELDS).alias("rule")))
    sort = lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)
    return active.groupBy("organization_id").agg(F.transform(F.array_sort(book, sort), lambda x: x.rule).alias("book"))


def _any_or(values: Column, actual: Column) -> Column:
    """An empty list means any value; otherwise compare without case."""
    wanted = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda v: F.lower(v) == F.lower(F.coalesce(actual, F.lit(""))))


def matches(rule: Column) -> Column:
    """Whether a rule applies to the row's event, before sampling."""
    scope = F.coalesce(F.nullif(rule.span_scope, F.lit("")), F.lit("root"))
    own_root = F.coalesce(F.nullif("root_trace_id", F.lit("")), F.col("trace_id")) == F.col("trace_id")
    return (
        ((scope != "root") | own_root) & (F.coalesce("type", F.lit("")) == "llm")
        & _any_or(rule.integrations, F.col("integration")) & _any_or(rule.models, F.col("model"))
    )


def select_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule whose sample holds the trace, as struct column ``rule``.

    The rules travel as an array per organization: events meet them through one join
    on the organization and are neither multiplied nor ranked.
    """
    chosen = F.filter("book", lambda r: matches(r) & in_sample(
        "trace_id", r.rule_id, F.coalesce(r.sample_rate, F.lit(0.0))))
    return (
        events.join(rule_book(rules), "organization_id", "left")
        .withColumn("rule", F.get(chosen, F.lit(0))).drop("book")
    )


def scoring_jobs(selected: DataFrame, *more: str) -> DataFrame:
    """One scoring job per selected trace, with the rule's metrics and judges and ``more`` columns of the event."""
    return selected.filter(F.col("rule").isNotNull()).select(
        "organization_id", "trace_id", F.lit("score_call").alias("operation"),
        F.col("rule.rule_id").alias("rule_id"), F.col("rule.name").alias("rule_name"),
        F.col("rule.metrics").alias("metrics"), F.col("rule.custom_judges").alias("custom_judges"), *more)
