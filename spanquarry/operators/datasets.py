"""Evaluation datasets: imports from runs, task prompts, scoring jobs, enrichment."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col, page_of, strip
from spanquarry.functions.scalars import event_input, event_metadata, event_output, placeholders, substitute
from spanquarry.operators.versioned import latest
from spanquarry.schemas import THREATS

# Fixed values.
DEFAULT_METRICS = ["hallucination", "relevance"]
LOCAL_METRICS = ["relevance"]
OWN_NAMES = ["input", "expected", "expected_output", "few_shot"]


def new_runs(runs: DataFrame, examples: DataFrame, run_id: str = "trace_id", imported: str = "source_trace_id") -> DataFrame:
    """Runs that no example was made from yet."""
    seen = examples.select(F.col(imported).alias(run_id)).filter(F.col(run_id).isNotNull()).distinct()
    return runs.join(seen, run_id, "left_anti")


def import_runs(roots: DataFrame, examples: DataFrame, run_io: DataFrame, order: Sequence[Column],
                cap: int | None = None) -> DataFrame:
    """Past runs as examples: own input and output, else the run's; runs with neither are dropped.

    ``roots`` carries a variant ``event``; ``run_io`` has ``input`` and ``output`` per run.
    With a ``cap`` only the first in ``order`` are taken, by default all and without a sort.
    """
    keys = ["organization_id", "root_trace_id"]
    rows = new_runs(roots, examples).join(
        run_io.select(*keys, F.col("input").alias("_in"), F.col("output").alias("_out")), keys, "left")
    own = F.nullif(strip(event_input("event")), F.lit(""))
    rows = rows.withColumns({
        "input": F.coalesce(F.when(own.isNotNull(), event_input("event")), "_in", F.lit("")),
        "expected_output": F.coalesce(event_output("event"), F.when(own.isNull(), F.col("_out"))),
        "metadata": event_metadata("event")})
    text = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    filled = rows.filter(text("input") | text("expected_output"))
    return (filled if cap is None else page_of(filled, order, cap)).select(*keys, "input", "expected_output", "metadata")


def route_runs(runs: DataFrame, links: DataFrame) -> DataFrame:
    """Runs of linked agents with every dataset their agent feeds."""
    return runs.join(links.select("organization_id", "agent_key", "agent_kind", "dataset_id"),
                     ["organization_id", "agent_key", "agent_kind"])


def synthetic_event(text: Column, response: Column, trace_id: Column) -> Column:
    """Event of a text-only example, as JSON; an input that is a JSON list becomes messages."""
    parsed = F.try_parse_json(text)
    messages = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed)
    return F.to_json(F.struct(
        trace_id.alias("trace_id"), trace_id.alias("root_trace_id"), F.lit("llm").alias("type"),
        F.lit("DATASET").alias("integration"), F.coalesce(text, F.lit("")).alias("input"),
        F.coalesce(response, F.lit("")).alias("response"), messages.alias("messages")))


def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def few_shot_text(shots: Column, most: int | None = None) -> Column:
    """Examples (``array<struct<input, output>>``) as prompt text; of those that are not blank all, or the first ``most``."""
    line = lambda s: F.concat(F.lit("Input: "), F.coalesce(strip(s.input), F.lit("")), F.lit("\nOutput: "), F.coalesce(strip(s.output), F.lit("")))
    kept = F.filter(shots, lambda s: F.length(F.concat_ws("", strip(s.input), strip(s.output))) > 0)
    return F.coalesce(F.array_join(F.transform(_first(kept, most), line), "\n\n"), F.lit(""))


def few_shot_of(metadata, most: int | None = None) -> Column:
    """Few-shot text of a variant metadata object: a list of pairs or strings, or ready text."""
    raw = F.coalesce(*[F.try_variant_get(as_col(metadata), f"$.{k}", "variant") for k in ("few_shot", "examples")])
    kind = F.schema_of_variant(raw)
    shots = F.try_variant_get(raw, "$", "array<variant>")
    get = lambda v, names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))

    def block(v: Column) -> Column:
        question, answer = strip(get(v, ("input", "question", "user"))), strip(get(v, ("output", "expected", "answer", "assistant")))
        pair = F.concat(F.lit("Input: "), question, F.lit("\nOutput: "), answer)
        return F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))).when(
            F.schema_of_variant(v).startswith("OBJECT") & (F.length(F.concat(question, answer)) > 0), pair)

    listed = F.array_join(_first(F.array_compact(F.transform(shots, block)), most), "\n\n")
    return F.coalesce(F.when(kind == "STRING", strip(F.try_variant_get(raw, "$", "string"))).when(
        kind.startswith("ARRAY"), listed), F.lit(""))


def task_variables(text: Column, expected: Column, metadata: Column, few_shot: Column) -> Column:
    """Values a task template may use; example fields win over metadata of the same name."""
    own = {"input": text, "expected": expected, "expected_output": expected, "few_shot": few_shot}
    fixed = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    extra = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(OWN_NAMES))
    return F.map_concat(extra, fixed)


def render_prompt(template: Column, values: Column) -> Column:
    """Filled template; one without any variable gets the example's input appended."""
    filled = substitute(template, values)
    text = strip(F.coalesce(F.try_element_at(values, F.lit("input")), F.lit("")))
    appended = F.concat(F.regexp_replace(filled, r"\s+$", ""), F.lit("\n\n"), text)
    return F.when((F.size(placeholders(template)) == 0) & (F.length(text) > 0), appended).otherwise(filled)


def render_turns(template: Column, values: Column, system: str | None = None, messages: Column | None = None) -> Column:
    """Messages of a task step; the task's system text leads unless the step writes its own."""
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    if messages is None:
        turns = F.array(turn(F.lit("user"), render_prompt(template, values)))
    else:
        turns = F.transform(messages, lambda m: turn(F.coalesce(m.role, F.lit("user")), substitute(F.coalesce(m.content, F.lit("")), values)))
    if not system:
        return turns
    lead = F.concat(F.array(turn(F.lit("system"), F.lit(system))), turns)
    return F.when(F.exists(turns, lambda t: t.role == "system"), turns).otherwise(lead)


def reference_of(expected: Column, answer: Column) -> Column:
    """The reference to grade against: the expected output unless it is the answer itself."""
    e = strip(F.coalesce(expected, F.lit("")))
    return F.when((F.length(e) > 0) & (e != strip(F.coalesce(answer, F.lit("")))), e)


def run_jobs(examples: DataFrame, roots: DataFrame, grounding: DataFrame, run_id: str, kind: str,
             metrics: Sequence[str] | None = None) -> DataFrame:
    """Scoring-job rows of a run, one per example.

    Examples with a recorded source run are graded on its root event (columns
    ``root_trace_id, response`` of ``roots``), text-only ones on their own fields.
    Metric runs get a fresh id so that their scores cannot mix with production ones.
    """
    rows = examples.join(roots.select(F.col("root_trace_id").alias("source_trace_id"), F.col("response").alias("_response")), "source_trace_id", "left")
    rows = rows.join(grounding.select(F.col("root_trace_id").alias("source_trace_id"), "grounding"), "source_trace_id", "left")
    source = F.when(F.col("_response").isNotNull(), "trace").otherwise("text")
    fresh = F.sha2(F.concat_ws(":", F.lit(run_id), F.col("example_id")), 256)
    traced = source == "trace"
    answer = F.when(traced, F.col("_response")).otherwise(F.coalesce("expected_output", F.lit("")))
    operation = {"metrics": F.lit("score_call"), "security": F.lit("security_scan")}.get(
        kind, F.when(traced, "agent_eval").otherwise("score_call"))
    wanted = F.array(*[F.lit(m) for m in (metrics or DEFAULT_METRICS)])
    scored = operation == "score_call"
    return rows.select(
        F.lit(run_id).alias("run_id"), "example_id", source.alias("source"), operation.alias("operation"),
        (fresh if kind == "metrics" else F.when(traced, F.col("source_trace_id")).otherwise(fresh)).alias("trace_id"),
        answer.alias("answer"), F.when(scored, wanted).alias("metrics"),
        (reference_of(F.col("expected_output"), answer) if kind == "metrics" else F.lit(None).cast("string")).alias("reference"),
        F.when(traced & F.lit(kind == "metrics"), F.col("grounding")).alias("grounding"))


def local_results(results: DataFrame, depth: str | None) -> DataFrame:
    """Scoring jobs for answers produced elsewhere; metrics come from the run, else relevance."""
    names = [m for m in (depth or "").split(",") if m] or LOCAL_METRICS
    return results.select(
        "*", F.lit("LOCAL_EVAL").alias("integration"), F.lit("score_call").alias("operation"),
        F.array(*[F.lit(m) for m in names]).alias("metrics"),
        F.nullif("expected", F.lit("")).alias("reference"), F.lit("local").alias("source"))


def enrich_examples(examples: DataFrame, evals: DataFrame, scans: DataFrame, costs: DataFrame) -> DataFrame:
    """Scores, security verdict and run cost of each example's source trace."""
    key = "source_trace_id"
    name = F.coalesce(F.nullif("layer", F.lit("")), "metric")
    means = evals.filter(F.col("score").isNotNull()).groupBy(F.col("trace_id").alias(key), name.alias("_name")).agg(
        F.round(F.avg("score"), 4).alias("_score"))
    scores = means.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_score")))).alias("scores"))
    tie = [c for c in ("event_id",) if c in scans.columns]
    flags = [F.when(F.coalesce(F.col(f"{t}_detected"), F.lit(0)) > 0, t) for t in THREATS if f"{t}_detected" in scans.columns]
    verdict = latest(scans, ["trace_id"], "ingested_at", tie).select(
        F.col("trace_id").alias(key), F.coalesce(F.nullif("security_risk_level", F.lit("")), F.lit("clean")).alias("risk_level"),
        (F.col("should_block") == 1).alias("blocked"), F.array_compact(F.array(*flags)).alias("threats"))
    cost = costs.groupBy(F.col("root_trace_id").alias(key)).agg(F.sum("total_cost").cast("double").alias("cost"))
    return examples.join(scores, key, "left").join(verdict, key, "left").join(cost, key, "left")
