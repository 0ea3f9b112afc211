"""Runs as trees of spans: order, tool calls, grounding, media, pinned copies."""
from __future__ import annotations

import json
import sys
from itertools import groupby
from operator import itemgetter
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanquarry.functions.common import as_col, bind, first_non_empty, texts_of
from spanquarry.functions.scalars import event_input, event_output, preview, step_agent, text_of
from spanquarry.functions.shared import cut as stored, shared_dir
from spanquarry.operators.alerts import positions
from spanquarry.operators.versioned import latest, pick_first

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEDIA = texts_of("kind", "mime", "sha256")
CALL = "array<struct<name:string,kind:string,server:string,arguments:string,output:string>>"
RUN = ["organization_id", "root_trace_id"]
# Spans of a run that a task may hold at once.
GATHERED = 256


def pin_trajectories(traces: DataFrame, runs: DataFrame, captured_at: Column) -> DataFrame:
    """Rows to append to the retention-free log: every span of the chosen runs."""
    return traces.join(runs.select(*RUN).distinct(), RUN, "left_semi").withColumn("captured_at", captured_at)


def read_trajectories(log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Newest capture of each pinned span (sort by ``captured_at, trace_id`` to list a run)."""
    if runs is not None:
        log = log.join(runs.select(*RUN).distinct(), RUN, "left_semi")
    return latest(log, [*RUN, "trace_id"], "captured_at")


def root_event(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """The span that is the run's root, else its first span."""
    is_root = (F.col("trace_id") == F.col("root_trace_id")).cast("int")
    return pick_first(spans, RUN, [is_root.desc(), F.col(seq).asc()])


def trajectory_io(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """First non-empty input and last non-empty output of each run (columns ``input``, ``output``)."""
    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    return spans.groupBy(*RUN).agg(
        F.min_by(F.when(filled("input"), F.col("input")), F.when(filled("input"), F.col(seq))).alias("input"),
        F.max_by(F.when(filled("output"), F.col("output")), F.when(filled("output"), F.col(seq))).alias("output"))


def _known_run() -> Column:
    return F.col(RUN[0]).isNotNull() & F.col(RUN[1]).isNotNull()


def _anonymous(seq: str) -> Column:
    return F.concat(F.lit("_anon_"), F.col(seq))


def _given_parent() -> Column:
    return F.when(F.col("parent_id") != F.col("span_id"), F.nullif("parent_id", F.lit("")))


def _named(spans: DataFrame, seq: str) -> DataFrame:
    """``span_id`` of spans of a known run, with ``_id`` (never null) and ``_head`` (the first row of an id that was given)."""
    has_id = F.length(F.coalesce("trace_id", F.lit(""))) > 0
    apart = F.concat(F.lit("\0"), F.coalesce(F.col(seq).cast("string"), F.lit("")))  # spans without an id do not meet in one task
    keyed = spans.filter(_known_run()).withColumns({"_has": has_id, "_id": F.coalesce(F.when(has_id, F.col("trace_id")), apart)})
    w = Window.partitionBy(*RUN, "_id").orderBy(F.desc("_has"), F.asc_nulls_last(seq), F.asc("parent_id"))
    owner = F.col("_has") & F.coalesce(F.col(seq) == F.first(seq).over(w), F.lit(False))
    head = F.col("_has") & F.lag(F.lit(True)).over(w).isNull()
    return keyed.withColumns({"_head": head, "span_id": F.when(owner, F.col("_id")).otherwise(_anonymous(seq))}).drop("_has")


def link_spans(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """Repaired ids and parents of a run's spans.

    A missing or repeated id gets a name of its own, so that the span is still listed;
    a parent that is the span itself or was never stored makes the span a root.
    ``seq`` is a string or number that orders the spans of a run.

    Spans are shuffled twice, by id and by parent: the ids that parents are looked up in
    read the exchange of the spans, whose columns the order behind ``_head`` needs too.
    """
    named = _named(spans, seq)
    ids = named.filter("_head").select(*RUN, F.col("_id").alias("_parent"), F.lit(True).alias("_known"))
    linked = named.drop("_id", "_head").withColumn("_parent", _given_parent()).join(ids, [*RUN, "_parent"], "left")
    linked = linked.withColumn("parent", F.when(F.col("_known"), F.col("_parent"))).drop("_parent", "_known")
    lost = spans.filter(~_known_run())
    return linked.unionByName(lost.withColumns({"span_id": _anonymous(seq), "parent": F.lit(None).cast("string")}))


def trajectory_steps(spans: DataFrame, seq: str = "seq",
                     cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Depth and path of every span; sorting a run by ``path`` lists it depth first.

    Runs of up to ``GATHERED`` spans are shuffled once and walked in memory.  Longer
    ones, found by a count, are never gathered (:func:`_doubled_steps`, which takes
    ``cut``).  Spans in a cycle or below one are listed at depth 0, after the tree.
    """
    sizes = spans.groupBy(*RUN).agg(F.count("*").alias("_spans"))
    long = stored(sizes.filter((F.col("_spans") > GATHERED) & _known_run()).select(*RUN))
    if long.isEmpty():
        return _walked_steps(spans, seq)
    short = _walked_steps(spans.join(long, RUN, "left_anti"), seq)
    return short.unionByName(_doubled_steps(spans.join(long, RUN, "left_semi"), seq, cut))


def _key(spans: DataFrame, seq: str) -> Column:
    return F.col(seq).cast("string") if dict(spans.dtypes)[seq] == "string" else F.lpad(F.col(seq).cast("string"), 20, "0")


def _walked_steps(spans: DataFrame, seq: str) -> DataFrame:
    """Steps of runs that one task can hold: one shuffle by run, then the rows of a run follow each other."""
    rows = _named(spans.select(*RUN, "trace_id", "parent_id", seq).repartition(*RUN), seq)
    slim = rows.select(*RUN, "span_id", "trace_id", _given_parent().alias("_given"), F.col(seq).alias("seq"), _key(spans, seq).alias("_key"))
    return slim.sortWithinPartitions(*RUN).mapInArrow(_walk, (
        f"{RUN[0]} string, {RUN[1]} string, span_id string, trace_id string, parent string, seq {dict(spans.dtypes)[seq]}, depth int, path array<string>"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seq_type, done, held = None, [], 0

    def rows() -> Iterator[tuple]:
        nonlocal seq_type
        for batch in batches:
            seq_type = batch.schema.field("seq").type
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def batch() -> pa.RecordBatch:
        types = [pa.string()] * 5 + [seq_type, pa.int32(), pa.list_(pa.string())]
        names = [*RUN, "span_id", "trace_id", "parent", "seq", "depth", "path"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    for run, of_run in groupby(rows(), key=itemgetter(0, 1)):
        for step in _run_steps([row[2:] for row in of_run]):
            done.append((*run, *step))
            held += len(step[-1])
            if held >= 50_000:
                yield batch()
                done, held = [], 0
    if done:
        yield batch()


def _run_steps(rows: list[tuple]) -> Iterator[tuple]:
    """Steps of one run from (span_id, trace_id, given parent, seq, key); the rows of one span_id share their paths."""
    ids = {row[1] for row in rows}
    nodes: dict[str, list] = {}
    for span_id, _, given, _, key in rows:
        nodes.setdefault(span_id, []).append((given if given in ids else None, key))
    paths, opened = {}, set()  # a path is None in a cycle and below it
    for start in nodes:
        todo = [start]
        while todo:
            at = todo.pop()
            if at in paths:
                continue
            if at not in opened:
                opened.add(at)
                above = [p for p, _ in nodes[at] if p in nodes and p not in paths and p not in opened]
                if above:
                    todo += [at, *above]
                    continue
            paths[at] = [None if q is None else [*q, key] for p, key in nodes[at]
                         for q in (paths.get(p, [None]) if p in nodes and p is not None else [[]])]
    for span_id, trace_id, given, seq, key in rows:
        if span_id is not None:
            for path in paths[span_id]:
                yield (span_id, trace_id, given if given in ids else None, seq,
                       0 if path is None else len(path) - 1, ["~", key] if path is None else path)


def _doubled_steps(spans: DataFrame, seq: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Steps of runs of any size.

    Paths are found by pointer doubling: each round joins a span with the ancestor it
    knows and takes over that ancestor's knowledge, so a tree of depth d needs log2(d)
    rounds, and a run may be of any size because it is never gathered.  While a span
    below a root is not placed yet, every round places one (its ancestor at the depth
    the round reaches); what a round without any leaves over hangs in a cycle, as does a
    span whose path is longer than its run has spans.  Such spans are listed once each,
    at depth 0, after the tree; their paths grow to at most four times the greatest depth
    of a placed span (to two where all are roots).  There is no limit on depth.

    ``cut`` stores an intermediate result (by default a reliable checkpoint) so that a
    lost executor does not replay every round.
    """
    cut = cut or _cut
    linked = stored(link_spans(spans, seq))
    key = _key(spans, seq)
    sizes = linked.groupBy(*[F.col(c).alias(f"_{c}") for c in RUN]).agg(F.count("*").alias("_spans"))
    same_run = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RUN]
    state = cut(linked.join(sizes, same_run).select(*RUN, "_spans", "span_id", F.col("parent").alias("up"), F.array(key).alias("path")))
    unplaced = lambda: state.filter(F.col("up").isNotNull()).count()
    before, left = None, unplaced()
    while left and left != before:
        above = state.select(*RUN, F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        moved = state.join(above, [*RUN, "up"], "left").select(
            *RUN, "_spans", "span_id", F.col("_up").alias("up"),
            F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
            (F.col("up").isNotNull() & (F.size("path") > F.col("_spans"))).alias("_loop"))
        state = cut(moved.withColumn("up", F.when(~F.col("_loop"), F.col("up"))).withColumn(
            "path", F.when(F.col("_loop"), F.lit(None)).otherwise(F.col("path"))).drop("_loop"))
        before, left = left, unplaced()
    looped = F.col("up").isNotNull() | F.col("path").isNull()
    own = linked.select(*RUN, "span_id", "trace_id", "parent", F.col(seq).alias("seq"), key.alias("_key"))
    placed = own.join(state.select(*RUN, "span_id", "path", looped.alias("_loop")), [*RUN, "span_id"])
    return placed.select(
        *RUN, "span_id", "trace_id", "parent", "seq",
        F.when(F.col("_loop"), 0).otherwise(F.size("path") - 1).alias("depth"),
        F.when(F.col("_loop"), F.array(F.lit("~"), F.col("_key"))).otherwise(F.col("path")).alias("path"))


def _cut(df: DataFrame) -> DataFrame:
    """Store a round's result in the session's checkpoint directory."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def parents(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """Each span with its repaired parent; null for roots."""
    return link_spans(spans, seq).select(*RUN, "span_id", "parent")


def tool_calls(event) -> Column:
    """Tool and MCP calls of a variant event across the four shapes that occur."""
    e = as_col(event)
    get = lambda v, p: F.try_variant_get(v, p, "variant")
    text = lambda v, p: F.try_variant_get(v, p, "string")
    items = lambda key: F.coalesce(F.try_variant_get(e, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))

    def call(name, kind, server, arguments, output):
        return F.struct(
            name.alias("name"), F.lit(kind).alias("kind"), server.alias("server"),
            preview(text_of(arguments)).alias("arguments"), preview(text_of(output)).alias("output"))

    none = F.lit(None).cast("string")
    nothing = F.parse_json(F.lit("null"))
    shapes = [
        F.transform(items("tool_calls"), lambda c: call(
            first_non_empty(text(c, "$.function.name"), text(c, "$.name")), "tool", none,
            F.coalesce(get(c, "$.function.arguments"), get(c, "$.arguments")), nothing)),
        F.transform(items("tool_uses"), lambda c: call(text(c, "$.name"), "tool", none, get(c, "$.input"), nothing)),
        F.transform(items("function_calls"), lambda c: call(text(c, "$.name"), "tool", none, get(c, "$.args"), nothing)),
        F.transform(
            F.filter(items("mcp_calls"), lambda c: F.coalesce(text(c, "$.type"), F.lit("mcp_call")) == "mcp_call"),
            lambda c: call(text(c, "$.name"), "mcp", text(c, "$.server_label"), get(c, "$.arguments"), get(c, "$.output"))),
    ]
    every = F.concat(*[s.cast(CALL) for s in shapes])
    return F.filter(every, lambda c: F.coalesce(c["name"], F.lit("")) != "")


def _block(name: Column, given: Column, output: Column) -> Column:
    def text(x: Column) -> Column:
        head = F.concat(F.lit('Tool "'), F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("tool")), F.lit('"'))
        args = F.coalesce(F.concat(F.lit(" (input: "), x["args"], F.lit(")")), F.lit(""))
        return F.concat(head, args, F.lit(" returned:\n"), x["out"])

    return bind(F.struct(name.alias("name"), preview(given).alias("args"), preview(output).alias("out")), text)


def grounding_blocks(event) -> Column:
    """What the tools of one span returned, as text blocks in order of appearance."""
    e = as_col(event)
    get = lambda v, p: F.try_variant_get(v, p, "variant")
    text = lambda v, p: F.try_variant_get(v, p, "string")
    raw = lambda v, p: text_of(get(v, p))
    rows = lambda v, p: F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.array().cast("array<variant>"))

    kind = F.lower(F.coalesce(text(e, "$.type"), F.lit("")))
    is_tool = F.contains(kind, F.lit("tool")) | F.contains(kind, F.lit("mcp"))
    own = F.array(F.when(is_tool, _block(first_non_empty(text(e, "$.function"), text(e, "$.name")), raw(e, "$.input"), raw(e, "$.output"))))

    def mcp(c):
        server = first_non_empty(text(c, "$.server_label"), text(c, "$.server_name"))
        label = F.concat(F.coalesce(F.nullif(text(c, "$.name"), F.lit("")), F.lit("mcp")),
                         F.when(server.isNotNull(), F.concat(F.lit(" (MCP server: "), server, F.lit(")"))).otherwise(" (MCP)"))
        return _block(label, F.coalesce(raw(c, "$.arguments"), raw(c, "$.input")), raw(c, "$.output"))

    messages = rows(e, "$.messages")
    calls = F.filter(F.flatten(F.transform(messages, lambda m: rows(m, "$.tool_calls"))), lambda c: text(c, "$.id").isNotNull())
    name_of = lambda c: F.coalesce(text(c, "$.function.name"), text(c, "$.name"))
    args_of = lambda c: F.coalesce(raw(c, "$.function.arguments"), raw(c, "$.arguments"))
    matching = lambda cid: F.try_element_at(F.filter(calls, lambda c: text(c, "$.id") == cid), F.lit(-1))

    def from_message(m):
        call = matching(text(m, "$.tool_call_id"))
        reply = _block(F.coalesce(name_of(call), text(m, "$.name")), args_of(call), raw(m, "$.content"))
        parts = F.filter(rows(m, "$.content"), lambda b: text(b, "$.type") == "tool_result")
        results = F.transform(parts, lambda b: _block(
            name_of(matching(text(b, "$.tool_use_id"))), args_of(matching(text(b, "$.tool_use_id"))), raw(b, "$.content")))
        return F.when(F.lower(F.coalesce(text(m, "$.role"), F.lit(""))) == "tool", F.array(reply)).otherwise(results)

    return F.array_compact(F.concat(own, F.transform(rows(e, "$.mcp_calls"), mcp), F.flatten(F.transform(messages, from_message))))


def grounding_rows(spans: DataFrame, event: str = "event", seq: str = "seq") -> DataFrame:
    """Distinct grounding blocks of each run, one row each, with ``at``: the span and place where they first appear."""
    rows = spans.select(*RUN, F.col(seq).alias("_s"), F.posexplode(grounding_blocks(event)).alias("_i", "block"))
    return rows.groupBy(*RUN, "block").agg(F.min(F.struct("_s", "_i")).alias("at"))


def grounding(spans: DataFrame, event: str = "event", seq: str = "seq", most: int | None = None) -> DataFrame:
    """The blocks of each run as one list in order of appearance, all or the first ``most``; use rows where runs are long."""
    kept = grounding_rows(spans, event, seq)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(*RUN).orderBy("at"))
        kept = kept.withColumn("_n", rank).filter(F.col("_n") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("at", "block")))
    return kept.groupBy(*RUN).agg(F.transform(ordered, lambda x: x.block).alias("grounding"))


@F.pandas_udf(MEDIA)
def _media(events: pd.Series) -> pd.Series:
    def walk(node, out):
        if isinstance(node, dict):
            ref = node.get("_media_ref")
            if isinstance(ref, dict):
                item = {k: ref.get(k) for k in ("kind", "mime", "sha256")}
                if item not in out:
                    out.append(item)
        for child in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()):
            walk(child, out)
        return out

    return events.map(lambda text: None if text is None else walk(json.loads(text), []))


def media_refs(event_json) -> Column:
    """Distinct media references anywhere in an event; other events send Python a null."""
    e = as_col(event_json)
    return F.coalesce(_media(F.when(F.contains(e, F.lit("_media_ref")), e)), F.array().cast(MEDIA))


def display_steps(spans: DataFrame, event: str = "event", most: int | None = None) -> DataFrame:
    """Display columns of each span: name, agent, model, texts (whole or the first ``most`` characters), calls."""
    e = F.col(event)
    get = lambda p: F.try_variant_get(e, p, "string")
    return spans.withColumns({
        "type": F.coalesce(get("$.type"), F.lit("llm")), "name": first_non_empty(get("$.function"), get("$.name"), get("$.api")),
        "agent": step_agent(event), "model": F.nullif(get("$.model"), F.lit("")),
        "input": preview(event_input(event), most), "output": preview(event_output(event), most), "calls": tool_calls(event)})


def trajectory_stats(steps: DataFrame) -> DataFrame:
    """Spans, tool and MCP calls, agents, models and type counts of each run.

    Agents, models and types are made distinct before they are gathered, so a list is
    as long as the number of different names, not of spans.
    """
    n = lambda kind: F.sum(F.size(F.filter("calls", lambda c: c.kind == kind)))
    heads = steps.groupBy(*RUN).agg(F.count("*").alias("spans"), n("tool").alias("tools"), n("mcp").alias("mcp"))
    names = steps.select(*RUN, F.explode(F.array(
        F.struct(F.lit("agent").alias("what"), F.col("agent").alias("value")),
        F.struct(F.lit("model").alias("what"), F.col("model").alias("value")),
        F.struct(F.lit("type").alias("what"), F.col("type").alias("value")))).alias("x")).select(*RUN, "x.*")
    counted = names.filter(F.col("value").isNotNull()).groupBy(*RUN, "what", "value").agg(F.count("*").alias("_n"))
    of = lambda what: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("value"))))
    types = F.collect_list(F.when(F.col("what") == "type", F.struct("value", "_n")))
    lists = counted.groupBy(*RUN).agg(
        of("agent").alias("agents"), of("model").alias("models"), F.map_from_entries(F.array_sort(types)).alias("types"))
    return heads.join(lists, RUN, "left")


def agentic_job_rows(traces: DataFrame, roots: DataFrame, event: Column) -> DataFrame:
    """The spans of each agentic-evaluation job, one row each: ``position`` (from 0, in time order) and ``event``.

    Spans without a time come first. A run of any size is neither sorted in one task nor gathered.
    The chosen runs are stored first, so that Spark knows how few they are before it shuffles spans, and
    their spans once, as they are both counted and ranked.
    """
    chosen = stored(roots.select(*RUN).distinct())
    ts = F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    rows = traces.join(chosen, RUN, "left_semi").select(*RUN, "trace_id", ts.alias("_ts"), event.alias("event"))
    return positions(stored(rows), RUN, "_ts", "trace_id", bucket="second").select(*RUN, F.col("pos").alias("position"), "event")


def agentic_jobs(traces: DataFrame, roots: DataFrame, event: Column, options: dict[str, str] | None = None,
                 limit: int | None = None) -> DataFrame:
    """One agentic-evaluation job per run with its spans in time order, all or the first ``limit``; use rows where runs are long."""
    kept = agentic_job_rows(traces, roots, event)
    if limit is not None:
        kept = kept.filter(F.col("position") < limit)
    ordered = F.array_sort(F.collect_list(F.struct("position", "event")))
    jobs = kept.groupBy(*RUN).agg(F.transform(ordered, lambda x: x["event"]).alias("events"))
    return jobs.select(*RUN, F.lit("agent_eval").alias("operation"), "events",
                       *[F.lit(v).alias(k) for k, v in (options or {}).items()])
