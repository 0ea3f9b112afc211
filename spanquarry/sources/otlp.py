"""OpenTelemetry payloads (OTLP-JSON, flat spans, mapped events) as trace events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanquarry.functions.common import as_col, bind, first_non_empty, lookup
from spanquarry.functions.scalars import text_of, truthy

# Span kind to event type; anything else is a chain step.
KIND_TO_TYPE = {"LLM": "llm", "CHAT": "llm", "TOOL": "tool", "RETRIEVER": "retrieval", "EMBEDDING": "llm",
                "RERANKER": "tool", "AGENT": "chain", "CHAIN": "chain"}
PART = r"^message\.contents\.(\d+)\.message_content\.(.+)$"
MESSAGES = "array<struct<role:string,content:variant>>"


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _any_value(v: Column, depth: int = 3) -> Column:
    """JSON text of an OTLP AnyValue; nested lists and maps to a fixed depth."""
    scalar = F.coalesce(
        F.to_json(_variant(v, "$.stringValue")), F.when(_text(v, "$.intValue").rlike(r"^-?\d+$"), _text(v, "$.intValue")),
        F.to_json(_variant(v, "$.intValue")), F.to_json(_variant(v, "$.doubleValue")), F.to_json(_variant(v, "$.boolValue")))
    if depth == 0:
        return F.coalesce(scalar, F.to_json(v))
    items = F.array_join(F.transform(_list(v, "$.arrayValue.values"), lambda x: _any_value(x, depth - 1)), ",")
    pairs = F.array_join(F.transform(_list(v, "$.kvlistValue.values"), lambda kv: F.concat(
        F.to_json(_variant(kv, "$.key")), F.lit(":"), _any_value(_variant(kv, "$.value"), depth - 1))), ",")
    return F.coalesce(
        scalar, F.when(_variant(v, "$.arrayValue").isNotNull(), F.concat(F.lit("["), items, F.lit("]"))),
        F.when(_variant(v, "$.kvlistValue").isNotNull(), F.concat(F.lit("{"), pairs, F.lit("}"))), F.to_json(v))


def otlp_attrs(attributes) -> Column:
    """Attributes as ``map<string, variant>``, from a key / value list or a plain object."""
    a = as_col(attributes)
    pairs = F.transform(F.filter(_list(a), lambda kv: _text(kv, "$.key").isNotNull()),
                        lambda kv: F.struct(_text(kv, "$.key").alias("key"), _variant(kv, "$.value").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later.key == p.key))
    listed = F.map_from_entries(F.transform(last, lambda p: F.struct(p.key, F.try_parse_json(_any_value(p.value)))))
    return F.when(F.schema_of_variant(a).startswith("ARRAY"), listed).otherwise(
        F.coalesce(F.try_variant_get(a, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def payload_spans(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Every span of every payload, in order: nested OTLP or a flat ``spans`` list."""
    rows = payloads.withColumn("_p", F.try_parse_json(payload))
    nested = F.transform(_list(F.col("_p"), "$.resourceSpans"), lambda r: F.coalesce(
        F.try_variant_get(r, "$.scopeSpans", "array<variant>"), F.try_variant_get(r, "$.instrumentationLibrarySpans", "array<variant>"),
        F.array().cast("array<variant>")))
    spans = F.flatten(F.transform(F.flatten(nested), lambda s: _list(s, "$.spans")))
    every = F.when(_variant(F.col("_p"), "$.resourceSpans").isNotNull(), spans).otherwise(_list(F.col("_p"), "$.spans"))
    rest = [c for c in payloads.columns if c != payload]
    return rows.select(*rest, F.posexplode(every).alias("pos", "span"))


def attr(attrs, key: str) -> Column:
    return F.try_element_at(as_col(attrs), F.lit(key))


def attr_text(attrs, key: str) -> Column:
    return text_of(attr(attrs, key))


def _indexed(attrs: Column, prefix: str) -> Column:
    """Entries under ``prefix.<n>.`` as (index, tail, value)."""
    entries = F.filter(F.map_entries(attrs), lambda e: e.key.rlike("^" + prefix.replace(".", r"\.") + r"\.\d+\."))
    return F.transform(entries, lambda e: F.struct(
        F.regexp_extract(e.key, prefix.replace(".", r"\.") + r"\.(\d+)\.", 1).try_cast("int").alias("i"),
        F.regexp_replace(e.key, "^" + prefix.replace(".", r"\.") + r"\.\d+\.", "").alias("tail"), e.value.alias("value")))


def _value(entries: Column, tail: str) -> Column:
    return F.get(F.transform(F.filter(entries, lambda e: e.tail == tail), lambda e: e.value), F.lit(0))


def media_part(url: Column) -> Column:
    """JSON of an image part without its payload."""
    ref = F.struct(F.lit("image").alias("kind"), F.lit("url").alias("source"), url.alias("url"),
                   F.substring(F.sha2(url, 256), 1, 16).alias("sha256"))
    return F.to_json(F.struct(F.lit("image_url").alias("type"), ref.alias("_media_ref")))


def _parts(entries: Column) -> Column:
    """Content parts of one message as JSON texts, in index order."""
    rows = F.transform(F.filter(entries, lambda e: e.tail.rlike(PART)), lambda e: F.struct(
        F.regexp_extract(e.tail, PART, 1).try_cast("int").alias("j"), F.regexp_extract(e.tail, PART, 2).alias("tail"), text_of(e.value).alias("value")))
    index = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r.j)))

    def part(j: Column) -> Column:
        mine = F.filter(rows, lambda r: r.j == j)
        url = first_non_empty(_value(mine, "image.image.url"), _value(mine, "image.url"))
        text = _value(mine, "text")
        return F.when(url.isNotNull(), media_part(url)).when(
            text.isNotNull(), F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))

    return F.array_compact(F.transform(index, part))


def collect_messages(attrs, base: str) -> Column:
    """``base.<n>.message...`` attributes as an ordered list of messages."""
    def built(entries: Column) -> Column:
        index = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e.i)))

        def message(i: Column) -> Column:
            mine = F.filter(entries, lambda e: e.i == i)
            whole = bind(_parts(mine), lambda p: F.when(F.size(p) > 0, F.concat(F.lit("["), F.array_join(p, ","), F.lit("]"))))
            return F.struct(text_of(_value(mine, "message.role")).alias("role"),
                            F.coalesce(F.try_parse_json(whole), _value(mine, "message.content")).alias("content"))

        return F.transform(index, message)

    return bind(_indexed(as_col(attrs), base), built)


def collect_tool_calls(attrs) -> Column:
    """Indexed tool calls of output messages as (id, name, arguments); null when there are none."""
    mark = ".tool_call.function."
    keys = F.filter(F.map_entries(as_col(attrs)), lambda e: F.contains(e.key, F.lit(mark)) & F.contains(e.key, F.lit("tool_calls.")))
    rows = F.transform(keys, lambda e: F.struct(
        F.substring_index(e.key, mark, 1).alias("head"), F.substring_index(e.key, mark, -1).alias("tail"), text_of(e.value).alias("value")))
    heads = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r.head)))

    def call(head: Column) -> Column:
        mine = F.filter(rows, lambda r: r.head == head)
        return F.struct(head.alias("id"), _value(mine, "name").alias("name"),
                        F.coalesce(_value(mine, "arguments"), _value(mine, "arguments.json")).alias("arguments"))

    named = F.filter(F.transform(heads, call), lambda c: F.coalesce(c["name"], F.lit("")) != "")
    return bind(named, lambda c: F.when(F.size(c) > 0, c))


def _maybe_json(v: Column) -> Column:
    t = F.trim(text_of(v))
    return F.coalesce(F.when(t.rlike(r"^[\[{]"), F.try_parse_json(t)), v)


def collect_tools(attrs) -> Column:
    """Tool schemas offered to the model, from a list or from indexed attributes."""
    direct = F.transform(_list(attr(attrs, "llm.tools")), _maybe_json)
    rows = F.filter(_indexed(as_col(attrs), "llm.tools"), lambda e: e.tail == "tool.json_schema")
    index = F.array_sort(F.transform(rows, lambda e: e.i))
    indexed = F.transform(index, lambda i: _maybe_json(F.get(F.transform(F.filter(rows, lambda e: e.i == i), lambda e: e.value), F.lit(0))))
    return F.when(F.size(direct) > 0, direct).when(F.size(rows) > 0, indexed)


def spans_to_events(spans: DataFrame, source: str = "openinference", span: str = "span") -> DataFrame:
    """Events of spans; spans without an id are dropped."""
    s = F.col(span)
    pick = lambda *paths: first_non_empty(*[_text(s, p) for p in paths])
    rows = spans.withColumn("_a", otlp_attrs(_variant(s, "$.attributes"))).withColumns({
        "trace_id": pick("$.span_id", "$.spanId", "$.context.span_id"),
        "_trace": pick("$.trace_id", "$.traceId", "$.context.trace_id"),
        "parent_id": pick("$.parent_id", "$.parentSpanId", "$.parent_span_id"),
    }).filter(F.col("trace_id").isNotNull())
    a = F.col("_a")
    at = lambda *keys: F.coalesce(*[truthy(attr(a, k)) for k in keys])
    kind = F.upper(F.coalesce(at("openinference.span.kind"), pick("$.span_kind"), F.lit("")))
    given = attr(a, "input.value")
    parsed = _maybe_json(given)
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    rows = rows.withColumns({
        "type": lookup(KIND_TO_TYPE, kind, F.lit("chain")), "_structured": collect_messages(a, "llm.input_messages"),
        "_replies": collect_messages(a, "llm.output_messages"), "_name": pick("$.name"), "_input": F.when(~is_list, text_of(parsed)),
        "_listed": F.when(is_list, F.try_variant_get(parsed, "$", MESSAGES))})
    as_variant = F.try_variant_get(F.to_variant_object(F.struct(F.col("_input").alias("v"))), "$.v", "variant")
    said = F.array(F.struct(F.lit("user").alias("role"), as_variant.alias("content")))
    tool = F.coalesce(at("tool.name"), at("tool_call.function.name"), F.col("_name"))
    args = F.coalesce(at("tool.parameters"), at("tool_call.function.arguments"), at("input.value"), F.lit("{}"))
    own_call = F.array(F.struct(F.col("trace_id").alias("id"), tool.alias("name"), args.alias("arguments")))
    is_llm, is_tool = F.col("type") == "llm", F.col("type") == "tool"
    rest = [c for c in spans.columns if c != span]
    return rows.select(
        *rest, F.lit(f"OPENINFERENCE:{source}" if source else "OPENINFERENCE").alias("integration"), "type", "trace_id",
        F.coalesce("_trace", "trace_id").alias("root_trace_id"), "parent_id", F.lit(True).alias("success"), F.lit(source).alias("source"),
        F.when(is_tool, tool).otherwise(F.col("_name")).alias("function"),
        F.when(F.size("_structured") > 0, F.col("_structured")).when(F.col("_listed").isNotNull(), F.col("_listed"))
         .when(F.col("_input").isNotNull(), said).alias("messages"),
        F.when(F.size("_structured") == 0, F.col("_input")).alias("input"),
        F.coalesce(attr_text(a, "output.value"), F.when(F.size("_replies") > 0, text_of(F.element_at("_replies", -1)["content"]))).alias("response"),
        F.when(is_llm, at("llm.model_name", "model")).alias("model"),
        F.when(is_llm, F.struct(*[attr_text(a, f"llm.token_count.{k}").try_cast("bigint").alias(k) for k in ("prompt", "completion", "total")])).alias("tokens"),
        F.when(is_llm, collect_tools(a)).alias("tools"),
        F.when(is_llm, collect_tool_calls(a)).when(is_tool & tool.isNotNull(), own_call).alias("tool_calls"))


def premapped_events(payloads: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """Events that arrive already mapped; those without an id are dropped."""
    rows = payloads.select(F.posexplode(_list(F.try_parse_json(payload), "$.events")).alias("pos", "event"))
    own = _text(F.col("event"), "$.trace_id")
    return rows.filter(F.coalesce(own, F.lit("")) != "").select(
        own.alias("trace_id"), first_non_empty(_text(F.col("event"), "$.root_trace_id"), own).alias("root_trace_id"),
        F.coalesce(_text(F.col("event"), "$._external_source"), F.lit(source)).alias("source"), "event")
