import hashlib
import json

from pyspark.sql import functions as F

from spanquarry.functions.scalars import text_of
from spanquarry.operators.costing import load_prices
from spanquarry.sources import otlp as O, tables as TB, tabular as CSV, vendors as VN
from tests.conftest import rows


def payload(spark, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "payload string")


def kv(key, **value):
    return {"key": key, "value": value}


def test_otlp_two_spans(spark):
    llm = {"spanId": "a", "traceId": "t", "name": "chat", "attributes": [
        kv("openinference.span.kind", stringValue="LLM"), kv("llm.model_name", stringValue="m"),
        kv("llm.input_messages.0.message.role", stringValue="user"), kv("llm.input_messages.0.message.content", stringValue="hi"),
        kv("llm.token_count.total", intValue="7"), kv("output.value", stringValue="yo"),
        kv("list", arrayValue={"values": [{"intValue": "1"}, {"kvlistValue": {"values": [kv("k", boolValue=True)]}}]}),
        kv("llm.output_messages.0.message.tool_calls.0.tool_call.function.name", stringValue="f")]}
    tool = {"spanId": "b", "parentSpanId": "a", "name": "lookup", "attributes": [
        kv("openinference.span.kind", stringValue="TOOL"), kv("tool.parameters", stringValue='{"q": 1}')]}
    spans = O.payload_spans(payload(spark, {"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [llm]}]}, {"scopeSpans": [{"spans": [tool, {"name": "no id"}]}]}]}))
    attrs = spans.select(O.otlp_attrs(F.try_variant_get("span", "$.attributes", "variant")).alias("a")).select(F.to_json(O.attr("a", "list")).alias("x")).first()["x"]
    assert json.loads(attrs) == [1, {"k": True}]
    first, second = rows(O.spans_to_events(spans, "phoenix").orderBy("pos").select(
        "trace_id", "root_trace_id", "parent_id", "type", "function", "model", "response", "tokens", "tool_calls", "integration",
        F.transform("messages", lambda m: F.concat_ws(":", m.role, text_of(m.content))).alias("m")))
    assert (first["trace_id"], first["root_trace_id"], first["type"], first["model"], first["response"]) == ("a", "t", "llm", "m", "yo")
    assert first["tokens"]["total"] == 7 and first["m"] == ["user:hi"] and first["tool_calls"][0]["name"] == "f"
    assert first["integration"] == "OPENINFERENCE:phoenix"
    assert (second["root_trace_id"], second["parent_id"], second["type"], second["function"]) == ("b", "a", "tool", "lookup")
    assert second["tool_calls"] == [{"id": "b", "name": "lookup", "arguments": '{"q": 1}'}]


def test_multimodal_message(spark):
    url = "http://x/y.png"
    attrs = {"llm.input_messages.0.message.role": "user", "openinference.span.kind": "LLM",
             "llm.input_messages.0.message.contents.0.message_content.type": "text", "llm.input_messages.0.message.contents.0.message_content.text": "see",
             "llm.input_messages.0.message.contents.1.message_content.image.image.url": url, "llm.tools": [{"name": "t"}]}
    e = O.spans_to_events(O.payload_spans(payload(spark, {"spans": [{"span_id": "a", "attributes": attrs}]})), "x")
    row = e.select(F.to_json(F.get("messages", F.lit(0))["content"]).alias("c"), F.size("tools").alias("n")).first()
    parts = json.loads(row["c"])
    assert parts[0] == {"type": "text", "text": "see"} and row["n"] == 1
    assert parts[1]["_media_ref"] == {"kind": "image", "source": "url", "url": url, "sha256": hashlib.sha256(url.encode()).hexdigest()[:16]}


def test_premapped(spark):
    got = rows(O.premapped_events(payload(spark, {"events": [{"trace_id": "a", "type": "llm"}, {"type": "x"}, {"trace_id": "b", "root_trace_id": "a", "_external_source": "own"}]}), "src"))
    assert [(r["trace_id"], r["root_trace_id"], r["source"]) for r in got] == [("a", "a", "src"), ("b", "a", "own")]


def test_langsmith(spark):
    run = {"id": "r1", "trace_id": "t1", "parent_run_id": "p", "run_type": "llm", "name": "ChatModel",
           "inputs": {"messages": [[{"id": ["x", "HumanMessage"], "kwargs": {"content": "hello"}}, {"id": ["x", "AIMessage"], "kwargs": {"content": "a"}}]]},
           "outputs": {"generations": [[{"message": {"kwargs": {"tool_calls": [{"name": "f", "args": {"a": 1}}]}}}]], "llm_output": {"token_usage": {"total_tokens": 9}}},
           "extra": {"metadata": {"ls_model_name": "m"}}, "error": None}
    df = spark.createDataFrame([(json.dumps(run),)], "run string").select(F.parse_json("run").alias("run"))
    e = rows(VN.langsmith_runs_to_events(df))[0]
    assert e["messages"] == [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "a"}]
    assert e["tool_calls"][0] == {"id": "call_0", "name": "f", "arguments": '{"a": 1}'} and e["tokens"]["total"] == 9
    assert (e["model"], e["success"], e["root_trace_id"], e["parent_id"]) == ("m", True, "t1", "p")


def test_braintrust(spark):
    span = {"span_id": "s", "root_span_id": "r", "span_parents": ["p"], "span_attributes": {"type": "llm", "name": "n"},
            "input": [{"role": "user", "content": "q"}], "output": {"content": "a"}, "metadata": {"model": "m"}, "metrics": {"tokens": 3}}
    df = spark.createDataFrame([(json.dumps(span),)], "span string").select(F.parse_json("span").alias("span"))
    e = rows(VN.braintrust_spans_to_events(df))[0]
    assert (e["type"], e["response"], e["model"], e["tokens"]["total"], e["parent_id"], e["function"]) == ("llm", "a", "m", 3, "p", "n")


def test_tabular(spark, tmp_path):
    utf = tmp_path / "a.csv"
    utf.write_bytes("﻿ Question ,Answer,Extra\n hi ,yo,1\n,,\n , x,2\n\"multi\nline\",,\n".encode())
    df = CSV.read_tabular(spark, str(utf))
    assert df.columns == ["Question", "Answer", "Extra"] and df.count() == 3
    assert CSV.suggest_columns(df.columns) == {"input": "Question", "expected_output": "Answer"}
    got = rows(CSV.rows_to_examples(df, "Question", "Answer", "a.csv").orderBy("row"))
    assert [(r["input"], r["expected_output"], r["columns"]) for r in got] == [("hi", "yo", {"Extra": "1"}), ("multi\nline", None, {})]
    latin = tmp_path / "b.tsv"
    latin.write_bytes("prompt\tgold\ncafé\tx\n".encode("latin-1"))
    assert rows(CSV.read_tabular(spark, str(latin)))[0]["prompt"] == "café"


def test_row_numbers_follow_file_order(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id"))
    got = CSV.number_rows(df, "n", 2).collect()
    assert all(r["n"] == r["v"] + 2 for r in got)


def test_monthly_layout_and_prices(spark, tmp_path):
    df = spark.createDataFrame([("o2", "2024-01-05"), ("o1", "2024-01-06"), ("o1", "2024-02-01")], "organization_id string, d string").select(
        "organization_id", F.col("d").cast("timestamp").alias("ingested_at"))
    TB.write_monthly(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("month = 202401").count() == 2 and back.count() == 3
    sheet = spark.createDataFrame([(1, "P", "m", "Text"), (2, "", "m", "Text"), (3, "P", None, "Text")], "id long, provider string, model string, modality string")
    load_prices(sheet, str(tmp_path / "p"))
    load_prices(sheet, str(tmp_path / "p"), "append")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
