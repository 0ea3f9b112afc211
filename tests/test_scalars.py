import hashlib
import hmac
import math
import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanquarry.functions import ids as I, scalars as S
from spanquarry.functions.quantiles import exact_percentiles
from spanquarry.operators.monitor import bucket_minutes
from tests.conftest import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_ids(spark):
    good = "6F9619FF-8B86-D011-B42D-00CF4FC964FF"
    data = [("plain id",), (good,), ("{" + good + "}",), ("  ",), (None,), ("é✓",)]
    got = [r["x"] for r in spark.createDataFrame(data, "v string").select(I.coerce_trace_id("v").alias("x")).collect()]
    ns = I.TRACE_NAMESPACE
    assert got == [str(uuid.uuid5(ns, "plain id")), good.lower(), good.lower(), None, None, str(uuid.uuid5(ns, "é✓"))]


def test_hmac(spark):
    for secret in ("k", "k" * 100):
        assert one(spark, I.hmac_sha256("m", secret), m="a|b|é") == hmac.new(secret.encode(), "a|b|é".encode(), hashlib.sha256).hexdigest()


def python_bucket(rule, trace):
    return int.from_bytes(hashlib.sha256(f"{rule}:{trace}".encode()).digest()[:2], "big") / 65535 * 100


def test_sampling(spark):
    ids = [f"trace-{i}" for i in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids], "t string")
    cols = {r: I.in_sample("t", F.lit("rule-a"), r) for r in (0, 5, 10, 40, 100)}
    got = df.select("t", *[c.alias(f"r{r}") for r, c in cols.items()], I.in_sample("t", F.lit("rule-b"), 10).alias("b")).collect()
    for r in (5, 10, 40):
        assert {x["t"] for x in got if x[f"r{r}"]} == {t for t in ids if python_bucket("rule-a", t) < r}
    assert not any(x["r0"] for x in got) and all(x["r100"] for x in got)
    assert all(x["r40"] for x in got if x["r10"])
    assert abs(sum(x["r10"] for x in got) / 4000 - 0.1) < 0.02
    both = sum(x["r10"] and x["b"] for x in got)
    assert both < 0.5 * sum(x["r10"] for x in got)


def test_substitution_is_one_pass(spark):
    values = F.create_map(*[F.lit(x) for x in ("a", "{{b}} $b", "b", "B")])
    assert one(spark, S.substitute("t", values), t="{{ a }}-$b-${b}-{{nope}}-$ 5 {\"json\": 1}") == "{{b}} $b-B-B-{{nope}}-$ 5 {\"json\": 1}"
    assert one(spark, S.substitute("t", values), t="") == ""
    assert one(spark, S.placeholders("t"), t="{{x}} ${y} $z {{x}}") == ["x", "y", "z", "x"]


@pytest.mark.parametrize("raw,score", [
    ('{"score": 0.4}', 0.4), ('text {"score": 3} more', 1.0), ('{"score": -1}', 0.0), ("nothing", 0.0), ('[1]', 0.0),
    ('{"score": "0.5"}', 0.5), ('{"score": null}', 0.0), (None, 0.0)])
def test_judge_reply(spark, raw, score):
    df = spark.createDataFrame([(raw,)], "r string").select(S.reply_score(S.reply_json("r")).alias("x"))
    assert df.first()["x"] == score


def test_entropy_and_redaction(spark):
    text = "aB3$aB3$zz9"
    expected = -sum(p * math.log2(p) for p in (text.count(c) / len(text) for c in set(text)))
    assert abs(one(spark, S.entropy("t"), t=text) - expected) < 1e-9
    assert one(spark, S.redact("t"), t=" abcdefgh ") == "abcd••••"
    assert one(spark, S.redact("t"), t="abc") == "•••"


@pytest.mark.parametrize("model,provider", [
    ("gpt-5-mini", "openai"), ("CLAUDE-x", "anthropic"), ("groq/gpt-oss", "groq"), ("grok-3", "xai"), ("o4-mini", "openai"),
    ("magistral-1", "mistral"), ("", None), ("mystery", None)])
def test_providers(spark, model, provider):
    assert one(spark, S.provider_for_model("m"), m=model) == provider


def test_provider_names(spark):
    assert one(spark, S.normalize_provider("p"), p=" Google ") == "gemini"
    assert one(spark, S.provider_of_price_name("p"), p="OPENAI") == "openai"
    assert one(spark, S.price_name("p"), p="vertex") == "Google"


def test_tags(spark):
    raw = ["Prompt-A", " prompt-a ", "bad tag", "", "x" * 64, "ok/1.0_b"] + [f"t{i}" for i in range(40)]
    df = spark.createDataFrame([(raw,), (None,)], "t array<string>")
    got = [r["x"] for r in df.select(S.normalize_tags("t", most=25).alias("x")).collect()]
    assert got[0] == ["prompt-a", "ok/1.0_b", *[f"t{i}" for i in range(23)]] and got[1] == []
    assert one(spark, S.normalize_tags("t"), t=raw) == ["prompt-a", "ok/1.0_b", *[f"t{i}" for i in range(40)]]


def test_buckets_grow_with_the_window():
    sizes = [bucket_minutes(h) for h in range(1, 2000)]
    assert sizes == sorted(sizes) and bucket_minutes(1) == 5 and bucket_minutes(721) == 1440


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_percentiles(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("empty", None)], "k string, v double")
    got = exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    assert len(got) == 1
    for name, q in (("p0", 0), ("p50", 50), ("p95", 95), ("p100", 100)):
        assert got[0][name] == pytest.approx(np.percentile(values, q), rel=1e-9, abs=1e-6)


def test_percentiles_on_one_hot_group(spark):
    rng = random.Random(1)
    values = [rng.choice([0.1, 0.2, 5.0]) for _ in range(5000)] + [rng.random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", F.lit(1))
    row = exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert row["p50"] == pytest.approx(np.percentile(values, 50)) and row["p99"] == pytest.approx(np.percentile(values, 99))


def test_event_fields(spark):
    event = '{"messages":[{"role":"user","content":"hi"},{"role":"user","content":"  "},{"role":"assistant","content":"x"}],"output":null,"response":"yes","model":"m"}'
    df = spark.createDataFrame([(event,)], "e string").select(F.parse_json("e").alias("e"))
    r = rows(df.select(S.question_of("e").alias("q"), S.event_output("e").alias("o"), S.event_metadata("e").alias("m"), S.event_input("e").alias("i")))[0]
    assert r["q"] == "hi" and r["o"] == "yes" and r["m"] == {"model": "m"} and '"hi"' in r["i"]
