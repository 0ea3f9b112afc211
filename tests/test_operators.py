"""Cases with literal inputs: what the stand-in tables cannot show."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanquarry.operators import alerts as AL, costing as C, datasets as D, judging as J, reviewing as R, running as RN, trajectories as TJ
from spanquarry.operators.versioned import latest
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def spans(spark, items):
    data = [("o", "run", t, p, i) for i, (t, p) in enumerate(items)]
    return spark.createDataFrame(data, "organization_id string, root_trace_id string, trace_id string, parent_id string, seq int")


def walk(spark, items):
    got = TJ.trajectory_steps(spans(spark, items)).collect()
    return [(r["span_id"], r["depth"]) for r in sorted(got, key=lambda r: r["path"])]


def test_deep_tree_is_depth_first(spark):
    items = [("root", None), ("a", "root"), ("b", "root"), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("a11", "a1")]
    assert walk(spark, items) == [("root", 0), ("a", 1), ("a1", 2), ("a11", 3), ("a2", 2), ("b", 1), ("b1", 2)]


def test_long_chain(spark):
    items = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(70)]
    assert walk(spark, items) == [(f"s{i}", i) for i in range(70)]


def test_repairs(spark):
    items = [("self", "self"), ("ghost", "gone"), ("self", None), ("", "self"), ("kid", "self")]
    assert walk(spark, items) == [("self", 0), ("_anon_3", 1), ("kid", 1), ("ghost", 0), ("_anon_2", 0)]


def test_cycles_are_listed_once(spark):
    got = walk(spark, [("root", None), ("x", "y"), ("y", "x"), ("below", "x")])
    assert got[0] == ("root", 0) and sorted(got[1:]) == [("below", 0), ("x", 0), ("y", 0)]


def test_a_cycle_in_a_wide_run_keeps_short_paths(spark):
    longest = []

    def cut(df):
        stored = TJ._cut(df)
        longest.append(stored.agg(F.max(F.size("path"))).first()[0])
        return stored

    items = [("root", None), *[(f"k{i:03}", "root") for i in range(300)], ("x", "y"), ("y", "x"), ("below", "x")]
    got = TJ.trajectory_steps(spans(spark, items), cut=cut).collect()
    depth = {r["trace_id"]: r["depth"] for r in got}
    assert len(got) == 304 and {depth[f"k{i:03}"] for i in range(300)} == {1} and {depth[c] for c in ("root", "x", "y", "below")} == {0}
    assert len(longest) <= 3 and max(longest) <= 4


def event(spark, doc, **cols):
    return spark.createDataFrame([("o", "run", 0, doc)], "organization_id string, root_trace_id string, seq int, doc string").select(
        "organization_id", "root_trace_id", "seq", F.parse_json("doc").alias("event"))


def test_grounding(spark):
    tool = event(spark, '{"type":"tool","function":"f","input":{"q":1},"output":"found"}')
    mcp = event(spark, '{"type":"llm","mcp_calls":[{"name":"m","server_label":"s","arguments":"a","output":"o"},{"name":"quiet"}]}').withColumn("seq", F.lit(1))
    chat = event(spark, '{"messages":[{"role":"assistant","tool_calls":[{"id":"c1","function":{"name":"g","arguments":"{}"}}]},{"role":"tool","tool_call_id":"c1","content":"r1"},'
                 '{"role":"user","content":[{"type":"tool_result","tool_use_id":"c1","content":"r2"}]}]}').withColumn("seq", F.lit(2))
    got = TJ.grounding(tool.unionByName(mcp).unionByName(chat).unionByName(tool.withColumn("seq", F.lit(3)))).first()["grounding"]
    assert got == ['Tool "f" (input: {"q":1}) returned:\nfound', 'Tool "m (MCP server: s)" (input: a) returned:\no',
                   'Tool "g" (input: {}) returned:\nr1', 'Tool "g" (input: {}) returned:\nr2']


def test_tool_calls_of_every_shape(spark):
    doc = ('{"tool_calls":[{"function":{"name":"a","arguments":"1"}},{"name":"b"}],"tool_uses":[{"name":"c","input":{"x":1}}],'
           '"function_calls":[{"name":"d","args":2}],"mcp_calls":[{"name":"e","output":"z"},{"type":"mcp_list","name":"no"}]}')
    calls = event(spark, doc).select(TJ.tool_calls("event").alias("c")).first()["c"]
    assert [(c["name"], c["kind"], c["arguments"]) for c in calls] == [("a", "tool", "1"), ("b", "tool", None), ("c", "tool", '{"x":1}'), ("d", "tool", "2"), ("e", "mcp", None)]


def agreement(spark, pairs):
    df = spark.createDataFrame([("o", float(j), float(h)) for j, h in pairs], "organization_id string, judge double, human double")
    return R.agreement_verdict(R.judge_agreement(df)).first()


@pytest.mark.parametrize("pairs,verdict", [
    ([(1, 1)] * 3, "insufficient"), ([(0.7, 1)] * 12, "matches_base_rate"), ([(0.9, 1)] * 6 + [(0.9, 0)] * 6, "matches_base_rate"),
    ([(0.2, 1)] * 9 + [(0.2, 0)] * 3, "weak"), ([(0.9, 1)] * 6 + [(0.8, 1)] * 6, "undetermined"),
    ([(1, 1), (0, 0)] * 6, "good"), ([(1, 1)] * 6 + [(0.7, 0.3)] * 6, "lenient"), ([(0.6, 1)] * 6 + [(0.1, 0.4)] * 6, "harsh")])
def test_verdicts(spark, pairs, verdict):
    assert agreement(spark, pairs)["verdict"] == verdict


def test_constant_side_has_no_correlation(spark):
    r = agreement(spark, [(0.7, h) for h in [0, 1] * 6])
    assert r["correlation"] is None and r["compared"] == 12
    assert agreement(spark, [(1, 1), (0, 0)] * 6)["correlation"] == pytest.approx(1.0)


def test_composite_renormalises(spark):
    parts = spark.createDataFrame([("o", "q", "a", 3.0), ("o", "q", "b", 1.0)], "organization_id string, slug string, metric string, weight double")
    scores = spark.createDataFrame([("o", 1, "a", 1.0), ("o", 1, "b", 0.0), ("o", 2, "a", 0.5), ("o", 3, "x", 1.0)], "organization_id string, k int, metric string, score double")
    got = {r["k"]: (r["value"], r["missing"], r["complete"]) for r in RN.composites(scores, parts, ["k"]).collect()}
    assert got == {1: (0.75, [], True), 2: (0.5, ["b"], False), 3: (None, ["a", "b"], False)}


def test_cost_rounding_and_missing_price(spark):
    price = spark.createDataFrame([(1, "P", "m", "Text", 1.0, 0.5, None, 100, 2.0, 1.0, 4.0)], "id long, provider string, model string, modality string, a double, b double, c double, d int, e double, f double, g double")
    price = price.toDF("id", "provider", "model", "modality", *C.RATES)
    calls = spark.createDataFrame([("p", "M", "Image", 100, 40, 10), ("p", "M", "Text", 101, 0, 10), ("p", "other", "Text", 1, 0, 1)],
                                  "provider string, model string, modality string, input_tokens long, cached_input_tokens long, output_tokens long")
    got = [r["cost_usd"] for r in C.estimate_cost(C.attach_price(calls, price)).orderBy("input_tokens").collect()]
    assert got == [None, pytest.approx(80e-6), pytest.approx(242e-6)]


def watched(spark, n=400, seed=3):
    rng = random.Random(seed)
    data = [("o", rng.choice(["a", "b"]), T0 + dt.timedelta(seconds=rng.randrange(0, 40000)), i, rng.random() < 0.4, 35.0) for i in range(n)]
    return data, spark.createDataFrame(data, "organization_id string, metric string, ingested_at timestamp_ntz, event_id int, failed boolean, eval_failure_rate_above double")


def brute_force(data):
    fired, rates, recent, last = [], {}, {}, {}
    for o, m, at, i, failed, limit in sorted(data, key=lambda r: (r[2], r[3])):
        window = recent.setdefault(m, [])
        window.append(failed)
        del window[:-30]
        rates[i] = (len(window), 100.0 * sum(window) / len(window))
        if len(window) >= 10 and rates[i][1] > limit and (m not in last or (at - last[m]).total_seconds() >= 600):
            last[m] = at
            fired.append((m, at))
    return rates, sorted(fired)


def test_rolling_rate_does_not_depend_on_pieces(spark):
    data, df = watched(spark)
    rates, _ = brute_force(data)
    for piece in (30, 64, 100_000):
        got = {r["event_id"]: (r["samples"], r["failure_rate"]) for r in AL.failure_rate(df, piece=piece).collect()}
        assert got.keys() == rates.keys() and all(got[i] == pytest.approx(rates[i]) for i in rates)


def test_cooldown(spark):
    data, df = watched(spark)
    alerts = AL.rate_breaches(AL.failure_rate(df))
    got = sorted((r["metric"], r["ingested_at"]) for r in AL.with_cooldown(alerts, ["organization_id", "metric"]).collect())
    assert got == brute_force(data)[1]


def test_cooldown_by_doubling_equals_reading_in_order(spark):
    rng, rows_, want = random.Random(12), [], set()
    start = dt.datetime(2024, 3, 1)
    for key, n, step in [("hot", 3000, 40.0), (None, 200, 900.0), ("dense", 800, 0.7), ("one", 1, 1.0), ("edge", 0, 0)]:
        at, times = start, []
        for _ in range(n):
            at += dt.timedelta(microseconds=rng.choice([0, 1, 250_000, int(step * 1e6 * rng.random() * 2)]) if key != "hot" else int(step * 1e6 * rng.choice([0.001, 1, 1, 60])))
            times.append(at)
        if key == "edge":
            times = [start + dt.timedelta(seconds=600 * i) for i in range(40)] + [start + dt.timedelta(seconds=599, microseconds=999_999), start]
        rows_ += [(key, t) for t in times]
        last = None
        for t in sorted(times):
            if last is None or t - last >= dt.timedelta(seconds=600):
                last = t
                want.add((key, t))
    rng.shuffle(rows_)
    got = AL.with_cooldown(spark.createDataFrame(rows_, "metric string, ingested_at timestamp_ntz"), ["metric"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert AL.with_cooldown(spark.createDataFrame([], "metric string, ingested_at timestamp"), ["metric"]).count() == 0


def test_digest_counts_what_it_leaves_out(spark):
    df = spark.range(50).select(F.lit("o").alias("organization_id"), F.lit("hourly").alias("digest"), F.format_string("line %02d", "id").alias("summary"),
                                F.lit(T0).cast("timestamp_ntz").alias("ingested_at"))
    r = AL.alert_digest(df, "hourly", most=40).first()
    assert (r["events"], len(r["lines"]), r["lines"][0], r["more"]) == (50, 40, "line 00", 10)


def test_latest_and_tombstones(spark):
    log = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 3, 0)], "k int, v int, deleted int")
    assert [r["k"] for r in latest(log, ["k"], "v", tombstone="deleted").collect()] == [2]


def test_few_shot_shapes(spark):
    docs = ['{"few_shot":[{"input":"q","output":"a"},{"question":"x"},"plain",{}]}', '{"examples":" ready "}', '{"few_shot":5}', '{}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r["x"] for r in df.orderBy("i").select(D.few_shot_of(F.parse_json("d")).alias("x")).collect()]
    assert got == ["Input: q\nOutput: a\n\nInput: x\nOutput: \n\nplain", "ready", "", ""]


def test_check_results_outside_range_are_errors(spark):
    df = spark.createDataFrame([('{"a":1}', "hello world", {"tier": "gold"})], "output string, expected string, metadata map<string,string>")
    checks = {"json": J.is_json("output"), "words": J.word_count("expected"), "tier": "metadata['tier'] = 'gold'", "text": "upper(output)",
              "close": J.similarity(F.col("output"), F.col("output")), "regex": J.matches("expected", "^hello.world$")}
    got = {r["metric"]: (r["score"], r["error"] is not None) for r in J.score_checks(df, checks, []).collect()}
    assert got == {"json": (1.0, False), "words": (None, True), "tier": (1.0, False), "text": (None, True), "close": (1.0, False), "regex": (1.0, False)}


def test_judge_rows(spark):
    def scorer(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return '{"score": 2, "reason": "r"}'

    df = spark.createDataFrame([(1, "q", "fine", ""), (2, "q", "bad", "")], "k int, question string, answer string, context string")
    got = {(r["k"], r["metric"]): (r["score"], r["error"], r["reason"]) for r in J.judge(df, {"relevance": "score {{answer}}", "odd": "score {{answer}}"}, scorer, ["k"], J.SUPPORTED_METRICS).collect()}
    assert got == {(1, "relevance"): (1.0, False, "r"), (2, "relevance"): (0.0, True, "judge error: down")}


def test_agentic_jobs_carry_every_span(spark):
    at = lambda i: T0 + dt.timedelta(milliseconds=37 * (i // 3))
    data = [("o", "long", f"t{i:05d}", at(i)) for i in range(1300)] + [("o", "long", "none", None), ("o", "short", "s", T0), ("o", "other", "x", T0)]
    random.Random(4).shuffle(data)
    df = spark.createDataFrame(data, "organization_id string, root_trace_id string, trace_id string, ingested_at timestamp_ntz")
    roots = spark.createDataFrame([("o", "long"), ("o", "long"), ("o", "short")], "organization_id string, root_trace_id string")
    want = {"long": ["none"] + [f"t{i:05d}" for i in range(1300)], "short": ["s"]}
    assert {r["root_trace_id"]: r["events"] for r in TJ.agentic_jobs(df, roots, F.col("trace_id")).collect()} == want
    cut = TJ.agentic_jobs(df, roots, F.col("trace_id"), {"depth": "fast"}, limit=7).collect()
    assert {r["root_trace_id"]: (r["events"], r["depth"]) for r in cut} == {k: (v[:7], "fast") for k, v in want.items()}
    got = sorted((r["root_trace_id"], r["position"], r["event"]) for r in TJ.agentic_job_rows(df, roots, F.col("trace_id")).collect())
    assert got == [(k, i, e) for k, v in want.items() for i, e in enumerate(v)]
