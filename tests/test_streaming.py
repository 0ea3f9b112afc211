"""Streams replayed from files must equal their batch forms."""
import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from spanquarry.operators import agents as A, alerts as AL
from spanquarry.plans.standins import Lake
from spanquarry.plans.wire import _feed, _settings, _watched
from spanquarry.schemas import RUN_KEY
from spanquarry.streaming import ingest as IN, rollups as RO, sinks as SI, stateful as ST, topics as TP

SF = "/root/testdata/sf0.001"


def replay(spark, df, folder, parts=4, order=None):
    """Write a frame as files, oldest rows first, and read it back as a stream, one file per batch."""
    data = df.orderBy(order or df.columns[-1]).collect()
    size = -(-len(data) // parts)
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_rollups(spark, tmp_path):
    lake = Lake(spark, SF)
    states = A.run_states(lake.traces, lake.costs, lake.evals, lake.scans)
    stream = replay(spark, states.withColumn("updated_at", F.col("updated_at").cast("timestamp")), str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    TP.run_once(stream, str(tmp_path / "cp"), RO.store_states(folder)).awaitTermination(120)
    show = lambda df: sorted(df.select(*RUN_KEY, "run_tokens", "span_count", "quality_min", "security_detections", F.round("run_cost", 6), F.round("quality_avg", 6)).collect())
    expected = show(A.rollup_record(states))
    assert show(RO.read_rollups(spark, folder)) == expected and len(glob.glob(folder + "/batch_id=*")) > 1
    # A batch that is written again replaces itself.
    again = spark.read.parquet(folder).filter("batch_id = 0").drop("batch_id")
    RO.store_states(folder)(spark.createDataFrame(again.collect(), again.schema), 0)
    assert show(RO.read_rollups(spark, folder)) == expected
    RO.compact(spark, folder, str(tmp_path / "compact"))
    assert show(RO.read_rollups(spark, str(tmp_path / "compact"))) == expected


def test_rate_alerts(spark, tmp_path):
    lake = Lake(spark, SF)
    batch = _watched(lake).select("organization_id", "metric", "event_id", "failed", "eval_failure_rate_above", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    stream = replay(spark, batch, str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    TP.run_once(ST.rate_alerts(stream), str(tmp_path / "cp"), TP.append_batches(folder)).awaitTermination(180)
    keys = ["organization_id", "metric", "ingested_at"]
    expected = AL.with_cooldown(AL.rate_breaches(AL.failure_rate(batch)), keys[:2]).select(*keys)
    assert sorted(spark.read.parquet(folder).select(*keys).collect()) == sorted(expected.collect())


def test_alerts_and_feed_on_a_stream(spark, tmp_path):
    lake = Lake(spark, SF)
    scans = lake.scans.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    stream = AL.security_alerts(replay(spark, scans, str(tmp_path / "in")), _settings(lake))
    folder = str(tmp_path / "out")
    TP.run_once(stream, str(tmp_path / "cp"), TP.append_batches(folder)).awaitTermination(120)
    ids = lambda df: sorted(r["event_id"] for r in df.select("event_id").collect())
    assert ids(spark.read.parquet(folder)) == ids(AL.security_alerts(lake.scans, _settings(lake)))
    feed = _feed(lake).withColumn("ts", F.col("ts").cast("timestamp"))
    live = TP.live_feed(TP.enriched(replay(spark, feed, str(tmp_path / "feed"))), "org2")
    TP.run_once(live, str(tmp_path / "cp2"), TP.append_batches(str(tmp_path / "live"))).awaitTermination(120)
    assert ids(spark.read.parquet(str(tmp_path / "live"))) == ids(TP.live_feed(TP.enriched(_feed(lake)), "org2"))


def test_replayed_events_count_once(spark, tmp_path):
    feed = _feed(Lake(spark, SF)).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    twice = feed.unionByName(feed)
    stream = IN.dedupe_stream(replay(spark, twice, str(tmp_path / "in"), 1), ["event_id"], delay="60 days")
    folder = str(tmp_path / "out")
    TP.run_once(stream, str(tmp_path / "cp"), TP.append_batches(folder)).awaitTermination(120)
    assert spark.read.parquet(folder).count() == feed.count()


def test_routes_on_a_stream(spark, tmp_path):
    docs = [{"trace_id": f"t{i}", "type": "llm", **({"_eval_config": {"metrics": ["m"]}} if i % 2 else {}), **({"_security_config": {}} if i % 3 == 0 else {}),
             **({"status": "running"} if i == 9 else {})} for i in range(10)]
    raw = spark.createDataFrame([("o", "k", json.dumps(d)) for d in docs], "organization_id string, api_key_prefix string, event string")
    stream = IN.route_events(IN.normalize_events(replay(spark, raw, str(tmp_path / "in"))))
    folder = str(tmp_path / "out")
    for attempt in ("cp", "again"):
        # The second run replays everything under another checkpoint; batches replace themselves.
        TP.run_once(stream, str(tmp_path / attempt), IN.write_routes(folder)).awaitTermination(120)
    counts = {r["route"]: r["count"] for r in spark.read.parquet(folder).groupBy("route").count().collect()}
    assert counts == {"traces": 10, "evaluate": 4, "secure": 3}


def test_topic_messages(spark):
    df = spark.createDataFrame([("o", "t")], "organization_id string, trace_id string")
    assert TP.as_messages(df).first().asDict() == {"key": "o", "value": '{"organization_id":"o","trace_id":"t"}'}


def feed_stream(spark, rows, schema, folder, sizes):
    """Rows in the given order as files of the given sizes, one file a batch."""
    at = 0
    for n, size in enumerate(sizes):
        part = spark.createDataFrame(rows[at:at + size], schema).coalesce(1)
        part.write.parquet(f"{folder}/{n:04d}")
        at += size
    assert at == len(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_registry_does_not_depend_on_order_or_batches(spark, tmp_path, seed):
    rng, start, schema = random.Random(seed), dt.datetime(2024, 5, 1), "event_id long, organization_id string, api_key_prefix string, trace_id string, kind string, event string, ts timestamp"
    rows = []
    for i in range(300):
        at = start + dt.timedelta(seconds=rng.randint(0, 4000))
        rows.append((i, f"o{i % 2}", f"k{i % 3}", f"t{rng.randint(0, 60)}", rng.choice(["started", "started", "persisted", "enriched", "note"]), "{}", at))
    rows += [(400, "o0", "k", "late", "persisted", "{}", start + dt.timedelta(seconds=3900)), (401, "o0", "k", "late", "started", "{}", start + dt.timedelta(seconds=3899)),
             (402, None, "k", "x", "started", "{}", start), (403, "o0", "k", "tie", "started", "{}", start + dt.timedelta(seconds=3950)), (404, "o0", "k", "tie", "enriched", "{}", start + dt.timedelta(seconds=3950))]
    head = rows[:300]
    rng.shuffle(head)
    rows = head + rows[300:]
    sizes = [61, 100, 44, 100] if seed == 1 else [5, 295, 5]
    stream = feed_stream(spark, rows, schema, str(tmp_path / "in"), sizes)
    out = str(tmp_path / "out")
    TP.run_once(ST.running_changes(stream, 600, delay="2 hours"), str(tmp_path / "cp"), TP.append_batches(out)).awaitTermination(180)
    feed, changes = spark.createDataFrame(rows, schema).filter("organization_id is not null"), spark.read.parquet(out)
    feed = feed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for seconds in (4000, 4300, 9000):
        at = str(start + dt.timedelta(seconds=seconds))
        want = sorted((r["organization_id"], r["trace_id"], r["event_id"]) for r in AL.running_traces(feed, at, 600).collect())
        assert sorted((r["organization_id"], r["trace_id"], r["event_id"]) for r in ST.running_now(changes, at, 600).collect()) == want
        assert want or seconds == 9000


def test_registry_says_when_a_run_expires(spark, tmp_path):
    start, schema = dt.datetime(2024, 5, 1), "event_id long, organization_id string, api_key_prefix string, trace_id string, kind string, event string, ts timestamp"
    at = lambda s: start + dt.timedelta(seconds=s)
    rows = [(1, "o", "k", "lost", "started", "{}", at(0)), (2, "o", "k", "done", "started", "{}", at(5)), (3, "o", "k", "done", "persisted", "{}", at(60)),
            (4, "o", "k", "again", "started", "{}", at(10)), (5, "o", "k", "again", "started", "{}", at(500)),
            (6, "o", "k", "done", "started", "{}", at(30)), (7, "o", "k", "other", "started", "{}", at(900)), (8, "o", "k", "tick", "note", "{}", at(901)), (9, "o", "k", "open", "started", "{}", at(1000))]
    stream = feed_stream(spark, rows, schema, str(tmp_path / "in"), [3, 3, 3])
    out = str(tmp_path / "out")
    TP.run_once(ST.running_changes(stream, 600, delay="2 minutes"), str(tmp_path / "cp"), TP.append_batches(out)).awaitTermination(180)
    log = [(r["trace_id"], r["event_id"], r["deleted"], r["expired"]) for r in spark.read.parquet(out).collect()]
    assert ("lost", 1, 1, True) in log and [x for x in log if x[3]] == [("lost", 1, 1, True)]  # the watermark stands at 880
    # a batch counts by its newest message: the run that started and ended in one is no news, and its late start stays out
    assert [x for x in log if x[0] == "done"] == [] and [x for x in log if x[0] == "again"] == [("again", 5, 0, False)]


def test_digest_stream_equals_its_batch_form_on_late_alerts(spark, tmp_path):
    rng, start = random.Random(4), dt.datetime(2024, 5, 1)
    schema = "organization_id string, digest string, summary string, event_id string, ingested_at timestamp"
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), rng.choice(["hourly", "hourly", "daily"]), f"line {rng.randint(0, 50)}", f"{i:04d}", start + dt.timedelta(seconds=rng.randint(0, 4 * 3600))) for i in range(600)]
    rows.append(("b", "hourly", "end", "9999", start + dt.timedelta(hours=30)))
    out = str(tmp_path / "out")
    stream = feed_stream(spark, rows, schema, str(tmp_path / "in"), [200, 150, 250, 1])
    TP.run_once(ST.alert_digests(stream, "hourly", most=7, tie="event_id", delay="5 hours"), str(tmp_path / "cp"), TP.append_batches(out)).awaitTermination(180)
    batch = spark.createDataFrame(rows[:-1], schema).withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))
    fields = ["organization_id", "events", "lines", "more"]
    show = lambda df: sorted((str(r["window_start"]), *[r[c] for c in fields]) for r in df.collect())
    assert show(spark.read.parquet(out)) == show(AL.alert_digest(batch, "hourly", tie=["event_id"], most=7))


def test_sinks_of_a_batch_count_together_and_once(spark, tmp_path):
    from spanquarry.operators.rules import scoring_jobs

    docs = [{"trace_id": f"t{i}", "type": "llm", "model": "m", **({"_eval_config": {"metrics": ["m"]}} if i % 4 == 1 else {}), **({"_security_config": {"guardrail": "g"}} if i % 3 == 0 else {}),
             **({"status": "running"} if i == 9 else {})} for i in range(40)]
    raw = spark.createDataFrame([("o", "k", json.dumps(d)) for d in docs], "organization_id string, api_key_prefix string, event string")
    rules = spark.createDataFrame([("o", "2024-01-01", "r1", "first", True, ["faith"], {"tone": 0.5}, 0.5, "root", [], ["M"]), ("o", "2024-01-02", "r2", "second", True, ["rel"], {}, 100.0, "all", [], [])],
                                  "organization_id string, created_at string, rule_id string, name string, enabled boolean, metrics array<string>, custom_judges map<string,double>, sample_rate double, span_scope string, integrations array<string>, models array<string>")
    routed = lambda df: IN.route_events(IN.normalize_events(df), rules)
    out = str(tmp_path / "out")
    for attempt in ("cp", "again"):  # the second run writes every batch once more
        TP.run_once(routed(replay(spark, raw, str(tmp_path / "in")) if attempt == "cp" else spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))),
                    str(tmp_path / attempt), SI.write_ingest(out)).awaitTermination(120)
    show = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    columns = ["organization_id", "trace_id", "operation", "rule_id", "rule_name", "metrics", "custom_judges"]
    jobs = scoring_jobs(routed(raw)).select(columns)
    assert show(SI.read_sink(spark, out, "rule_scores").select(columns)) == show(jobs) and jobs.count() == 30
    assert SI.read_sink(spark, out, "rule_scores").where("event is null or api_key_prefix != 'k'").isEmpty()
    assert [SI.read_sink(spark, out, s).count() for s in ("traces", "requested_scores", "scans")] == [40, 9, 13]
    # a batch that broke off before its record is invisible in every sink
    spark.read.parquet(f"{out}/traces/batch_id=0").write.parquet(f"{out}/traces/batch_id=99")
    assert SI.read_sink(spark, out, "traces").count() == 40
    assert sum(r["counts"]["rule_scores"] for r in SI.committed(spark, out).collect()) == 30
