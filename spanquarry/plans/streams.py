"""Streams replayed from the tables: each ends in the rows that its batch form gives."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from spanquarry.functions.shared import folder
from spanquarry.operators import agents as A, alerts as AL
from spanquarry.plans.agents import RECORD, _record
from spanquarry.plans.registry import query
from spanquarry.plans.scoring import _rules
from spanquarry.plans.wire import RULED, SEC, _feed, _raw_events, _settings
from spanquarry.streaming import ingest as IN, rollups as RO, sinks as SI, stateful as ST, topics as TP

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arrivals(df: DataFrame, name: str, batches: int = 4) -> tuple[DataFrame, str]:
    """The rows as files in hash order, so that times are out of order between batches, read as a stream."""
    spark, place = df.sparkSession, folder(df.sparkSession, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "struct", "variant"))]), F.lit(batches)))
    dealt.write.partitionBy("_part").parquet(f"{place}/in")
    files = max(1, sum(1 for _ in spark.read.parquet(f"{place}/in").inputFiles()) // batches)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{place}/in")
    return stream, place


def _drain(stream: DataFrame, place: str, sink: Callable, query_name: str = "log") -> None:
    TP.run_once(stream, f"{place}/checkpoint-{query_name}", sink).awaitTermination()


def _append(stream: DataFrame, place: str) -> DataFrame:
    _drain(stream, place, TP.append_batches(f"{place}/out"))
    return stream.sparkSession.read.parquet(f"{place}/out").drop("batch_id")


@query("j02_registry_stream", """SELECT organization_id, trace_id, event_id FROM (SELECT concat('org', event_id % 5) AS organization_id, concat('u', user_id) AS trace_id, event_id, event_type, ts,
  row_number() OVER (PARTITION BY event_id % 5, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'signup', 'error')) x
WHERE rn = 1 AND event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(lake):
    feed = _feed(lake).withColumn("ts", F.col("ts").cast("timestamp"))
    stream, place = _arrivals(feed, "registry")
    changes = _append(ST.running_changes(stream, 86400, delay="400 days"), place)
    return ST.running_now(changes, feed.agg(F.max(F.col("ts").cast("string"))).first()[0], 86400).select("organization_id", "trace_id", "event_id")


@query("j07_digest_stream", f"""SELECT organization_id, time_bucket(INTERVAL 1 HOUR, ingested_at) AS window_start, count(*) AS events,
  list(summary ORDER BY ingested_at, CAST(event_id AS VARCHAR))[1:3] AS lines, greatest(count(*) - 3, 0) AS more FROM ({SEC}) s WHERE organization_id = 'org0' GROUP BY 1, 2""")
def _(lake):
    at = lambda c: F.col(c).cast("timestamp")
    alerts = AL.security_alerts(lake.scans.withColumn("ingested_at", at("ingested_at")), _settings(lake)).select("organization_id", "digest", "summary", "event_id", "ingested_at")
    # a last message far ahead lets the watermark close every window of the table
    end = alerts.limit(1).withColumns({"digest": F.lit("hourly"), "organization_id": F.lit("clock"), "ingested_at": F.lit("2100-01-01").cast("timestamp")})
    stream, place = _arrivals(alerts, "digest")
    end.write.parquet(f"{place}/in/_part=end")
    digests = _append(ST.alert_digests(stream, "hourly", most=3, tie="event_id", delay="400 days"), place)
    return digests.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j08_stream_rollups", RECORD)
def _(lake):
    stream, place = _arrivals(A.run_states(lake.traces, lake.costs, lake.evals, lake.scans), "rollups")
    _drain(stream, place, RO.store_states(f"{place}/out"))
    return _record(RO.read_rollups(lake.spark, f"{place}/out"))


@query("j09_rule_jobs", f"""SELECT organization_id, uuid AS trace_id, rule_id, CASE rule_id WHEN 'r5' THEN '' WHEN 'r2' THEN 'm2' ELSE 'm1' END AS metrics, model FROM ({RULED}) r""")
def _(lake):
    stream, place = _arrivals(_raw_events(lake), "ingest")
    routed = IN.route_events(IN.normalize_events(stream), _rules(lake))
    _drain(routed, place, SI.write_ingest(f"{place}/out"))
    _drain(routed, place, SI.write_ingest(f"{place}/out"), "replayed")  # every batch is written a second time
    jobs = SI.read_sink(lake.spark, f"{place}/out", "rule_scores")
    return jobs.select("organization_id", "trace_id", "rule_id", F.array_join("metrics", ",").alias("metrics"), F.try_variant_get(F.parse_json("event"), "$.model", "string").alias("model"))


@query("j10_replayed_events", "SELECT event_id FROM events")
def _(lake):
    feed = _feed(lake).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream, place = _arrivals(feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "replay")
    return _append(IN.dedupe_stream(stream, ["event_id"], delay="400 days"), place).select("event_id")


@query("j11_one_query_per_sink", "SELECT 'alerts' AS sink, event_id FROM events WHERE event_type = 'signup' AND event_id % 2 = 1 UNION ALL SELECT 'org2', event_id FROM events WHERE event_id % 5 = 2")
def _(lake):
    # Two queries with checkpoints of their own read every message; a restarted one reads none twice.
    stream, place = _arrivals(_feed(lake).withColumn("ts", F.col("ts").cast("timestamp")), "groups")
    sinks = {"alerts": TP.enriched(stream, "security"), "org2": TP.live_feed(stream, "org2")}
    for _ in range(2):
        for name, rows in sinks.items():
            _drain(rows.select("event_id"), place, TP.append_batches(f"{place}/{name}"), name)
    read = lambda name: lake.spark.read.parquet(f"{place}/{name}").select(F.lit(name).alias("sink"), "event_id")
    return read("alerts").unionByName(read("org2"))
