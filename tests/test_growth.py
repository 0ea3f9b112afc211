"""What large tables make expensive: shuffles, stored tables and calls on state, each counted on a few rows."""
import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from spanquarry.operators import trajectories as TJ
from spanquarry.streaming import stateful as ST

SPANS = "organization_id string, root_trace_id string, trace_id string, parent_id string, seq int"


def forest(spark, seed, sizes):
    """Runs with chains, cycles, unknown parents, missing ids and ids given twice."""
    rng, data = random.Random(seed), []
    for run, n in enumerate(sizes):
        for i in range(n):
            up = rng.choice([None, "", "gone", *[f"s{rng.randrange(n)}" for _ in range(2)], *[f"s{max(i - 1, 0)}"] * 4])
            data.append(("o", f"r{run}", rng.choice([None, ""]) if rng.random() < 0.1 else f"s{i if rng.random() < 0.9 else rng.randrange(n)}", up, i))
    data += [(None, "r0", "a", "b", 1), ("o", None, "a", "b", 1)]
    return spark.createDataFrame(data, SPANS)


def listed(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_parents_shuffle_spans_twice(spark, tmp_path):
    forest(spark, 3, [20, 30]).write.parquet(str(tmp_path / "spans"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = TJ.parents(spark.read.parquet(str(tmp_path / "spans")))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 2


def test_spans_of_unknown_runs_are_no_owners(spark):
    df = spark.createDataFrame([(None, "r", "a", None, 1), ("o", "r", "a", None, 2), ("o", "r", "b", "a", 3), ("o", None, "c", "a", 4)], SPANS)
    got = sorted((r["span_id"], r["parent"]) for r in TJ.parents(df).collect())
    assert got == [("_anon_1", None), ("_anon_4", None), ("a", None), ("b", "a")]


def test_short_runs_store_no_rounds(spark):
    def cut(df):
        raise AssertionError("a short run needs no round")

    chain = [("o", "run", f"s{i:03}", f"s{i - 1:03}" if i else None, i) for i in range(200)]
    got = {r["span_id"]: (r["depth"], len(r["path"])) for r in TJ.trajectory_steps(spark.createDataFrame(chain, SPANS), cut=cut).collect()}
    assert got == {f"s{i:03}": (i, i + 1) for i in range(200)}


@pytest.mark.parametrize("seed", [1, 2])
def test_walked_runs_equal_doubled_ones(spark, seed):
    df = forest(spark, seed, [1, 9, 25])
    assert listed(TJ._walked_steps(df, "seq")) == listed(TJ._doubled_steps(df, "seq"))


def test_rows_that_come_twice_have_each_others_paths(spark):
    twice = [("o", "run", "root", None, "root"), ("o", "run", "kid", "root", "kid")] * 2
    df = spark.createDataFrame(twice, SPANS.replace("seq int", "seq string"))
    got = listed(TJ._walked_steps(df, "seq"))
    assert got == listed(TJ._doubled_steps(df, "seq")) and len(got) == 4 + 8


def test_long_and_short_runs_are_listed_together(spark):
    df = forest(spark, 5, [TJ.GATHERED + 1, 7])
    got = TJ.trajectory_steps(df)
    assert listed(got) == listed(TJ._doubled_steps(df, "seq"))


def test_job_rows_read_the_spans_once(spark, tmp_path):
    data = [("o", f"r{i % 4}", f"t{i}", dt.datetime(2024, 1, 1)) for i in range(40)]
    spark.createDataFrame(data, "organization_id string, root_trace_id string, trace_id string, ingested_at timestamp_ntz").write.parquet(str(tmp_path / "spans"))
    roots = spark.createDataFrame([("o", "r1"), ("o", "r1")], "organization_id string, root_trace_id string")
    rows = TJ.agentic_job_rows(spark.read.parquet(str(tmp_path / "spans")), roots, F.col("trace_id"))
    assert not [f for f in rows.inputFiles() if str(tmp_path) in f]  # counted and ranked from the stored rows
    assert sorted(r["event"] for r in rows.collect()) == sorted(f"t{i}" for i in range(1, 40, 4))


def test_the_registry_makes_few_calls_on_state():
    calls, held = [], []
    state = SimpleNamespace(get=lambda: calls.append("get") or (held[-1] if held else None), exists=lambda: calls.append("exists") or bool(held),
                            update=lambda v: calls.append("update") or held.append(v), clear=lambda: calls.append("clear") or held.clear())
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda t: calls.append(("timer", t)), deleteTimer=lambda t: calls.append(("delete", t)))
    running = ST.Running(600)
    running.init(handle)
    message = lambda at, i, kind: Row(at=at * 1_000_000, event_id=i, kind=kind, api_key_prefix="k", event="{}")
    batch = lambda *rows: [(r.event_id, r.deleted, r.expired) for r in running.handleInputRows(("o", "run"), iter(rows), None)]
    assert batch(message(5, 1, "started"), message(3, 9, "persisted")) == [(1, 0, False)]
    assert calls == ["get", "update", ("timer", 605_000)]
    calls.clear()
    assert batch(message(100, 2, "started")) == [(2, 0, False)] and batch(message(50, 3, "persisted")) == []
    assert calls == ["get", "update", "get"]
    calls.clear()
    expire = lambda at, mark: [(r.event_id, r.deleted, r.expired) for r in running.handleExpiredTimer(
        ("o", "run"), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: at))]
    assert expire(605_000, 650_000) == [] and calls == ["get", ("timer", 700_000)]  # a newer message: the timer is set anew
    assert expire(700_000, 700_001) == [(2, 1, True)] and not held
    batch(message(5, 1, "started")), batch(message(100, 2, "started"))
    assert expire(605_000, 900_000) == [(2, 1, True)]  # the watermark has passed both
