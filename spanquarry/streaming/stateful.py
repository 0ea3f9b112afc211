"""Operators that keep state per key between batches (RocksDB state store)."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanquarry.functions.common import moment

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times are whole microseconds on the Python side, whatever the session's time zone is.
RUNNING_SCHEMA = "organization_id string, trace_id string, api_key_prefix string, event string, at long, event_id long, deleted int, expired boolean"
FIRE_SCHEMA = "organization_id string, metric string, ingested_at timestamp, samples int, failure_rate double"
DIGEST_SCHEMA = "organization_id string, window_start long, events long, lines array<string>, more long"
RATE_WINDOW, RATE_MINIMUM, COOLDOWN_SECONDS = 30, 10, 600
DIGEST_SECONDS = {"hourly": 3600, "daily": 86400}


def _age(at: int, event_id: int | None) -> tuple:
    return at, event_id is not None, event_id or 0


class Running(StatefulProcessor):
    """The newest message of a run, by (ts, event_id), for as long as it can matter.

    Not only a start is kept: a finish stays too, so that a start which arrives late
    does not bring the run back.  A timer at the message's time plus the time to live
    forgets it, and says so if the run was still open.  A run has one timer, which is
    set anew when it goes off and a newer message has come: every call on the state of
    a run costs a message between Python and the JVM, so there are two a batch, not six.
    """

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, event_id long, kind string, api_key_prefix string, event string")

    def _row(self, key, prefix, event, at, event_id, deleted: int, expired: bool) -> Row:
        return Row(organization_id=key[0], trace_id=key[1], api_key_prefix=prefix, event=event, at=at,
                   event_id=event_id, deleted=deleted, expired=expired)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timed = (row for row in rows if row.at is not None)
        newest = max(timed, key=lambda row: _age(row.at, row.event_id), default=None)
        if newest is None:
            return
        held = self.newest.get()
        if held is not None and _age(newest.at, newest.event_id) <= _age(held[0], held[1]):
            return
        started = newest.kind == "started"
        self.newest.update((newest.at, newest.event_id, newest.kind, newest.api_key_prefix, newest.event))
        if held is None:
            self.handle.registerTimer(newest.at // 1000 + self.ttl_ms)
        if started or (held is not None and held[2] == "started"):
            yield self._row(key, newest.api_key_prefix, newest.event, newest.at, newest.event_id, 0 if started else 1, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.newest.get()
        if held is None:
            return
        at, event_id, kind, prefix, event = held
        end = at // 1000 + self.ttl_ms
        if end > expiredTimerInfo.getExpiryTimeInMs() and end >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
            return
        self.newest.clear()
        if kind == "started":
            yield self._row(key, prefix, event, at, event_id, 1, True)

    def close(self) -> None:
        pass


def running_changes(stream: DataFrame, ttl_seconds: int = COOLDOWN_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Log of registry changes: a row per start, finish and expiry that was news when it arrived.

    Times are event times: messages may be out of order by ``delay``, an entry expires
    when the watermark has passed its time to live, and what the log ends in does not
    depend on how messages fell into batches (:func:`running_now`).
    """
    rows = stream.filter(F.col("kind").isin("started", "persisted", "enriched") & F.col("organization_id").isNotNull() & F.col("trace_id").isNotNull())
    slim = rows.select("organization_id", "trace_id", "api_key_prefix", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), "kind", "event")
    log = slim.withWatermark("ts", delay).groupBy("organization_id", "trace_id").transformWithState(
        Running(ttl_seconds), outputStructType=RUNNING_SCHEMA, outputMode="Append", timeMode="EventTime")
    return log.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def running_now(changes: DataFrame, as_of, ttl_seconds: int = COOLDOWN_SECONDS, api_key_prefix: str | None = None) -> DataFrame:
    """Runs that the change log holds open at ``as_of``; sort by ``ts`` descending for a page.

    The newest change of a run decides, its deletion before itself.  Entries older than
    the time to live are out even if the watermark has not reached their timer.
    """
    at = moment(as_of).cast("timestamp")
    newest = Window.partitionBy("organization_id", "trace_id").orderBy(F.desc("ts"), F.desc("event_id"), F.desc("deleted"))
    rows = changes.filter(F.col("ts") <= at).withColumn("_n", F.row_number().over(newest)).filter("_n = 1 and deleted = 0").drop("_n")
    rows = rows.filter(F.col("ts") >= at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
    return rows if api_key_prefix is None else rows.filter(F.col("api_key_prefix") == api_key_prefix)


class FailureRate(StatefulProcessor):
    """The last 30 outcomes and the time of the last alert of an (organization, metric)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "outcomes string, last_alert timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        recent = [c == "1" for c in held[0]] if held else []
        last = pd.Timestamp(held[1]) if held and held[1] is not None else None
        gap, fired = pd.Timedelta(seconds=COOLDOWN_SECONDS), []
        batch = pd.concat(list(rows)).sort_values(["ingested_at", "event_id"], kind="stable")
        for at, failed, limit in zip(batch["ingested_at"], batch["failed"], batch["eval_failure_rate_above"]):
            recent = [*recent[-(RATE_WINDOW - 1):], bool(failed)]
            rate = 100.0 * sum(recent) / len(recent)
            if len(recent) >= RATE_MINIMUM and rate > limit and (last is None or at - last >= gap):
                last = at
                fired.append({"organization_id": key[0], "metric": key[1], "ingested_at": at, "samples": len(recent), "failure_rate": rate})
        self.state.update(("".join("1" if x else "0" for x in recent), None if last is None else last.to_pydatetime()))
        if fired:
            yield pd.DataFrame(fired)

    def close(self) -> None:
        pass


def rate_alerts(watched: DataFrame) -> DataFrame:
    """Failure-rate alerts with their cooldown, over a stream of watched scores.

    The rows of a key are ordered within a batch; a smaller trigger bounds how many
    there are.
    """
    return watched.select("organization_id", "metric", "ingested_at", "event_id", "failed", "eval_failure_rate_above").groupBy(
        "organization_id", "metric").transformWithStateInPandas(
        FailureRate(), outputStructType=FIRE_SCHEMA, outputMode="Append", timeMode="None")


class Digest(StatefulProcessor):
    """The first ``most`` lines of an organization's window and how many there were, until the watermark closes it."""

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "at long, tie string, summary string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.count.exists()
        lines = list(self.lines.get()) if known else []
        n = self.count.get()[0] if known else 0
        for pdf in rows:
            n += int(pdf["n"].sum())
            kept = pdf[pdf["summary"].notna()]
            lines = sorted([*lines, *zip(kept["at"].tolist(), kept["tie"], kept["summary"])])[:self.most]
        self.lines.put(lines)
        self.count.update((n,))
        if not known:
            self.handle.registerTimer((int(key[1]) + self.seconds) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.count.exists():
            return
        n, lines = self.count.get()[0], [s for _, _, s in sorted(self.lines.get())]
        self.lines.clear()
        self.count.clear()
        yield pd.DataFrame([{"organization_id": key[0], "window_start": int(key[1]), "events": n, "lines": lines, "more": max(n - self.most, 0)}])

    def close(self) -> None:
        pass


def alert_digests(alerts: DataFrame, digest: str, *, most: int, ts: str = "ingested_at", tie: str = "summary", delay: str = "10 minutes") -> DataFrame:
    """Digests of a stream of alerts: one row per organization and clock-aligned window, once the watermark has passed it.

    Every task first reduces what it read to ``most`` lines per window and the number of
    the others, so a storm of one organization's alerts is not sent line by line to the
    task that holds its state.  State is ``most`` lines and a count for each open window.
    Alerts may be late by ``delay``.
    """
    seconds = DIGEST_SECONDS[digest]
    start = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"]
    rows = alerts.filter(F.col("digest") == digest).select(
        "organization_id", F.unix_seconds(start).alias("window_start"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(tie).cast("string").alias("tie"), F.coalesce("summary", F.lit("")).alias("summary"))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["at", "tie", "summary"], kind="stable")
            place = pdf.groupby(["organization_id", "window_start"], dropna=False).cumcount()
            first, rest = pdf[place < most].assign(n=1), pdf[place >= most]
            counts = rest.groupby(["organization_id", "window_start"], dropna=False, as_index=False).agg(at=("at", "max"), n=("at", "size")).assign(tie=None, summary=None)
            for part in (first, counts):
                if len(part):
                    yield part[["organization_id", "window_start", "at", "tie", "summary", "n"]]

    slim = rows.mapInPandas(reduced, "organization_id string, window_start long, at long, tie string, summary string, n long")
    done = slim.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", delay).groupBy("organization_id", "window_start").transformWithStateInPandas(
        Digest(most, seconds), outputStructType=DIGEST_SCHEMA, outputMode="Append", timeMode="EventTime")
    return done.withColumn("window_start", F.timestamp_seconds("window_start"))
