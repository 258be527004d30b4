"""Log alerting on streams: alert counts per minute and alert threads.

Parsing and matching are the batch operators. The counting job adds every batch to its table, so an
alert counts however late it is. Threads wait for the watermark; alerts up to its delay give the same
result as a batch over the same logs, and one that comes later joins the thread that covers it or is
marked late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from taxaflow import schemas
from taxaflow.operators import alerts as op
from taxaflow.operators.alerts import alert_counts
from taxaflow.session import new_shared_path, settle
from taxaflow.streaming.run import add_rows, add_to_table

LATENESS = "10 minutes"
MAX_AHEAD = "2 hours"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Log batch files as they arrive; ``.gz`` files are unpacked by their name."""
    reader = spark.readStream.schema(schemas.LOG_BATCH)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _alerts(batches: DataFrame, account: str, max_ahead: str) -> DataFrame:
    """Alerts flagged usable or not.

    An alert without a readable time of its own counts at the time of its log event. One without a
    known source, without a time, or stamped more than ``max_ahead`` after its log event is unusable;
    the last kind would push the watermark past alerts still to come.
    """
    event_time = F.timestamp_seconds(F.expr("timestamp_ms div 1000")).cast("timestamp_ntz")
    ahead = F.col("alert_ts") > event_time + F.expr(f"INTERVAL '{max_ahead}'")
    usable = F.col("log_source").isNotNull() & F.coalesce(~ahead, F.lit(False))
    return op.log_alerts(batches, account, event_time).withColumn("usable", usable)


def alert_stream(batches: DataFrame, account: str, lateness: str = LATENESS, max_ahead: str = MAX_AHEAD) -> DataFrame:
    """Usable alerts with ``alert_ts`` as a watermarked timestamp."""
    alerts = _alerts(batches, account, max_ahead).filter("usable").drop("usable")
    return alerts.withColumn("alert_ts", F.col("alert_ts").cast("timestamp")).withWatermark("alert_ts", lateness)


def quarantined(batches: DataFrame, account: str, max_ahead: str = MAX_AHEAD) -> DataFrame:
    """The unusable alerts, to be kept apart."""
    return _alerts(batches, account, max_ahead).filter("NOT usable").drop("usable")


def count_job(
    batches: DataFrame,
    account: str,
    counts_path: str,
    quarantine_path: str,
    checkpoint: str | None = None,
    max_ahead: str = MAX_AHEAD,
    once: bool = True,
) -> StreamingQuery:
    """Count the usable alerts per minute into one keyed table and keep the unusable ones in another.

    Every batch of logs is split and added to both tables; each notes the batches it holds, so a replay
    after a failure adds nothing. No alert is dropped for its age: every alert is in exactly one of the
    tables. Both are hashed by the hour, so a batch rewrites few buckets.
    """
    checkpoint = checkpoint or new_shared_path(batches.sparkSession, "stream")

    def add(batch: DataFrame, batch_id: int) -> None:
        alerts = settle(_alerts(batch, account, max_ahead))
        usable = alerts.filter("usable").drop("usable")
        hour = F.date_trunc("hour", F.col("window_start").cast("timestamp")).cast("timestamp_ntz")
        counts = alert_counts(usable).withColumn("hour", hour)
        add_to_table(counts, counts_path, ["namespace", "event_name", "window_start"], "occurrences", ["hour"], "counts", batch_id)
        apart = alerts.filter("NOT usable").drop("usable").withColumn("hour", F.expr("timestamp_ms div 3600000"))
        add_rows(apart, quarantine_path, ["hour"], "quarantine", batch_id)

    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def alert_counts_stream(alerts: DataFrame) -> DataFrame:
    """Counts per minute, each once the watermark has passed it; alerts later than that are not in it."""
    return alert_counts(alerts)


class ThreadChain(StatefulProcessor):
    """Chain of thread starts of one topic; the state is the start of the open thread."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_since = handle.getValueState("open_since", "second BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds = np.sort(np.concatenate([frame["second"].to_numpy() for frame in rows]))
        known = self.open_since.get()[0] if self.open_since.exists() else None
        starts, last = op.next_starts(seconds, known, self.span)
        self.open_since.update((last,))
        yield pd.DataFrame({"topic": key[0], "thread_second": np.array(starts, dtype="int64")})

    def close(self) -> None:
        pass


def thread_starts_stream(alerts: DataFrame, hours: int = op.THREAD_HOURS) -> DataFrame:
    """Start of each thread per topic, in event time.

    Alerts are first counted per topic and second, which both bounds what a topic's task sees and
    releases the seconds in order as the watermark passes.
    """
    seconds = (
        alerts.groupBy("topic", F.window("alert_ts", "1 second").alias("_w"))
        .agg(F.count("*").alias("_n"))
        .select("topic", F.unix_seconds("_w.start").alias("second"))
    )
    return seconds.groupBy("topic").transformWithStateInPandas(
        ThreadChain(hours * 3600), "topic STRING, thread_second BIGINT", "Append", "None"
    )


ATTACHED = ["id", "event", "log_group", "log_stream", "topic", "second", "thread_second", "late"]
ATTACHED_SQL = "id STRING, event STRING, log_group STRING, log_stream STRING, topic STRING, second BIGINT, thread_second BIGINT, late BOOLEAN"
WAITING = "id STRING, event STRING, log_group STRING, log_stream STRING, second BIGINT"


class ThreadSlot(StatefulProcessor):
    """Alerts of one topic in one slot of time, and the threads that reach into it.

    An alert waits until the watermark has passed its second; by then every thread that may cover it
    has started. The state is the slot's thread starts, at most two and one more for each late start,
    and the alerts that wait. It goes one span after the slot; what comes later is late.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "second BIGINT")
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        for frame in rows:
            starting = frame["id"].isna()
            if starting.any():
                self.starts.appendList([(int(s),) for s in frame["second"][starting]])
            alerts = frame[~starting]
            if len(alerts):
                names = ["id", "event", "log_group", "log_stream", "second"]
                self.waiting.appendList([tuple(r) for r in alerts[names].astype({"second": object}).itertuples(index=False)])
        yield self._release(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield self._release(key, timerValues.getCurrentWatermarkInMs() // 1000)

    def _release(self, key, passed: int) -> pd.DataFrame:
        """Alerts whose second the watermark has passed, with the last start that covers them."""
        topic, slot = key
        starts = np.array(sorted(s for (s,) in self.starts.get()), dtype="int64")
        out, kept = [], []
        for row in self.waiting.get():
            second = row[4]
            if second + 1 > passed:
                kept.append(tuple(row))
                continue
            at = int(np.searchsorted(starts, second, side="right")) - 1
            covered = at >= 0 and second < starts[at] + self.span
            out.append((*row[:4], topic, second, int(starts[at]) if covered else None, not covered))
        if out:
            self.waiting.put(kept) if kept else self.waiting.clear()
        due = min((r[4] + 1 for r in kept), default=(slot + 2) * self.span)
        if due <= passed:
            self.starts.clear()
        else:
            self._wake(due)
        frame = pd.DataFrame(out, columns=ATTACHED)
        return frame.astype({"second": "int64", "thread_second": "Int64", "late": "bool"})

    def _wake(self, due: int) -> None:
        """One timer, at the next time there is something to do."""
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for != due:
            if set_for is not None:
                self.handle.deleteTimer(set_for * 1000)
            self.handle.registerTimer(due * 1000)
            self.timer.update((due,))

    def close(self) -> None:
        pass


def alert_threads_stream(alerts: DataFrame, hours: int = op.THREAD_HOURS) -> DataFrame:
    """Alerts with the start of the thread that covers them, once the watermark has passed them.

    ``late`` marks alerts that came after the watermark and that no thread covers; all others have a
    ``thread_start``. Alerts and starts meet by topic and ``hours``-long slot of time, so a topic's
    alerts are spread over the slots; a thread reaches into at most two.
    """
    span = hours * 3600
    starts = thread_starts_stream(alerts, hours)
    slots = F.array_distinct(F.array(F.expr(f"thread_second div {span}"), F.expr(f"(thread_second + {span - 1}) div {span}")))
    nothing = F.lit(None).cast("string")
    begun = starts.select("topic", F.explode(slots).alias("slot"), *(nothing.alias(c) for c in ("id", "event", "log_group", "log_stream")), F.col("thread_second").alias("second"))
    second = F.unix_seconds("alert_ts")
    placed = alerts.select("topic", F.expr(f"unix_seconds(alert_ts) div {span}").alias("slot"), "id", "event", "log_group", "log_stream", second.alias("second"))
    both = placed.unionByName(begun)
    attached = both.groupBy("topic", "slot").transformWithStateInPandas(ThreadSlot(span), ATTACHED_SQL, "Append", "EventTime")
    times = {name: F.timestamp_seconds(column).cast("timestamp_ntz") for name, column in (("alert_ts", "second"), ("thread_start", "thread_second"))}
    return attached.withColumns(times).drop("second", "thread_second")
