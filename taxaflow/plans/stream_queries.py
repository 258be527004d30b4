"""Registered queries that run as streams over the present input and read back their table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.plans import alert_inputs, metrics_inputs
from taxaflow.plans.alert_queries import ACCOUNT, COUNTS, FOUND, KEPT, LOGS, PARSED, TOPICS
from taxaflow.plans.metrics_queries import BACKLOG, BACKLOG_HOURLY, MISSING, MISSING_EXPECTED
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.session import new_shared_path
from taxaflow.sources.keyed_tables import read_table
from taxaflow.sources.tables import Tables
from taxaflow.streaming import alarms, logs, run

EVENT_TIME = "strftime(make_timestamp(timestamp_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S')"
ALERTS = (LOGS, KEPT, FOUND, PARSED.replace("'2024-02-01T00:00:00'", EVENT_TIME))
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL '10 minutes'"


def _log_batches(t: Tables) -> DataFrame:
    path = new_shared_path(t.spark, "logs")
    alert_inputs.log_batches(t).write.option("compression", "gzip").json(path)
    return logs.log_stream(t.spark, path)


class _EventStream:
    """The event table as a stream, for the projections of metric points."""

    def __init__(self, t: Tables):
        # A pattern serves a table that is one file as well as one that is a folder.
        self.events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.directory}/events.parque[t]")


def _appended(stream: DataFrame, t: Tables) -> DataFrame:
    path = new_shared_path(t.spark, "stream-table")
    run.append_to_table(stream, path).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@query(sql(*ALERTS, select=COUNTS))
def alert_counts_stream(t: Tables) -> DataFrame:
    """The counting job over the present logs; its quarantine goes to a table beside the counts."""
    path, apart = new_shared_path(t.spark, "stream-table"), new_shared_path(t.spark, "quarantine")
    logs.count_job(_log_batches(t), ACCOUNT, path, apart).awaitTermination()
    counts = read_table(t.spark, path).drop("hour")
    return counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(sql(*ALERTS, select="SELECT id, event, log_group FROM alerts WHERE log_source IS NULL OR alert_ts IS NULL"))
def quarantined_alerts_stream(t: Tables) -> DataFrame:
    """What the counting job set apart: no source known, no time, or a time far ahead of the log event."""
    return _appended(logs.quarantined(_log_batches(t), ACCOUNT), t).select("id", "event", "log_group")


@query(
    "WITH RECURSIVE "
    + ",".join((*ALERTS, TOPICS))
    + """,
starts(topic, thread_start) AS (
    SELECT topic, min(alert_ts) FROM topics GROUP BY topic
    UNION ALL
    SELECT s.topic, min(a.alert_ts) FROM starts s JOIN topics a
        ON a.topic = s.topic AND a.alert_ts >= s.thread_start + INTERVAL '2 hours' GROUP BY s.topic
)
SELECT topic, epoch_us(thread_start) // 1000000 AS thread_second FROM starts
WHERE thread_start + INTERVAL '1 second' <= (SELECT max(alert_ts) FROM topics) - INTERVAL '10 minutes'"""
)
def thread_starts_stream(t: Tables) -> DataFrame:
    """Threads whose first second has passed the watermark."""
    return _appended(logs.thread_starts_stream(logs.alert_stream(_log_batches(t), ACCOUNT)), t)


@query(
    "WITH RECURSIVE "
    + ",".join((*ALERTS, TOPICS))
    + """,
starts(topic, thread_start) AS (
    SELECT topic, min(alert_ts) FROM topics GROUP BY topic
    UNION ALL
    SELECT s.topic, min(a.alert_ts) FROM starts s JOIN topics a
        ON a.topic = s.topic AND a.alert_ts >= s.thread_start + INTERVAL '2 hours' GROUP BY s.topic
)
SELECT a.id, a.event, a.topic, a.alert_ts, s.thread_start, FALSE AS late FROM topics a JOIN starts s
    ON s.topic = a.topic AND a.alert_ts >= s.thread_start AND a.alert_ts < s.thread_start + INTERVAL '2 hours'
WHERE a.alert_ts + INTERVAL '1 second' <= (SELECT max(alert_ts) FROM topics) - INTERVAL '10 minutes'"""
)
def alert_threads_stream(t: Tables) -> DataFrame:
    """Alerts that have passed the watermark, each with its thread."""
    attached = logs.alert_threads_stream(logs.alert_stream(_log_batches(t), ACCOUNT))
    return _appended(attached, t).select("id", "event", "topic", "alert_ts", "thread_start", "late")


def _states(seconds: int) -> str:
    return f"""SELECT * FROM states s WHERE window_start + to_seconds({seconds}) <= {CLOSED}
        AND window_start >= (SELECT min(p.window_start) FROM periods p WHERE p.dimension = s.dimension)"""


@query(sql(BACKLOG, select=_states(300)))
def backlog_alarm_stream(t: Tables) -> DataFrame:
    points = metrics_inputs.depth_points(_EventStream(t))
    return _appended(alarms.alarm_state_stream(points, 100, "max", 300, evaluation_periods=3), t).drop("previous_state")


@query(sql(MISSING, select=_states(86400)))
def missing_data_alarm_stream(t: Tables) -> DataFrame:
    points = metrics_inputs.age_points(_EventStream(t))
    return _appended(alarms.alarm_state_stream(points, 400, "max", 86400, missing_breaches=True), t).drop("previous_state")


@query(sql(MISSING_EXPECTED, select=_states(86400).replace("periods p WHERE", "due p WHERE")))
def missing_data_alarm_expected_stream(t: Tables) -> DataFrame:
    """The alarm of index ages, with expected dimensions that never report."""
    points, expected = metrics_inputs.age_points(_EventStream(t)), metrics_inputs.expected_alarms(t)
    states = alarms.alarm_state_stream(points, 400, "max", 86400, missing_breaches=True, expected=expected)
    return _appended(states, t).drop("previous_state")


@query(
    sql(
        BACKLOG_HOURLY,
        select=f"""SELECT metric, dimension, window_start, previous_state, state, TRUE AS notify FROM (
            SELECT *, lag(state, 1, 'OK') OVER (PARTITION BY dimension ORDER BY window_start) AS previous_state FROM ({_states(3600)}))
        WHERE state <> previous_state""",
    )
)
def alarm_transitions_stream(t: Tables) -> DataFrame:
    points = metrics_inputs.depth_points(_EventStream(t))
    states = alarms.alarm_state_stream(points, 100, "max", 3600, evaluation_periods=3)
    return _appended(alarms.alarm_transitions_stream(states, F.lit(True)), t)
