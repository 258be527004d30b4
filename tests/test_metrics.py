from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import metrics as op

DAY = "INTERVAL '1 day'"


def now():
    return F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'")


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-{text}")


def ms(text):
    return int(at(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def jobs(spark, *rows):
    data = [(q, f"j{i}", s, c, v, m, r) for i, (q, s, c, v, m, r) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.JOBS)


def test_job_counts_horizon(spark, rows):
    frame = jobs(
        spark,
        ("prod-a", "FAILED", ms("09T00:00:00.900"), 1, 1, None),
        ("prod-a", "FAILED", ms("09T00:00:01"), 1, 1, None),
        ("prod-a", "SUCCEEDED", ms("01T00:00:00"), 1, 1, None),
        ("prod-b", "RUNNING", ms("01T00:00:00"), 1, 1, None),
        ("prod-b", "ODD", ms("09T12:00:00"), 1, 1, None),
        ("dev-a", "FAILED", ms("09T12:00:00"), 1, 1, None),
    )
    args = ("prod", now(), F.expr(DAY))
    assert rows(op.job_status_counts(frame, *args), "status", "n") == [("FAILED", 1), ("RUNNING", 1)]
    assert op.job_failure_percent(frame, *args).first().failed_percent == 50.0
    assert op.job_failure_percent(frame, "none", now(), F.expr(DAY)).count() == 0


def test_timed_out_executions_always_count(spark, rows):
    frame = spark.createDataFrame(
        [
            ("a", "arn:x:prod-1", "TIMED_OUT", at("01")),
            ("b", "arn:x:prod-1", "FAILED", at("01")),
            ("c", "arn:x:prod-1", "RUNNING", None),
            ("d", "arn:x:dev-1", "RUNNING", None),
            ("e", "arn:x:prod-1", "ABORTED", at("09T00:00:01")),
        ],
        schemas.EXECUTIONS,
    )
    got = op.execution_status_counts(frame, "prod", now(), F.expr(DAY))
    assert rows(got, "status", "n") == [("ABORTED", 1), ("RUNNING", 1), ("TIMED_OUT", 1)]
    assert op.execution_failure_percent(frame, "prod", now(), F.expr(DAY)).first().failed_percent == 0.0


def points(spark, *values):
    return spark.createDataFrame([("depth", "q", at(t), float(v)) for t, v in values], schemas.METRIC_POINTS)


def test_sum_alarm_is_strict(spark, rows):
    frame = points(spark, ("01T00:01:00", 0), ("01T00:06:00", 0), ("01T00:09:59", 1))
    assert rows(op.sum_alarm(frame), "window_start", "breach") == [(at("01T00:00:00"), False), (at("01T00:05:00"), True)]


def test_backlog_needs_three_periods_in_a_row(spark):
    frame = points(
        spark, ("01T00:00:00", 101), ("01T00:05:00", 150), ("01T00:10:00", 101), ("01T00:15:00", 100),
        ("01T00:20:00", 200), ("01T00:30:00", 200), ("01T00:35:00", 200), ("01T00:40:00", 200), ("01T00:45:00", 200),
    )
    end = F.expr("TIMESTAMP_NTZ'2024-01-01 01:00:00'")
    states = op.backlog_alarm(frame, end=end).orderBy("window_start")
    assert [r.state == "ALARM" for r in states.collect()] == [bool(x) for x in (0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0)]
    moves = op.alarm_transitions(states, F.lit(False)).orderBy("window_start").collect()
    assert [(r.state, r.notify) for r in moves] == [("ALARM", True), ("OK", False), ("ALARM", True), ("OK", False)]


def test_range_follows_the_points(spark):
    """Points of any date are kept, whatever range was asked for."""
    frame = points(spark, ("01T00:00:00", 101), ("03T00:00:00", 5))
    assert op.backlog_alarm(frame).count() == 2 * 288 + 1
    early = F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")
    assert op.missing_data_alarm(frame, start=early, end=early).count() == 3
    assert op.missing_data_alarm(frame.limit(0)).count() == 0


def test_missing_day_breaches(spark):
    frame = points(spark, ("01T06:00:00", 400), ("03T06:00:00", 401))
    start, end = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'")
    states = op.missing_data_alarm(frame, start=start, end=end).orderBy("window_start").collect()
    assert [r.state for r in states] == ["OK", "ALARM", "ALARM", "ALARM"]


def test_duration_alarm_limit(spark):
    frame = points(spark, ("01T00:00:00", 21600000), ("01T00:05:00", 21600001))
    assert [r.breach for r in op.duration_alarm(frame).orderBy("window_start").collect()] == [False, True]


def test_queue_demand(spark):
    load = jobs(
        spark,
        ("r", "RUNNING", 0, 4, 100 * 1024, None),
        ("r", "RUNNABLE", 0, 4, 1, None),
        ("r", "FAILED", 0, 90, 1, None),
        ("m", "STARTING", 0, 70, 1, None),
        ("c", "RUNNING", 0, 300, 1, None),
    )
    queues = spark.createDataFrame(
        [
            ("r", ["r5.large", "r5d.large"], 2, 50),
            ("m", ["m5.large"], 10, 500),
            ("c", ["c5.large"], 40, 40),
            ("x", ["c5.large", "m5.large"], 0, 9),
        ],
        "queue STRING, instance_types ARRAY<STRING>, desired_vcpus BIGINT, max_vcpus BIGINT",
    )
    got = {r.queue: (r.demand_vcpus, r.target_vcpus, r.capped, r.action) for r in op.queue_demand(load, queues).collect()}
    assert got == {
        "r": (13, 13, False, "scale"),
        "m": (70, 70, False, "over_limit"),
        "c": (300, 40, True, "none"),
        "x": (None, None, None, "unknown_family"),
    }


def test_spot_reclaims(spark, rows):
    reasons = ["Host EC2 (instance i-0ab) terminated.", "Host EC2 (instance 0ab) terminated.", "x Host EC2 (instance i-1) terminated.", None]
    frame = jobs(spark, *[("q", "FAILED", 0, 1, 1, reason) for reason in reasons])
    assert rows(op.spot_reclaims(frame), "job_id") == [("j0",)]


def test_execution_outcome(spark):
    history = spark.createDataFrame(
        [
            ("a", 1, "TaskSubmitted", None, None, None),
            ("a", 2, "ExecutionFailed", "Err", '{"errorMessage": "bad", "x": 1}', None),
            ("b", 9, "ExecutionFailed", "Err", "plain text", None),
            ("c", 3, "ExecutionSucceeded", None, None, '{"Result": {"k": "v"}}'),
            ("d", 3, "ExecutionFailed", "Err", '{"other": 1}', None),
        ],
        "execution_arn STRING, id BIGINT, type STRING, error STRING, cause STRING, output STRING",
    )
    got = {r.execution_arn: (r.last_event_id, r.error, r.cause, r.result) for r in op.execution_outcome(history).collect()}
    assert got == {
        "a": (2, "Err", "bad", None),
        "b": (9, "Err", "plain text", None),
        "c": (3, None, None, '{"k":"v"}'),
        "d": (3, "Err", '{"other": 1}', None),
    }


def test_orphan_jobs(spark, rows):
    history = spark.createDataFrame(
        [("a", 2, "batch", '{"JobId": "j2"}'), ("a", 1, "batch", '{"JobId": "j1"}'), ("a", 3, "lambda", "{}"), ("b", 1, "batch", '{"JobId": "j3"}')],
        "execution_arn STRING, id BIGINT, resource_type STRING, output STRING",
    )
    executions = spark.createDataFrame([("a", "ABORTED"), ("b", "FAILED")], "execution_arn STRING, status STRING")
    assert rows(op.orphan_jobs(history, executions), "event_id", "job_id") == [(1, "j1"), (2, "j2")]


def test_structured_errors_need_the_last_line(spark, rows):
    error = '{"wdl_error_message": true, "error": "E", "cause": "c"}'
    lines = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, error), ("b", 1, error), ("b", 2, "x"), ("c", 1, error.replace("true", "false"))],
        "job_id STRING, line_no BIGINT, line STRING",
    )
    assert rows(op.structured_errors(lines)) == [("a", "E", "c")]


@pytest.mark.parametrize(("statistic", "expected"), [("sum", 6.0), ("max", 3.0), ("min", 1.0), ("average", 2.0), ("count", 3)])
def test_rollup_statistics(spark, statistic, expected):
    frame = points(spark, ("01T00:00:00", 1), ("01T05:59:59", 2), ("01T03:00:00", 3), ("01T06:00:00", 9))
    got = op.metric_rollup(frame, "6 hours", statistic).orderBy("window_start").first()
    assert got.value == expected
