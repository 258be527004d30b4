from __future__ import annotations

import base64
import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import alerts as op
from taxaflow.sources import files

MS = 1704067207999
EVENT_TIME = "2024-01-01 00:00:07"


def now():
    return F.expr("TIMESTAMP_NTZ'2024-02-01 10:20:30.5'")


def logs(spark, *messages):
    data = [("ecs-logs-prod", "s", f"e{i}", MS, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(data, "log_group STRING, log_stream STRING, id STRING, timestamp_ms BIGINT, message STRING")


def parse(spark, message):
    alert = logs(spark, message).withColumn("event", F.lit("E"))
    row = op.parse_alert(alert, now()).first()
    return row.parse_path, row.alert_time, row.alert_message


@pytest.mark.parametrize(
    ("message", "path", "time", "text"),
    [
        ('{"timestamp": "2024-05-06T07:08:09.123Z", "message": "m"}', "stamped", "2024-05-06T07:08:09", "m"),
        ('{"timestamp": "2024-05-06T07:08:09", "message": "m"}', "stamped", "2024-05-06T07:08:09", "m"),
        ('{"message": "m"}', "unstamped", EVENT_TIME, "m"),
        ('{"message": {"a": 1}}', "unstamped", EVENT_TIME, '{"a":1}'),
        ('{"message": null}', "unstamped", EVENT_TIME, "None"),
        ('{"timestamp": 5, "message": "m"}', "bad_timestamp", "2024-02-01T10:20:30", '{"timestamp": 5, "message": "m"}'),
        ('{"timestamp": null}', "bad_timestamp", "2024-02-01T10:20:30", '{"timestamp": null}'),
        ('{"timestamp": "2024-05-06T07:08:09"}', "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
        ('{"other": 1}', "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
        ('["timestamp"]', "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
        ('"text"', "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
        ("17", "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
        ("null", "unreadable", "2024-02-01T10:20:30", op.UNREADABLE),
    ],
)
def test_parse_ladder(spark, message, path, time, text):
    assert parse(spark, message) == (path, time, text)


@pytest.mark.parametrize("message", ["plain words", '{"message": "m"} tail', '{"a": 1} {"b": 2}', "17 errors", "1, 2", '{"a"', "", "true story"])
def test_text_that_is_not_only_json_is_plain(spark, message):
    path, time, text = parse(spark, message)
    assert (path, time) == ("plain", EVENT_TIME)
    assert json.loads(text) == {"id": "e0", "timestamp": MS, "message": message, "logGroup": "ecs-logs-prod", "logStream": "s"}


def test_patterns_raise_one_alert_each(spark, rows):
    frame = logs(
        spark,
        "subprocess.CalledProcessError: This is a test",
        "UploadFailedEvent after LargeBulkUploadEvent",
        "uploadfailedevent",
        "nothing",
    )
    assert rows(op.pattern_alerts(frame), "id", "event") == [
        ("e0", "CalledProcessError"),
        ("e1", "LargeBulkUploadEvent"),
        ("e1", "UploadFailedEvent"),
    ]


def test_every_pattern_is_found(spark):
    frame = logs(spark, *op.ALERT_PATTERNS)
    found = {r.event for r in op.pattern_alerts(frame).collect()}
    assert found == set(op.ALERT_PATTERNS.values())


def test_ignored_text(spark, rows):
    frame = logs(spark, *[f"SampleFailedEvent {t} x" for t in op.IGNORED_TEXT], "SampleFailedEvent", "known user error")
    assert rows(op.ignore_filter(frame), "message") == [("SampleFailedEvent",), ("known user error",)]


def batch_frame(spark):
    return spark.createDataFrame(
        [
            ("ecs-logs-prod", "s1", [("a", MS, "SampleFailedEvent"), ("b", MS, "spades.py SampleFailedEvent")]),
            ("/aws/lambda/other", "s2", [("c", MS, "SampleFailedEvent")]),
        ],
        schemas.LOG_BATCH,
    )


def test_unknown_group_is_quarantined(spark, rows):
    alerts = op.log_alerts(batch_frame(spark), "acct", now())
    assert rows(alerts, "id", "log_source", "topic") == [
        ("a", "Prod", "[acct] [Prod] SampleFailedEvent"),
        ("c", None, None),
    ]
    text = alerts.filter("id = 'a'").first().text
    assert text.startswith(f"*[acct] [Prod] SampleFailedEvent* \n *Log stream:* s1 \n *Timestamp:* {EVENT_TIME} \n ")
    [count] = op.alert_counts(alerts).collect()
    assert (count.namespace, count.event_name, count.occurrences) == ("Prod-log-count", "SampleFailedEvent", 1)


def test_decode_inline_payloads(spark, rows):
    payloads = [
        (base64.b64encode(gzip.compress(json.dumps(
            {"logGroup": "g", "logStream": f"s{i}", "logEvents": [{"id": str(i), "timestamp": MS, "message": "é"}], "owner": "x"}
        ).encode())).decode(),)
        for i in range(3)
    ]
    decoded = op.flatten_logs(files.decode_log_batches(spark.createDataFrame(payloads, "data STRING")))
    assert rows(decoded, "id", "log_stream", "message") == [(str(i), f"s{i}", "é") for i in range(3)]


def test_read_gzipped_batch_files(spark, tmp_path, rows):
    batch_frame(spark).write.option("compression", "gzip").json(str(tmp_path / "logs"))
    assert rows(op.flatten_logs(files.read_log_batches(spark, str(tmp_path / "logs"))), "id") == [("a",), ("b",), ("c",)]


def brute_starts(seconds, span):
    starts = []
    for s in sorted(seconds):
        if not starts or s >= starts[-1] + span:
            starts.append(s)
    return starts


def test_thread_chain_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        seconds = sorted(rng.sample(range(5000), rng.randint(1, 300)))
        span = rng.randint(1, 900)
        cut = rng.randint(0, len(seconds))
        first, last = op.next_starts(np.array(seconds[:cut]), None, span)
        second, _ = op.next_starts(np.array(seconds[cut:]), last, span)
        assert first + second == brute_starts(seconds, span)


def test_block_outcomes_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        span = rng.randint(1, 60)
        begin = 7 * span
        seconds = sorted(rng.sample(range(begin, begin + 5 * span), rng.randint(1, min(5 * span, 40))))
        got = op.block_outcomes(np.array(seconds), begin, span)
        for wait in range(span):
            starts = brute_starts([s for s in seconds if s >= begin + wait], span)
            assert got[wait] == (starts[-1] if starts else -1)


def test_one_topic_over_many_blocks(spark, monkeypatch):
    """One topic whose chain runs over many blocks, some of them empty, and many partitions."""
    monkeypatch.setattr(op, "BLOCK_SPANS", 2)
    rng = random.Random(6)
    seconds = sorted(rng.sample(range(1704067200, 1704067200 + 40 * 86400), 900))
    alerts = spark.createDataFrame([("hot", s) for s in seconds], "topic STRING, s BIGINT").repartition(7)
    alerts = alerts.withColumn("alert_ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = [r.thread_second for r in op.thread_starts(alerts, 3).orderBy("thread_second").collect()]
    assert got == brute_starts(seconds, 3 * 3600)


def test_threads_are_anchored_at_their_first_alert(spark):
    """A hot topic with many alerts per second next to a quiet one."""
    rng = random.Random(5)
    base = 1704067200
    data = [("hot", base + rng.randint(0, 6 * 3600), i) for i in range(3000)]
    data += [("cold", base, 5000), ("cold", base + 7199, 5001), ("cold", base + 7200, 5002), ("cold", base + 14399, 5003)]
    alerts = spark.createDataFrame(data, "topic STRING, s BIGINT, id BIGINT").select(
        "topic", "id", "s", F.timestamp_seconds("s").cast("timestamp_ntz").alias("alert_ts"), F.lit("Prod").alias("log_source")
    )
    got = {r.id: r.start for r in op.alert_threads(alerts).select("id", F.unix_seconds(F.col("thread_start").cast("timestamp")).alias("start")).collect()}
    assert len(got) == len(data)
    for topic in ("hot", "cold"):
        starts = brute_starts({s for t, s, _ in data if t == topic}, 7200)
        for t, s, i in data:
            if t == topic:
                assert got[i] == max(x for x in starts if x <= s)


def notice(spark, result, error=None, cause=None):
    row = (result, "builder", "run", "t0", "t1", error, cause)
    frame = spark.createDataFrame([row], "result STRING, service STRING, name STRING, start_time STRING, end_time STRING, error STRING, cause STRING")
    return op.execution_notice(frame).first().text


def test_notices(spark):
    base = "*Alert from builder:*\n\n_Result_: *{}*\n_Execution Name_: run\n_Start Time_: t0\n_End Time_: t1\n"
    assert notice(spark, "Success") == base.format("Success")
    timeout = notice(spark, "Failure", "States.Timeout", '{"StatusReason": "some non-batch failure"}')
    assert timeout == base.format("Failure") + "_Error_: States.Timeout\n"
    cause = {"StatusReason": "Essential container in task exited", "Container": {"ExitCode": 137, "LogStreamName": "job/default/abc123"}, "JobId": "job-abc-123"}
    text = notice(spark, "Failure", "Error", json.dumps(cause))
    assert text == base.format("Failure") + (
        "_Error_: Error\n_Cause_: Essential container in task exited\n_Exit Code_: 137\n"
        f"_Container Log_: {op.LOG_VIEWER}job/default/abc123\n_Batch Job Id_: job-abc-123\n"
    )


def test_alarm_notice(spark):
    data = [([(('{"AlarmName": "disk", "x": 1}', "t1"),), (("broken", "t2"),)],)]
    frame = spark.createDataFrame(data, "Records ARRAY<STRUCT<Sns: STRUCT<Message: STRING, Timestamp: STRING>>>")
    got = op.alarm_notice(frame, "acct", "dev", now()).collect()
    assert [(r.alarm_name, r.time, r.topic) for r in got] == [
        ("disk", "t1", "[acct] [dev] disk"),
        (None, "2024-02-01T10:20:30", None),
    ]
    assert got[0].text == '*[acct] [dev] disk* \n *Timestamp:* t1\n ```\n{"AlarmName": "disk", "x": 1}```'


def test_stderr_view(spark):
    lines = [
        '{"source": "a.stderr", "level": "ERROR", "message": "m"}',
        '{"source": "a.stderr", "level": "VERBOSE", "message": "m"}',
        '{"source": "a.stderr", "level": "INFO", "message": "m", "data": null}',
        '{"source": "a.stdout", "level": "INFO", "message": "m"}',
        '{"level": "INFO", "message": "m"}',
        "plain",
        "+ aws sts get-caller-identity",
        '{"source": "a.stderr", "message": "m"}',
    ]
    got = [r.line.split(" ", 2)[2] for r in op.stderr_view(logs(spark, *lines)).orderBy("id").collect()]
    assert got == ["a.stderr ERROR m", "a.stderr m", "plain", "a.stderr m"]


def test_payloads_are_unpacked_once(spark, tmp_path):
    """Filters that follow from the list of events do not bring a second copy of the decoder."""
    path = str(tmp_path / "payloads")
    spark.createDataFrame([("x",)], "data STRING").write.parquet(path)
    plan = op.flatten_logs(files.decode_log_batches(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
