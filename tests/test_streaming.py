from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import alerts as alert_ops
from taxaflow.operators import metrics as metric_ops
from taxaflow.session import new_shared_path
from taxaflow.sources.keyed_tables import read_table
from taxaflow.streaming import alarms, logs, run

BASE = 1704067200
FAR = BASE + 400_000


def write_batch(spark, path, events):
    data = [("ecs-logs-prod", "s", [(f"e{s}-{i}", s * 1000, m)]) for i, (s, m) in enumerate(events)]
    spark.createDataFrame(data, schemas.LOG_BATCH).coalesce(1).write.mode("append").option("compression", "gzip").json(path)


EVENTS = [
    [(BASE + s, "SampleFailedEvent") for s in (0, 5, 59, 60, 7199)],
    [(BASE + s, "SampleFailedEvent and UploadFailedEvent") for s in (7201, 7200, 9000, 6900)],
    [(BASE + s, "SampleFailedEvent") for s in (15000, 14399, 14400)],
]


def all_batches(spark, path):
    return spark.read.schema(schemas.LOG_BATCH).json(path)


def test_counts_and_threads_resume_from_their_checkpoint(spark, rows):
    """Three runs over arriving files, each resuming the last, equal one batch over all files."""
    path, counts, threads = (new_shared_path(spark, n) for n in ("logs", "counts", "threads"))
    marks = [new_shared_path(spark, n) for n in ("c1", "c2")]
    for step in (*EVENTS, [(FAR, "SampleFailedEvent")]):
        write_batch(spark, path, step)
        alerts = logs.alert_stream(logs.log_stream(spark, path), "acct")
        run.upsert_to_table(
            logs.alert_counts_stream(alerts), counts, ["namespace", "event_name", "window_start"], marks[0], bucket_rows=2
        ).awaitTermination()
        run.append_to_table(logs.thread_starts_stream(alerts), threads, marks[1]).awaitTermination()
    event_time = F.timestamp_seconds(F.expr("timestamp_ms div 1000")).cast("timestamp_ntz")
    batch = alert_ops.log_alerts(all_batches(spark, path), "acct", event_time)
    want = alert_ops.alert_counts(batch)
    got = read_table(spark, counts)
    columns = ["event_name", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("w"), "occurrences"]
    assert rows(got, *columns) == rows(want, *columns)
    starts = rows(spark.read.parquet(threads), "topic", "thread_second")
    assert starts == [r for r in rows(alert_ops.thread_starts(batch), "topic", "thread_second") if r[1] < FAR]
    assert len(starts) > 3


def test_far_future_stamp_is_quarantined(spark, rows):
    path = new_shared_path(spark, "logs")
    stamped = '{"timestamp": "2999-01-01T00:00:00", "message": "SampleFailedEvent"}'
    write_batch(spark, path, [(BASE, stamped), (BASE + 1, "SampleFailedEvent")])
    batches = all_batches(spark, path)
    assert logs.quarantined(batches, "acct").count() == 1
    assert rows(logs.alert_stream(batches, "acct").select("id")) == [(f"e{BASE + 1}-1",)]
    assert logs.quarantined(batches, "acct", max_ahead="9999 days").count() == 1
    assert logs.quarantined(batches, "acct", max_ahead="400000 days").count() == 0


def test_count_job_writes_its_quarantine(spark, rows):
    """Every alert is counted or set apart, by the same job and the same limit."""
    path, counts, apart = (new_shared_path(spark, n) for n in ("logs", "counts", "apart"))
    stamped = '{"timestamp": "2024-01-01T03:00:00", "message": "SampleFailedEvent"}'
    write_batch(spark, path, [(BASE, stamped), (BASE + 1, "SampleFailedEvent")])
    for limit, usable in (("2 hours", 1), ("4 hours", 2)):
        target, rest = f"{counts}-{usable}", f"{apart}-{usable}"
        logs.count_job(logs.log_stream(spark, path), "acct", target, rest, max_ahead=limit).awaitTermination()
        assert rows(read_table(spark, target).agg(F.sum("occurrences"))) == [(usable,)]
        assert read_table(spark, rest).count() == 2 - usable


LATE = [
    [(BASE + s, "SampleFailedEvent") for s in (0, 30, 9000, 9060, 20000)],
    [(BASE + s, "SampleFailedEvent") for s in (31, 5000, 9030, 17000, 20001, 40000)],  # most are past the watermark by now
    [(BASE + s, "UploadFailedEvent") for s in (1, 39000)] + [(FAR, "SampleFailedEvent")],
]


def test_count_job_loses_no_late_alert(spark, rows):
    """Counts of deliveries far out of order are those of one batch, and a replayed batch adds nothing."""
    path, counts, apart, mark = (new_shared_path(spark, n) for n in ("logs", "counts", "apart", "c"))
    for step in LATE:
        write_batch(spark, path, step)
        logs.count_job(logs.log_stream(spark, path), "acct", counts, apart, mark).awaitTermination()
    event_time = F.timestamp_seconds(F.expr("timestamp_ms div 1000")).cast("timestamp_ntz")
    want = alert_ops.alert_counts(alert_ops.log_alerts(all_batches(spark, path), "acct", event_time))
    columns = ["namespace", "event_name", "window_start", "window_end", "occurrences"]
    assert rows(read_table(spark, counts), *columns) == rows(want, *columns)
    version = read_table(spark, counts)
    run.add_to_table(version.limit(3), counts, columns[:3], "occurrences", ["hour"], "counts", 0)
    assert rows(read_table(spark, counts), *columns) == rows(want, *columns)


def test_threads_attach_and_mark_what_is_late(spark, rows):
    """Attached and late alerts together are all alerts; those that came in time have the threads of a batch."""
    path, table, mark = (new_shared_path(spark, n) for n in ("logs", "threads", "c"))
    for step in LATE:
        write_batch(spark, path, step)
        attached = logs.alert_threads_stream(logs.alert_stream(logs.log_stream(spark, path), "acct"))
        run.append_to_table(attached, table, mark).awaitTermination()
    got = spark.read.schema(attached.schema).parquet(table)
    everything = sorted(f"e{s}-{i}" for step in LATE for i, (s, _) in enumerate(step) if s < FAR)
    assert [r[0] for r in rows(got, "id")] == everything
    place = F.unix_seconds(F.col("alert_ts").cast("timestamp")) - BASE
    start = F.unix_seconds(F.col("thread_start").cast("timestamp")) - BASE
    found = {(r[0], r[1]): (r[2], r[3]) for r in got.select("event", place, start, "late").collect()}
    sample = {second: v for (event, second), v in found.items() if event == "SampleFailedEvent"}
    assert sample[0] == (0, False) and sample[30] == (0, False) and sample[9000] == (9000, False) and sample[9060] == (9000, False)
    assert sample[20000] == (20000, False) and sample[20001] == (20000, False) and sample[40000] == (40000, False)
    assert sample[9030] == (9000, False)  # late, but the thread that covers it is still known
    assert sample[5000] == (None, True) or sample[5000] == (0, False)  # as the slot of its thread was still kept or not
    assert sample[17000] == (None, True)
    assert found["UploadFailedEvent", 39000] == (39000, False)


def test_threads_of_alerts_in_time_are_those_of_a_batch(spark, rows):
    path, table, mark = (new_shared_path(spark, n) for n in ("logs", "threads", "c"))
    for step in (*EVENTS, [(FAR, "SampleFailedEvent")]):
        write_batch(spark, path, step)
        attached = logs.alert_threads_stream(logs.alert_stream(logs.log_stream(spark, path), "acct", lateness="3 hours"))
        run.append_to_table(attached, table, mark).awaitTermination()
    event_time = F.timestamp_seconds(F.expr("timestamp_ms div 1000")).cast("timestamp_ntz")
    want = alert_ops.alert_threads(alert_ops.log_alerts(all_batches(spark, path), "acct", event_time))
    got = spark.read.schema(attached.schema).parquet(table)
    columns = ["id", "event", "topic", F.col("alert_ts").cast("string"), F.col("thread_start").cast("string")]
    assert rows(got, *columns) == [r for r in rows(want, *columns) if not r[0].startswith(f"e{FAR}")]
    assert got.where("late").count() == 0


def test_alarm_stream_fills_missing_periods(spark):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    steps = [
        [("a", 0, 200), ("a", 6, 200), ("b", 1, 5)],
        [("a", 11, 300), ("b", 13, 500)],
        [("b", 31, 500)],
        [("a", 90, 1)],
        [("a", 300, 1)],
    ]
    path, table, mark = (new_shared_path(spark, n) for n in ("points", "alarms", "c"))
    for step in steps:
        data = [("depth", d, at(m), float(v)) for d, m, v in step]
        spark.createDataFrame(data, schemas.METRIC_POINTS).coalesce(1).write.mode("append").parquet(path)
        points = spark.readStream.schema(schemas.METRIC_POINTS).parquet(path)
        states = alarms.alarm_state_stream(points, 100, "max", 300, evaluation_periods=3)
        run.append_to_table(states, table, mark).awaitTermination()
    got = spark.read.parquet(table)
    start, end = (F.lit(at(m)).cast("timestamp_ntz") for m in (0, 285))
    want = metric_ops.backlog_alarm(spark.read.schema(schemas.METRIC_POINTS).parquet(path), start=start).filter(F.col("window_start") < end)
    key = lambda r: (r.dimension, r.window_start)
    states = {key(r): (r.breach, r.state) for r in got.collect()}
    expected = {key(r): (r.breach, r.state) for r in want.collect()}
    assert got.count() == len(states)
    assert states.items() >= expected.items()
    assert [s for (d, w), (_, s) in sorted(states.items()) if d == "a"][:4] == ["OK", "OK", "ALARM", "OK"]


def test_missing_periods_breach_on_a_timer(spark):
    """A dimension that falls silent raises its alarm while others move time forward."""
    path, table = new_shared_path(spark, "points"), new_shared_path(spark, "alarms")
    mark = new_shared_path(spark, "c")
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    for minute, dimension in ((0, "silent"), (0, "alive"), (60, "alive"), (120, "alive"), (180, "alive")):
        spark.createDataFrame([("age", dimension, at(minute), 1.0)], schemas.METRIC_POINTS).coalesce(1).write.mode("append").parquet(path)
        points = spark.readStream.schema(schemas.METRIC_POINTS).parquet(path)
        states = alarms.alarm_state_stream(points, 10, "max", 3600, missing_breaches=True)
        run.append_to_table(states, table, mark).awaitTermination()
    silent = spark.read.parquet(table).filter("dimension = 'silent'").orderBy("window_start").collect()
    assert [r.state for r in silent] == ["OK", "ALARM"] and silent[1].value is None


def test_an_expected_alarm_that_never_reports(spark, rows):
    """It alarms from its first period on, on the stream and in the batch alike."""
    path, table, mark = (new_shared_path(spark, n) for n in ("points", "alarms", "c"))
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    expected = spark.createDataFrame([("age", "dead", at(61)), ("age", "alive", at(0))], "metric STRING, dimension STRING, since TIMESTAMP_NTZ")
    for minute in (0, 60, 120, 180, 400):
        spark.createDataFrame([("age", "alive", at(minute), 1.0)], schemas.METRIC_POINTS).coalesce(1).write.mode("append").parquet(path)
        points = spark.readStream.schema(schemas.METRIC_POINTS).parquet(path)
        states = alarms.alarm_state_stream(points, 10, "max", 3600, missing_breaches=True, expected=expected)
        run.append_to_table(states, table, mark).awaitTermination()
    got = spark.read.parquet(table)
    batch = metric_ops.missing_data_alarm(spark.read.schema(schemas.METRIC_POINTS).parquet(path), 10, "1 hour", expected=expected)
    closed = F.col("window_start") < F.lit(at(360))
    columns = ["dimension", F.col("window_start").cast("string"), "value", "breach", "state"]
    assert rows(got.where(closed), *columns) == rows(batch.where(closed), *columns)
    assert [r.state for r in got.where("dimension = 'dead'").collect()] == ["ALARM"] * 5
    silent = metric_ops.missing_data_alarm(
        spark.createDataFrame([], schemas.METRIC_POINTS), 10, "1 hour", *(F.lit(at(m)).cast("timestamp_ntz") for m in (0, 180)), expected
    )
    assert rows(silent, "dimension", "state") == [("alive", "ALARM")] * 3 + [("dead", "ALARM")] * 2


def test_alarm_transitions_on_a_stream(spark, rows):
    """Each entry into ALARM and return to OK once, over restarts, as in the batch."""
    path, table, mark = (new_shared_path(spark, n) for n in ("points", "transitions", "c"))
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    for step in ([(0, 200), (6, 200)], [(11, 300), (16, 1)], [(21, 500), (26, 500), (31, 500)], [(36, 2)], [(300, 1)]):
        data = [("depth", "a", at(m), float(v)) for m, v in step]
        spark.createDataFrame(data, schemas.METRIC_POINTS).coalesce(1).write.mode("append").parquet(path)
        points = spark.readStream.schema(schemas.METRIC_POINTS).parquet(path)
        states = alarms.alarm_state_stream(points, 100, "max", 300, evaluation_periods=3)
        run.append_to_table(alarms.alarm_transitions_stream(states, F.lit(False)), table, mark).awaitTermination()
    batch = metric_ops.alarm_transitions(metric_ops.backlog_alarm(spark.read.schema(schemas.METRIC_POINTS).parquet(path)), F.lit(False))
    columns = ["dimension", F.col("window_start").cast("string"), "previous_state", "state", "notify"]
    got = rows(spark.read.parquet(table), *columns)
    assert got == rows(batch, *columns) and [r[3] for r in got] == ["ALARM", "OK", "ALARM", "OK"]


def test_an_alarm_takes_rows_and_the_earliest_of_its_starts():
    """The state step works on rows as they come, without a frame per alarm."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    held, timers = [], set()
    state = SimpleNamespace(get=lambda: held[-1] if held else None, update=held.append)
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove)
    chain, now = alarms.PeriodChain(60, 1, True), SimpleNamespace(getCurrentWatermarkInMs=lambda: 250_000)
    chain.init(handle)
    for due in (120, 60, 180):
        chain.handleInitialState(("age", "a"), Row(due=due), now)
    assert held[-1] == (60, 0) and timers == {120_000}
    got = chain.handleInputRows(("age", "a"), iter([Row(period_second=120, value=1.0, breach=False)]), now)
    assert [(r.period_second, r.value, r.state) for r in got] == [(60, None, "ALARM"), (120, 1.0, "OK"), (180, None, "ALARM")]
    assert held[-1] == (240, 1) and timers == {300_000}
