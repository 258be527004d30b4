"""Registered queries of log alerting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import alerts as op
from taxaflow.plans import alert_inputs as src
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.sources.files import decode_log_batches
from taxaflow.sources.tables import Tables

ACCOUNT = "analytics"
NOW = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"

LOGS = f"""
logs AS (
    SELECT {src.LOG_GROUP} AS log_group, 'stream-' || (user_id % 10) AS log_stream, 'e' || event_id AS id,
        epoch_us(ts) // 1000 AS timestamp_ms, {src.message("strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS message
    FROM events
    UNION ALL
    SELECT {src.LOG_GROUP}, 'stream-' || (user_id % 10), 'f' || event_id, epoch_us(ts) // 1000,
        'Failed to upload S3 sample ' || user_id FROM events WHERE event_type = 'error'
)"""
KEPT = """
kept AS (
    SELECT * FROM logs WHERE NOT (contains(message, 'The client method is deprecated')
        OR contains(message, 'actionpack (5.1.6) lib/action_dispatch/middleware/debug_exceptions.rb:63:in')
        OR contains(message, 'ActionController::RoutingError (No route matches [GET] "/ws")')
        OR contains(message, 'binary data at marker') OR contains(message, 'Got new marker')
        OR contains(message, 'Known user error') OR contains(message, 'spades.py'))
)"""
FOUND = """
patterns(pattern, event) AS (VALUES
    ('AmrAlleleMismatchError', 'AmrAlleleMismatchError'),
    ('Background computation failed for background_id', 'BackgroundComputationFailed'),
    ('Failed to upload S3 sample', 'S3UploadFailed'),
    ('LargeBulkUploadEvent', 'LargeBulkUploadEvent'),
    ('Phylo tree creation failed for', 'PhyloTreeCreationFailed'),
    ('Phylo tree failed to kick off for', 'PhyloTreeKickoffFailed'),
    ('PhyloTreeNgFailedEvent', 'PhyloTreeNgFailedEvent'),
    ('SampleFailedEvent', 'SampleFailedEvent'),
    ('subprocess.CalledProcessError', 'CalledProcessError'),
    ('UploadFailedEvent', 'UploadFailedEvent'),
    ('WorkflowUpgradeEvent', 'WorkflowUpgradeEvent'),
    ('TaxonIndexEvictionError', 'TaxonIndexEvictionError')
),
found AS (SELECT k.*, p.event FROM kept k JOIN patterns p ON contains(k.message, p.pattern))"""
PARSED = """
typed AS (
    SELECT *, CASE WHEN json_valid(message) THEN message END AS doc FROM found
),
pathed AS (
    SELECT *, CASE WHEN doc IS NULL THEN 'plain' WHEN json_type(doc) <> 'OBJECT' THEN 'unreadable'
        WHEN json_type(doc, '$.timestamp') <> 'VARCHAR' THEN 'bad_timestamp'
        WHEN json_type(doc, '$.message') IS NULL THEN 'unreadable'
        WHEN json_type(doc, '$.timestamp') = 'VARCHAR' THEN 'stamped' ELSE 'unstamped' END AS parse_path
    FROM typed
),
parsed AS (
    SELECT log_group, log_stream, id, timestamp_ms, message, event, parse_path,
        CASE WHEN parse_path = 'stamped' THEN split_part(json_extract_string(doc, '$.timestamp'), '.', 1)
            WHEN parse_path IN ('plain', 'unstamped') THEN strftime(make_timestamp(timestamp_ms // 1000 * 1000000), '%Y-%m-%d %H:%M:%S')
            ELSE '2024-02-01T00:00:00' END AS alert_time,
        CASE WHEN parse_path = 'plain' THEN CAST(json_object('id', id, 'timestamp', timestamp_ms, 'message', message,
                'logGroup', log_group, 'logStream', log_stream) AS VARCHAR)
            WHEN parse_path = 'bad_timestamp' THEN message
            WHEN parse_path = 'unreadable' THEN 'Error occurred while processing logs'
            ELSE COALESCE(json_extract_string(doc, '$.message'), 'None') END AS alert_message
    FROM pathed
),
alerts AS (
    SELECT *, TRY_CAST(replace(alert_time, 'T', ' ') AS TIMESTAMP) AS alert_ts,
        CASE log_group WHEN 'ecs-logs-staging' THEN 'Staging' WHEN 'ecs-logs-prod' THEN 'Prod'
            WHEN '/aws/batch/job' THEN '/aws/batch/job' END AS log_source
    FROM parsed
)"""
TOPICS = """
topics AS (
    SELECT *, '[analytics] [' || log_source || '] ' || event AS topic FROM alerts WHERE log_source IS NOT NULL
)"""
ALERTS = (LOGS, KEPT, FOUND, PARSED)


def parsed(t: Tables) -> DataFrame:
    found = op.pattern_alerts(op.ignore_filter(op.flatten_logs(src.log_batches(t))))
    return op.source_dimension(op.parse_alert(found, F.expr(NOW)))


def alerts(t: Tables) -> DataFrame:
    return op.log_alerts(src.log_batches(t), ACCOUNT, F.expr(NOW))


@query(sql(LOGS, select="SELECT * FROM logs"))
def flatten_logs(t: Tables) -> DataFrame:
    return op.flatten_logs(src.log_batches(t))


@query(sql(LOGS, select="SELECT * FROM logs"))
def read_log_batches(t: Tables) -> DataFrame:
    """Every batch packed as a push payload, then decoded."""
    return op.flatten_logs(decode_log_batches(src.log_payloads(t)))


@query(sql(LOGS, KEPT, select="SELECT * FROM kept"))
def ignore_filter(t: Tables) -> DataFrame:
    return op.ignore_filter(op.flatten_logs(src.log_batches(t)))


@query(sql(LOGS, KEPT, FOUND, select="SELECT * FROM found"))
def pattern_alerts(t: Tables) -> DataFrame:
    return op.pattern_alerts(op.ignore_filter(op.flatten_logs(src.log_batches(t))))


@query(sql(*ALERTS, select="SELECT id, event, parse_path, alert_time, alert_ts, alert_message FROM alerts"))
def parse_alert(t: Tables) -> DataFrame:
    return parsed(t).select("id", "event", "parse_path", "alert_time", "alert_ts", "alert_message")


@query(sql(*ALERTS, select="SELECT id, event, log_group, log_source FROM alerts"))
def source_dimension(t: Tables) -> DataFrame:
    return parsed(t).select("id", "event", "log_group", "log_source")


COUNTS = """SELECT log_source || '-log-count' AS namespace, event AS event_name, date_trunc('minute', alert_ts) AS window_start,
    date_trunc('minute', alert_ts) + INTERVAL '1 minute' AS window_end, count(*) AS occurrences
    FROM alerts WHERE log_source IS NOT NULL AND alert_ts IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query(sql(*ALERTS, select=COUNTS))
def alert_counts(t: Tables) -> DataFrame:
    return op.alert_counts(parsed(t))


THREADS = (
    "WITH RECURSIVE "
    + ",".join((*ALERTS, TOPICS))
    + """,
starts(topic, thread_start) AS (
    SELECT topic, min(alert_ts) FROM topics GROUP BY topic
    UNION ALL
    SELECT s.topic, min(a.alert_ts) FROM starts s JOIN topics a
        ON a.topic = s.topic AND a.alert_ts >= s.thread_start + INTERVAL '2 hours' GROUP BY s.topic
)
SELECT a.id, a.event, a.topic, a.alert_ts, s.thread_start FROM topics a JOIN starts s
    ON s.topic = a.topic AND a.alert_ts >= s.thread_start AND a.alert_ts < s.thread_start + INTERVAL '2 hours'"""
)


@query(THREADS)
def alert_threads(t: Tables) -> DataFrame:
    return op.alert_threads(alerts(t)).select("id", "event", "topic", "alert_ts", "thread_start")


@query(
    sql(
        *ALERTS,
        TOPICS,
        select="""SELECT id, topic, '*' || topic || '* ' || chr(10) || ' *Log stream:* ' || log_stream || ' ' || chr(10)
            || ' *Timestamp:* ' || alert_time || ' ' || chr(10) || ' ' || alert_message AS text FROM topics""",
    )
)
def alert_text(t: Tables) -> DataFrame:
    return alerts(t).filter("log_source IS NOT NULL").select("id", "topic", "text")


@query(
    """SELECT 'run-' || event_id AS name, '*Alert from index-builder:*' || chr(10) || chr(10) || '_Result_: *'
        || CASE WHEN event_type IN ('error', 'purchase') THEN 'Failure' ELSE 'Success' END || '*' || chr(10)
        || '_Execution Name_: run-' || event_id || chr(10) || '_Start Time_: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10)
        || '_End Time_: ' || strftime(ts + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') || chr(10)
        || CASE event_type WHEN 'purchase' THEN '_Error_: States.Timeout' || chr(10)
            WHEN 'error' THEN '_Error_: States.TaskFailed' || chr(10) || '_Cause_: Essential container in task exited' || chr(10)
                || '_Exit Code_: ' || user_id || chr(10)
                || '_Container Log_: https://us-west-2.console.aws.amazon.com/cloudwatch/home?region=us-west-2#logEventViewer:group=/aws/batch/job;stream=job/default/'
                || event_id || chr(10) || '_Batch Job Id_: job-' || event_id || chr(10)
            ELSE '' END AS text
    FROM events"""
)
def execution_notice(t: Tables) -> DataFrame:
    return op.execution_notice(src.execution_events(t)).select("name", "text")


@query(
    """SELECT alarm_name, time, topic, '*' || topic || '* ' || chr(10) || ' *Timestamp:* ' || time || chr(10) || ' ```' || chr(10)
        || message || '```' AS text
    FROM (SELECT CASE WHEN event_type <> 'view' THEN 'heatmap-' || user_id END AS alarm_name,
        CASE WHEN event_type = 'view' THEN '2024-02-01T00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time,
        CASE WHEN event_type <> 'view' THEN '[analytics] [prod] heatmap-' || user_id END AS topic,
        '{"AlarmName":"heatmap-' || user_id || '","NewStateValue":"ALARM"}' AS message FROM events)"""
)
def alarm_notice(t: Tables) -> DataFrame:
    return op.alarm_notice(src.notifications(t), ACCOUNT, "prod", F.expr(NOW))


@query(
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type
        WHEN 'error' THEN 'task-' || user_id || '.stderr ERROR boom ' || user_id
        WHEN 'click' THEN 'task.stderr' || CASE WHEN user_id % 2 = 0 THEN '' ELSE 'INFO' END || ' step ' || user_id
        ELSE 'plain line ' || user_id END AS line
    FROM events WHERE event_type IN ('error', 'click') OR (event_type = 'view' AND user_id % 3 <> 0)"""
)
def stderr_view(t: Tables) -> DataFrame:
    return op.stderr_view(src.stderr_logs(t)).select("event_id", "line")
