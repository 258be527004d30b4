"""Log batches, notices and notifications projected from the event table."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taxaflow.sources.tables import Tables

# Shared by both engines: string concatenation with || and integer arithmetic only.
LOG_GROUP = """CASE user_id % 4 WHEN 0 THEN 'ecs-logs-staging' WHEN 1 THEN 'ecs-logs-prod'
    WHEN 2 THEN '/aws/batch/job' ELSE '/aws/lambda/eviction' END"""
CLICK_MESSAGE = """CASE user_id % 6 WHEN 0 THEN '{"text":"WorkflowUpgradeEvent"}' WHEN 1 THEN '["TaxonIndexEvictionError"]'
    WHEN 2 THEN '{"timestamp":17,"message":"PhyloTreeNgFailedEvent"}'
    WHEN 3 THEN '{"message":"AmrAlleleMismatchError"} trailing'
    WHEN 4 THEN '{"message":null,"note":"AmrAlleleMismatchError"}' ELSE 'nothing to see' END"""


def message(iso_seconds: str) -> str:
    """Message expression; ``iso_seconds`` formats the event time."""
    return f"""CASE event_type
        WHEN 'error' THEN 'Traceback: subprocess.CalledProcessError: step ' || user_id || ' returned 1'
        WHEN 'purchase' THEN '{{"timestamp":"' || {iso_seconds} || '.500","message":"SampleFailedEvent for sample ' || user_id || '"}}'
        WHEN 'signup' THEN '{{"message":"UploadFailedEvent then LargeBulkUploadEvent by user ' || user_id || '"}}'
        WHEN 'view' THEN 'Known user error: SampleFailedEvent seen by ' || user_id
        ELSE {CLICK_MESSAGE} END"""


MESSAGE = message("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")


def log_batches(t: Tables) -> DataFrame:
    """One batch per event; failed steps log a second line."""
    return t.events.selectExpr(
        f"{LOG_GROUP} AS logGroup",
        "concat('stream-', user_id % 10) AS logStream",
        f"""filter(array(
            named_struct('id', concat('e', event_id), 'timestamp', unix_micros(CAST(ts AS TIMESTAMP)) div 1000, 'message', {MESSAGE}),
            IF(event_type = 'error', named_struct('id', concat('f', event_id),
                'timestamp', unix_micros(CAST(ts AS TIMESTAMP)) div 1000,
                'message', 'Failed to upload S3 sample ' || user_id), NULL)
        ), x -> x IS NOT NULL) AS logEvents""",
    )


@F.pandas_udf(StringType())
def gzip_base64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda s: base64.b64encode(gzip.compress(s.encode("utf-8"), mtime=0)).decode("ascii"))


def log_payloads(t: Tables) -> DataFrame:
    return log_batches(t).select(gzip_base64(F.to_json(F.struct("*"))).alias("data"))


def execution_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "IF(event_type IN ('error', 'purchase'), 'Failure', 'Success') AS result",
        "'index-builder' AS service",
        "concat('run-', event_id) AS name",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS start_time",
        "date_format(ts + INTERVAL '1 hour', 'yyyy-MM-dd HH:mm:ss') AS end_time",
        "CASE event_type WHEN 'error' THEN 'States.TaskFailed' WHEN 'purchase' THEN 'States.Timeout' END AS error",
        """CASE event_type WHEN 'error' THEN concat('{"StatusReason":"Essential container in task exited","Container":{"ExitCode":',
                user_id, ',"LogStreamName":"job/default/', event_id, '"},"JobId":"job-', event_id, '"}')
            WHEN 'purchase' THEN '{"StatusReason":"some non-batch failure"}' END AS cause""",
    )


def notifications(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        """array(named_struct('Sns', named_struct(
            'Message', IF(event_type = 'view', 'not json', concat('{"AlarmName":"heatmap-', user_id, '","NewStateValue":"ALARM"}')),
            'Timestamp', date_format(ts, 'yyyy-MM-dd HH:mm:ss')))) AS Records"""
    )


def stderr_logs(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id",
        "unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS timestamp_ms",
        """CASE event_type
            WHEN 'error' THEN concat('{"source":"task-', user_id, '.stderr","level":"ERROR","message":"boom ', user_id, '"}')
            WHEN 'click' THEN concat('{"source":"task.stderr","level":"', IF(user_id % 2 = 0, 'VERBOSE', 'INFO'), '","message":"step ', user_id, '"}')
            WHEN 'purchase' THEN '{"source":"task.stderr","level":"INFO","message":"x","data":{"k":1}}'
            WHEN 'signup' THEN '{"source":"task.stdout","level":"INFO","message":"x"}'
            ELSE IF(user_id % 3 = 0, '+ aws sts get-caller-identity', concat('plain line ', user_id)) END AS message""",
    )
