"""Jobs, executions, metric points and logs projected from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.sources.tables import Tables

QUEUE = """CASE user_id % 5 WHEN 0 THEN 'prod-short' WHEN 1 THEN 'prod-long' WHEN 2 THEN 'prod-index'
    WHEN 3 THEN 'staging-short' ELSE 'dev-index' END"""
EXECUTION_STATUS = """CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'SUCCEEDED'
    WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'TIMED_OUT' ELSE 'ABORTED' END"""


def jobs(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        f"{QUEUE} AS queue",
        "concat('job-', event_id) AS job_id",
        """CASE event_type WHEN 'view' THEN 'RUNNABLE' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED'
            WHEN 'error' THEN 'FAILED' ELSE element_at(array('SUBMITTED', 'PENDING', 'STARTING'),
                CAST(user_id % 3 + 1 AS INT)) END AS status""",
        "unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS created_at_ms",
        "CAST(1 + user_id % 16 AS INT) AS vcpus",
        "1024 * (1 + event_id % 64) AS memory_mb",
        """CASE WHEN event_type <> 'error' THEN NULL
            WHEN user_id % 3 = 0 THEN concat('Host EC2 (instance i-0', event_id, ') terminated.')
            WHEN user_id % 3 = 1 THEN concat('Container for Host EC2 (instance i-0', event_id, ') terminated.')
            ELSE 'Essential container in task exited' END AS status_reason""",
    )


def executions(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "concat('run-', event_id) AS execution_arn",
        f"concat('arn:states:', {QUEUE}) AS state_machine",
        f"{EXECUTION_STATUS} AS status",
        "IF(event_type = 'view', NULL, ts) AS stop_date",
    )


def outcome_points(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        f"{QUEUE} AS state_machine",
        """CASE event_type WHEN 'view' THEN IF(value < 20, 'THROTTLED', 'STARTED') WHEN 'click' THEN 'SUCCEEDED'
            WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'TIMED_OUT' ELSE 'ABORTED' END AS outcome""",
        "ts",
        "CAST(1 AS BIGINT) AS value",
    )


def failure_points(t: Tables) -> DataFrame:
    """One point per finished execution: 1 for a failure, time-out or abort, else 0."""
    return t.events.selectExpr(
        f"concat('Executions', {EXECUTION_STATUS}) AS metric",
        f"{QUEUE} AS dimension",
        "ts",
        "CAST(IF(event_type IN ('error', 'purchase', 'signup'), 1, 0) AS BIGINT) AS value",
    )


def duration_points(t: Tables) -> DataFrame:
    return t.events.selectExpr("'ExecutionTime' AS metric", f"{QUEUE} AS dimension", "ts", "value * 100000 AS value")


def depth_points(t: Tables) -> DataFrame:
    return t.events.selectExpr("'QueueDepth' AS metric", f"{QUEUE} AS dimension", "ts", "value")


def age_points(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "'IndexAgeDays' AS metric", "concat('env-', user_id) AS dimension", "ts", "value * 2 AS value"
    )


def expected_alarms(t: Tables) -> DataFrame:
    """Alarms that must exist: sources that never report, due from one of the first three days on."""
    first = t.events.agg(F.min("ts")).first()[0]
    nations = t.nation.selectExpr("'IndexAgeDays' AS metric", "concat('silent-', n_nationkey) AS dimension", "n_nationkey % 3 AS days")
    since = F.lit(first).cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(days AS INT))")
    return nations.select("metric", "dimension", since.alias("since"))


def gauge_points(t: Tables) -> DataFrame:
    """Whole-numbered gauges, so averages do not depend on the order of addition."""
    return t.events.selectExpr(
        "event_type AS metric", f"{QUEUE} AS dimension", "ts", "CAST(round(value * 100) AS DOUBLE) AS value"
    )


def status_points(t: Tables) -> DataFrame:
    return t.events.selectExpr(f"{EXECUTION_STATUS} AS status", "ts", "value")


def storage_points(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        f"concat('samples-', {QUEUE}) AS bucket",
        "IF(event_type IN ('view', 'click'), 'StandardStorage', 'StandardIAStorage') AS storage_class",
        "ts",
        "CAST(round(value * 1000) AS BIGINT) AS size_bytes",
        "event_id % 1000 AS objects",
    )


def queues(t: Tables) -> DataFrame:
    return t.region.selectExpr(
        f"{QUEUE.replace('user_id', 'r_regionkey')} AS queue",
        """CASE r_regionkey WHEN 0 THEN array('r5.large', 'r5d.xlarge') WHEN 1 THEN array('m5.large')
            WHEN 2 THEN array('c5.large', 'r5.large') WHEN 3 THEN array('c5.4xlarge') ELSE array('m5.xlarge') END
            AS instance_types""",
        "CAST(10 * r_regionkey AS BIGINT) AS desired_vcpus",
        "CAST(CASE r_regionkey WHEN 0 THEN 60 WHEN 1 THEN 500 WHEN 2 THEN 64 WHEN 3 THEN 20 ELSE 4096 END AS BIGINT) AS max_vcpus",
    )


def history(t: Tables) -> DataFrame:
    """Ten events per execution; the last one decides the outcome."""
    return t.events.selectExpr(
        "concat('run-', event_id div 10) AS execution_arn",
        "event_id AS id",
        """CASE event_type WHEN 'click' THEN 'ExecutionSucceeded' WHEN 'error' THEN 'ExecutionFailed'
            WHEN 'purchase' THEN 'ExecutionFailed' ELSE 'TaskSubmitted' END AS type""",
        "CASE event_type WHEN 'error' THEN 'InvalidInputFileError' WHEN 'purchase' THEN 'States.Timeout' END AS error",
        """CASE event_type WHEN 'error' THEN concat('{"errorMessage":"bad input ', user_id, '","errorType":"RuntimeError"}')
            WHEN 'purchase' THEN concat('step ', user_id, ' took too long') END AS cause""",
        """CASE event_type WHEN 'click' THEN concat('{"Result":{"counts":"out/', event_id, '.json"}}')
            WHEN 'view' THEN concat('{"JobId":"job-', event_id, '"}') WHEN 'signup' THEN '{}' END AS output""",
        "CASE event_type WHEN 'view' THEN 'batch' WHEN 'signup' THEN 'lambda' END AS resource_type",
    )


def history_executions(outcomes: DataFrame) -> DataFrame:
    """Status of each execution by its last history event."""
    return outcomes.selectExpr(
        "execution_arn",
        """CASE WHEN type = 'ExecutionSucceeded' THEN 'SUCCEEDED' WHEN error = 'States.Timeout' THEN 'TIMED_OUT'
            WHEN type = 'ExecutionFailed' THEN 'FAILED' ELSE 'ABORTED' END AS status""",
    )


def stderr_lines(t: Tables) -> DataFrame:
    """Ten lines per job; some jobs end in a structured error message."""
    return t.events.selectExpr(
        "concat('job-', event_id div 10) AS job_id",
        "event_id % 10 AS line_no",
        """CASE event_type
            WHEN 'error' THEN concat('{"wdl_error_message": true, "error": "InsufficientReadsError", "cause": "sample ', user_id, '"}')
            WHEN 'purchase' THEN concat('{"wdl_error_message": false, "error": "Other", "cause": "sample ', user_id, '"}')
            WHEN 'view' THEN '{"level": "INFO"}'
            ELSE concat('step ', user_id, ' done') END AS line""",
    )
