"""Registered queries of operational metrics and alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import metrics as op
from taxaflow.plans import metrics_inputs as src
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.sources.tables import Tables

NAMESPACE = "prod"
END = "TIMESTAMP_NTZ'2024-01-31 00:00:00'"
QUEUE = src.QUEUE
STATUS = src.EXECUTION_STATUS

JOBS = f"""
jobs AS (
    SELECT {QUEUE} AS queue, 'job-' || event_id AS job_id,
        CASE event_type WHEN 'view' THEN 'RUNNABLE' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED'
            WHEN 'error' THEN 'FAILED' ELSE ['SUBMITTED', 'PENDING', 'STARTING'][user_id % 3 + 1] END AS status,
        epoch_us(ts) // 1000 AS created_at_ms, CAST(1 + user_id % 16 AS INTEGER) AS vcpus,
        1024 * (1 + event_id % 64) AS memory_mb,
        CASE WHEN event_type <> 'error' THEN NULL
            WHEN user_id % 3 = 0 THEN 'Host EC2 (instance i-0' || event_id || ') terminated.'
            WHEN user_id % 3 = 1 THEN 'Container for Host EC2 (instance i-0' || event_id || ') terminated.'
            ELSE 'Essential container in task exited' END AS status_reason
    FROM events
),
job_counts AS (
    SELECT status, count(*) AS n FROM jobs
    WHERE queue LIKE 'prod%' AND (to_timestamp(created_at_ms // 1000)::TIMESTAMP > TIMESTAMP '2024-01-30'
        OR status NOT IN ('SUCCEEDED', 'ABORTED', 'FAILED'))
    GROUP BY status
)"""
EXECUTIONS = f"""
executions AS (
    SELECT 'run-' || event_id AS execution_arn, 'arn:states:' || {QUEUE} AS state_machine, {STATUS} AS status,
        CASE WHEN event_type <> 'view' THEN ts END AS stop_date
    FROM events
),
execution_counts AS (
    SELECT status, count(*) AS n FROM executions
    WHERE split_part(state_machine, ':', 3) LIKE 'prod%'
        AND (status NOT IN ('SUCCEEDED', 'ABORTED', 'FAILED') OR stop_date > TIMESTAMP '2024-01-30')
    GROUP BY status
)"""


def percent(counts: str) -> str:
    return f"""SELECT failed, total, 100 * failed / total AS failed_percent FROM (
        SELECT CAST(COALESCE(sum(n) FILTER (status = 'FAILED'), 0) AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS total
        FROM {counts}) WHERE total > 0"""


def status_args() -> tuple:
    return NAMESPACE, F.expr(END), F.expr("INTERVAL '1 day'")


@query(sql(JOBS, select="SELECT * FROM job_counts"))
def job_status_counts(t: Tables) -> DataFrame:
    return op.job_status_counts(src.jobs(t), *status_args())


@query(sql(JOBS, select=percent("job_counts")))
def job_failure_percent(t: Tables) -> DataFrame:
    return op.job_failure_percent(src.jobs(t), *status_args())


@query(sql(EXECUTIONS, select="SELECT * FROM execution_counts"))
def execution_status_counts(t: Tables) -> DataFrame:
    return op.execution_status_counts(src.executions(t), *status_args())


@query(sql(EXECUTIONS, select=percent("execution_counts")))
def execution_failure_percent(t: Tables) -> DataFrame:
    return op.execution_failure_percent(src.executions(t), *status_args())


@query(
    sql(
        JOBS,
        EXECUTIONS,
        select=f"""SELECT 'prod' AS namespace, * FROM (
        SELECT 'BatchJobStatus' AS metric, 'BatchJobStatus' AS dimension, status AS dimension_value,
            NULL::VARCHAR AS unit, CAST(n AS DOUBLE) AS value FROM job_counts
        UNION ALL SELECT 'BatchPercentFailedJobs', NULL, NULL, 'Percent', failed_percent FROM ({percent("job_counts")})
        UNION ALL SELECT 'SFNExecutionStatus', 'SFNExecutionStatus', status, NULL, CAST(n AS DOUBLE) FROM execution_counts
        UNION ALL SELECT 'SFNPercentFailedExecutions', NULL, NULL, 'Percent', failed_percent FROM ({percent("execution_counts")}))""",
    )
)
def status_metrics(t: Tables) -> DataFrame:
    return op.status_metrics(src.jobs(t), src.executions(t), *status_args())


@query(
    sql(
        JOBS,
        select="""SELECT * FROM jobs WHERE queue IN ('prod-short', 'dev-index')
            AND status IN ('RUNNABLE', 'STARTING', 'RUNNING')""",
    )
)
def list_jobs(t: Tables) -> DataFrame:
    return op.list_jobs(src.jobs(t), ["prod-short", "dev-index"], ["RUNNABLE", "STARTING", "RUNNING"])


@query(
    f"""SELECT {QUEUE} AS state_machine, time_bucket(INTERVAL '1 hour', ts) AS window_start,
        time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
        count(*) FILTER (event_type = 'signup') AS aborted, count(*) FILTER (event_type = 'click') AS succeeded,
        count(*) FILTER (event_type = 'purchase') AS timed_out,
        count(*) FILTER (event_type = 'view' AND value < 20) AS throttled,
        count(*) FILTER (event_type = 'error') AS failed,
        count(*) FILTER (event_type = 'view' AND value >= 20) AS started
    FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3"""
)
def hourly_outcomes(t: Tables) -> DataFrame:
    return op.hourly_outcomes(src.outcome_points(t), F.expr(END))


@query(
    f"""SELECT 'Executions' || {STATUS} AS metric, {QUEUE} AS dimension, time_bucket(INTERVAL '5 minutes', ts) AS window_start,
        time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
        count(*) FILTER (event_type IN ('error', 'purchase', 'signup')) AS value,
        count(*) FILTER (event_type IN ('error', 'purchase', 'signup')) > 0 AS breach
    FROM events GROUP BY 1, 2, 3, 4"""
)
def sum_alarm(t: Tables) -> DataFrame:
    return op.sum_alarm(src.failure_points(t))


@query(
    f"""SELECT 'ExecutionTime' AS metric, {QUEUE} AS dimension, time_bucket(INTERVAL '5 minutes', ts) AS window_start,
        time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
        max(value * 100000) AS value, max(value * 100000) > 21600000 AS breach
    FROM events GROUP BY 1, 2, 3, 4"""
)
def duration_alarm(t: Tables) -> DataFrame:
    return op.duration_alarm(src.duration_points(t))


def filled(metric: str, dimension: str, value: str, threshold: str, period: str, missing: str, periods: int) -> str:
    """SQL twin of a gap-filled alarm."""
    return f"""
periods AS (
    SELECT {dimension} AS dimension, time_bucket(INTERVAL '{period}', ts) AS window_start, max({value}) AS value
    FROM events GROUP BY 1, 2
),
grid AS (
    SELECT dimension, unnest(generate_series((SELECT min(window_start) FROM periods),
        (SELECT max(window_start) FROM periods), INTERVAL '{period}')) AS window_start
    FROM (SELECT DISTINCT dimension FROM periods)
),
filled AS (
    SELECT '{metric}' AS metric, g.dimension, g.window_start, p.value, COALESCE(p.value > {threshold}, {missing}) AS breach
    FROM grid g LEFT JOIN periods p ON p.dimension = g.dimension AND p.window_start = g.window_start
),
states AS (
    SELECT *, CASE WHEN sum(breach::INTEGER) OVER (PARTITION BY dimension ORDER BY window_start
        ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW) = {periods} THEN 'ALARM' ELSE 'OK' END AS state
    FROM filled
)"""


BACKLOG = filled("QueueDepth", QUEUE, "value", "100", "5 minutes", "FALSE", 3)
BACKLOG_HOURLY = filled("QueueDepth", QUEUE, "value", "100", "1 hour", "FALSE", 3)
MISSING = filled("IndexAgeDays", "'env-' || user_id", "value * 2", "400", "1 day", "TRUE", 1)

# The same with dimensions that never report, due from their own day on.
MISSING_EXPECTED = MISSING.replace(
    "FROM (SELECT DISTINCT dimension FROM periods)\n)",
    """FROM (SELECT DISTINCT dimension FROM periods)
    UNION ALL
    SELECT 'silent-' || n_nationkey, unnest(generate_series((SELECT min(window_start) FROM periods) + to_days(CAST(n_nationkey % 3 AS INTEGER)),
        (SELECT max(window_start) FROM periods), INTERVAL '1 day')) FROM nation
),
due AS (SELECT dimension, min(window_start) AS window_start FROM (
    SELECT dimension, window_start FROM periods UNION ALL SELECT dimension, window_start FROM grid WHERE dimension LIKE 'silent-%') GROUP BY dimension)""",
)


@query(sql(MISSING_EXPECTED, select="SELECT * FROM states"))
def missing_data_alarm_expected(t: Tables) -> DataFrame:
    return op.missing_data_alarm(src.age_points(t), expected=src.expected_alarms(t))


@query(sql(BACKLOG, select="SELECT * FROM states"))
def backlog_alarm(t: Tables) -> DataFrame:
    return op.backlog_alarm(src.depth_points(t))


@query(sql(BACKLOG_HOURLY, select="SELECT * FROM states"))
def backlog_alarm_hourly(t: Tables) -> DataFrame:
    return op.backlog_alarm(src.depth_points(t), period="1 hour")


@query(sql(MISSING, select="SELECT * FROM states"))
def missing_data_alarm(t: Tables) -> DataFrame:
    return op.missing_data_alarm(src.age_points(t))


TRANSITIONS = """SELECT metric, dimension, window_start, previous_state, state, state = 'ALARM' OR {ok} AS notify FROM (
    SELECT *, lag(state, 1, 'OK') OVER (PARTITION BY dimension ORDER BY window_start) AS previous_state FROM states)
    WHERE state <> previous_state"""


@query(sql(BACKLOG_HOURLY, select=TRANSITIONS.format(ok="TRUE")))
def alarm_transitions(t: Tables) -> DataFrame:
    states = op.backlog_alarm(src.depth_points(t), period="1 hour")
    return op.alarm_transitions(states, F.lit(True))


@query(sql(MISSING, select=TRANSITIONS.format(ok="FALSE")))
def alarm_transitions_without_ok(t: Tables) -> DataFrame:
    states = op.missing_data_alarm(src.age_points(t))
    return op.alarm_transitions(states, F.lit(False))


@query(
    f"""SELECT 'samples-' || {QUEUE} AS bucket,
        CASE WHEN event_type IN ('view', 'click') THEN 'StandardStorage' ELSE 'StandardIAStorage' END AS storage_class,
        date_trunc('day', ts)::TIMESTAMP AS window_start, avg(CAST(round(value * 1000) AS BIGINT)) AS avg_bytes,
        avg(event_id % 1000) AS avg_objects
    FROM events GROUP BY 1, 2, 3"""
)
def storage_rollup(t: Tables) -> DataFrame:
    return op.storage_rollup(src.storage_points(t))


@query(
    sql(
        JOBS,
        f"""
queues AS (
    SELECT {QUEUE.replace("user_id", "r_regionkey")} AS queue,
        CASE r_regionkey WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN NULL WHEN 3 THEN 2 ELSE 4 END AS gb,
        10 * r_regionkey AS desired,
        CASE r_regionkey WHEN 0 THEN 60 WHEN 1 THEN 500 WHEN 2 THEN 64 WHEN 3 THEN 20 ELSE 4096 END AS max_vcpus
    FROM region
),
demand AS (
    SELECT q.*, COALESCE(j.v, 0) AS job_vcpus, COALESCE(j.m, 0) AS job_memory_mb,
        CASE WHEN gb IS NOT NULL THEN greatest(COALESCE(j.v, 0),
            CAST(ceil(COALESCE(j.m, 0) / (1024 * gb)) AS BIGINT)) END AS demand_vcpus
    FROM queues q LEFT JOIN (
        SELECT queue, CAST(sum(vcpus) AS BIGINT) AS v, CAST(sum(memory_mb) AS BIGINT) AS m FROM jobs
        WHERE status IN ('RUNNABLE', 'STARTING', 'RUNNING') GROUP BY queue
    ) j ON j.queue = q.queue
)""",
        select="""SELECT queue, job_vcpus, job_memory_mb, demand_vcpus, target_vcpus, demand_vcpus > max_vcpus AS capped,
            CASE WHEN target_vcpus IS NULL THEN 'unknown_family' WHEN target_vcpus <= desired THEN 'none'
                WHEN target_vcpus > 64 THEN 'over_limit' ELSE 'scale' END AS action
        FROM (SELECT *, CASE WHEN demand_vcpus IS NOT NULL THEN CAST(least(demand_vcpus, max_vcpus) AS BIGINT) END
            AS target_vcpus FROM demand)""",
    )
)
def queue_demand(t: Tables) -> DataFrame:
    return op.queue_demand(src.jobs(t), src.queues(t))


@query(sql(JOBS, select="SELECT job_id, queue, status_reason FROM jobs WHERE status_reason LIKE 'Host EC2 (instance i-%) terminated.'"))
def spot_reclaims(t: Tables) -> DataFrame:
    return op.spot_reclaims(src.jobs(t)).select("job_id", "queue", "status_reason")


HISTORY = """
history AS (
    SELECT 'run-' || (event_id // 10) AS execution_arn, event_id AS id, event_type, user_id FROM events
)"""


@query(
    sql(
        HISTORY,
        select="""SELECT execution_arn, id AS last_event_id,
            CASE event_type WHEN 'click' THEN 'ExecutionSucceeded' WHEN 'error' THEN 'ExecutionFailed'
                WHEN 'purchase' THEN 'ExecutionFailed' ELSE 'TaskSubmitted' END AS type,
            CASE event_type WHEN 'error' THEN 'InvalidInputFileError' WHEN 'purchase' THEN 'States.Timeout' END AS error,
            CASE event_type WHEN 'error' THEN 'bad input ' || user_id
                WHEN 'purchase' THEN 'step ' || user_id || ' took too long' END AS cause,
            CASE event_type WHEN 'click' THEN '{"counts":"out/' || id || '.json"}' END AS result
        FROM (SELECT *, row_number() OVER (PARTITION BY execution_arn ORDER BY id DESC) AS r FROM history) WHERE r = 1""",
    )
)
def execution_outcome(t: Tables) -> DataFrame:
    return op.execution_outcome(src.history(t))


@query(
    sql(
        HISTORY,
        select="""SELECT h.execution_arn, h.id AS event_id, 'job-' || h.id AS job_id FROM history h
        WHERE h.event_type = 'view' AND h.execution_arn IN (
            SELECT execution_arn FROM history GROUP BY execution_arn
            HAVING arg_max(event_type, id) IN ('purchase', 'signup', 'view'))""",
    )
)
def orphan_jobs(t: Tables) -> DataFrame:
    history = src.history(t)
    return op.orphan_jobs(history, src.history_executions(op.execution_outcome(history)))


@query(
    """SELECT 'job-' || (event_id // 10) AS job_id, 'InsufficientReadsError' AS error, 'sample ' || user_id AS cause
    FROM events e WHERE event_type = 'error'
        AND event_id = (SELECT max(m.event_id) FROM events m WHERE m.event_id // 10 = e.event_id // 10)"""
)
def structured_errors(t: Tables) -> DataFrame:
    return op.structured_errors(src.stderr_lines(t))


@query(
    """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,
        time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end, max(value) AS value
    FROM events WHERE event_type = 'view' GROUP BY 1, 2"""
)
def runs_in_progress(t: Tables) -> DataFrame:
    return op.runs_in_progress(src.status_points(t))


def rollup_sql(period: str, statistic: str) -> str:
    return f"""SELECT event_type AS metric, {QUEUE} AS dimension, time_bucket(INTERVAL '{period}', ts) AS window_start,
        time_bucket(INTERVAL '{period}', ts) + INTERVAL '{period}' AS window_end,
        {statistic}(CAST(round(value * 100) AS DOUBLE)) AS value
    FROM events GROUP BY 1, 2, 3, 4"""


@query(rollup_sql("6 hours", "max"))
def metric_rollup_cost(t: Tables) -> DataFrame:
    return op.metric_rollup(src.gauge_points(t), "6 hours", "max")


@query(rollup_sql("5 minutes", "avg"))
def metric_rollup_load(t: Tables) -> DataFrame:
    return op.metric_rollup(src.gauge_points(t), "5 minutes", "average")


@query(rollup_sql("5 minutes", "max"))
def metric_rollup_throttles(t: Tables) -> DataFrame:
    return op.metric_rollup(src.gauge_points(t), "5 minutes", "max")
