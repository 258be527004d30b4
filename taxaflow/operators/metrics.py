"""Operational metrics: status counts, rollups, threshold alarms, execution outcomes.

Every aggregate is combined before its shuffle. Windows run over pre-aggregated periods, so a
window partition grows with the time covered and never with the number of points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.operators.lookups import spread_join

# Fixed values of the job and execution reports.
TERMINAL_STATES = ["SUCCEEDED", "ABORTED", "FAILED"]
JOB_STATES = ["SUBMITTED", "PENDING", "RUNNABLE", "STARTING", "RUNNING", "SUCCEEDED", "FAILED"]
OUTCOMES = ["ABORTED", "SUCCEEDED", "TIMED_OUT", "THROTTLED", "FAILED", "STARTED"]
EXECUTION_DURATION_LIMIT_MS = 21600000
QUEUE_DEPTH_LIMIT = 100
INDEX_AGE_LIMIT_DAYS = 400
MEMORY_GB_PER_VCPU = {"r5": 8, "m5": 4, "c5": 2}
EXPEDITED_VCPU_LIMIT = 64
SPOT_RECLAIM = r"^Host EC2 \(instance i-.*\) terminated\.$"


def list_jobs(jobs: DataFrame, queues: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Jobs of the given queues in the given states."""
    return jobs.filter(F.col("queue").isin(*queues) & F.col("status").isin(*statuses))


# ---- status counts --------------------------------------------------------------------------


def _failure_percent(counts: DataFrame) -> DataFrame:
    failed = F.coalesce(F.sum(F.when(F.col("status") == "FAILED", F.col("n"))), F.lit(0))
    return (
        counts.agg(failed.alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        .filter("total > 0")
        .select("failed", "total", (100 * F.col("failed") / F.col("total")).alias("failed_percent"))
    )


def job_status_counts(jobs: DataFrame, namespace: str, now: Column, horizon: Column) -> DataFrame:
    """Jobs per status in queues of the namespace; finished ones only when created recently."""
    created = F.timestamp_seconds(F.expr("created_at_ms div 1000")).cast("timestamp_ntz")
    recent = created > now - horizon
    return (
        jobs.filter(F.col("queue").startswith(namespace) & F.col("status").isin(*JOB_STATES))
        .filter(recent | ~F.col("status").isin(*TERMINAL_STATES))
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    )


def job_failure_percent(jobs: DataFrame, namespace: str, now: Column, horizon: Column) -> DataFrame:
    return _failure_percent(job_status_counts(jobs, namespace, now, horizon))


def execution_status_counts(executions: DataFrame, namespace: str, now: Column, horizon: Column) -> DataFrame:
    """Executions per status; finished ones only when stopped recently.

    ``TIMED_OUT`` is not among the terminal states, so those are counted whatever their age.
    """
    machine = F.substring_index("state_machine", ":", -1)
    return (
        executions.filter(machine.startswith(namespace))
        .filter(~F.col("status").isin(*TERMINAL_STATES) | (F.col("stop_date") > now - horizon))
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    )


def execution_failure_percent(executions: DataFrame, namespace: str, now: Column, horizon: Column) -> DataFrame:
    return _failure_percent(execution_status_counts(executions, namespace, now, horizon))


def status_metrics(jobs: DataFrame, executions: DataFrame, namespace: str, now: Column, horizon: Column) -> DataFrame:
    """The counts and percentages as metric rows ready to be published."""

    def rows(counts: DataFrame, metric: str, percent_metric: str) -> DataFrame:
        per_status = counts.select(
            F.lit(metric).alias("metric"),
            F.lit(metric).alias("dimension"),
            F.col("status").alias("dimension_value"),
            F.lit(None).cast("string").alias("unit"),
            F.col("n").cast("double").alias("value"),
        )
        percent = _failure_percent(counts).select(
            F.lit(percent_metric).alias("metric"),
            F.lit(None).cast("string").alias("dimension"),
            F.lit(None).cast("string").alias("dimension_value"),
            F.lit("Percent").alias("unit"),
            F.col("failed_percent").alias("value"),
        )
        return per_status.unionByName(percent)

    job_rows = rows(job_status_counts(jobs, namespace, now, horizon), "BatchJobStatus", "BatchPercentFailedJobs")
    execution_rows = rows(
        execution_status_counts(executions, namespace, now, horizon),
        "SFNExecutionStatus",
        "SFNPercentFailedExecutions",
    )
    return job_rows.unionByName(execution_rows).select(F.lit(namespace).alias("namespace"), "*")


# ---- rollups --------------------------------------------------------------------------------

STATISTICS = {"sum": F.sum, "max": F.max, "min": F.min, "average": F.avg, "count": F.count}


def metric_rollup(points: DataFrame, period: str, statistic: str, by: Sequence[str] = ("metric", "dimension")) -> DataFrame:
    """One value per period and dimension with the chosen statistic."""
    return (
        points.groupBy(*by, F.window("ts", period).alias("_w"))
        .agg(STATISTICS[statistic]("value").alias("value"))
        .select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "value")
    )


def hourly_outcomes(points: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Executions per outcome, state machine and hour over the last days, one column per outcome.

    ``points`` has ``state_machine, outcome, ts, value``.
    """
    recent = points.filter((F.col("ts") >= now - F.make_interval(days=F.lit(days))) & (F.col("ts") < now))
    sums = [
        F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("value"))), F.lit(0)).alias(o.lower()) for o in OUTCOMES
    ]
    return (
        recent.groupBy("state_machine", F.window("ts", "1 hour").alias("_w"))
        .agg(*sums)
        .select(
            "state_machine",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            *[o.lower() for o in OUTCOMES],
        )
    )


def storage_rollup(points: DataFrame) -> DataFrame:
    """Daily average bytes and object count per bucket and storage class."""
    return (
        points.groupBy("bucket", "storage_class", F.window("ts", "1 day").alias("_w"))
        .agg(F.avg("size_bytes").alias("avg_bytes"), F.avg("objects").alias("avg_objects"))
        .select("bucket", "storage_class", F.col("_w.start").alias("window_start"), "avg_bytes", "avg_objects")
    )


def runs_in_progress(points: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Highest RUNNING count per period; ``points`` has ``status, ts, value``."""
    return metric_rollup(points.filter("status = 'RUNNING'"), period, "max", by=())


# ---- alarms ---------------------------------------------------------------------------------


def threshold_alarm(
    points: DataFrame, threshold: float, statistic: str, period: str = "5 minutes", by: Sequence[str] = ("metric", "dimension")
) -> DataFrame:
    """Periods with data and whether their statistic is above the threshold."""
    return metric_rollup(points, period, statistic, by).withColumn("breach", F.col("value") > threshold)


def sum_alarm(points: DataFrame, threshold: float = 0) -> DataFrame:
    """Any failure, time-out or abort within five minutes."""
    return threshold_alarm(points, threshold, "sum")


def duration_alarm(points: DataFrame, threshold_ms: float = EXECUTION_DURATION_LIMIT_MS) -> DataFrame:
    return threshold_alarm(points, threshold_ms, "max")


def fill_periods(
    periods: DataFrame,
    period: str,
    missing_breaches: bool,
    by: Sequence[str] = ("metric", "dimension"),
    start: Column | None = None,
    end: Column | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Every period in ``[start, end)`` for every dimension; missing ones get the given policy.

    Without bounds the range is that of all periods given, so none of them is lost. Bounds of the
    caller can widen it, and periods outside them are kept as they are. ``expected`` lists dimensions
    that have all periods from their ``since`` on though they may never have reported.
    """
    bounds = periods.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high")).first()
    if bounds.low is None and (expected is None or start is None or end is None):
        return periods.drop("window_end")
    step = F.expr(f"INTERVAL '{period}'")
    low, high = F.lit(bounds.low).cast("timestamp_ntz"), F.lit(bounds.high).cast("timestamp_ntz")
    low = low if start is None else F.least(low, start)
    high = high if end is None else F.greatest(high, end - step)
    grid = periods.select(*by).distinct().withColumn("window_start", F.explode(F.sequence(low, high, step)))
    if expected is not None:
        due = expected.withColumn("window_start", F.explode(F.sequence(low, high, step))).filter(F.col("window_start") + step > F.col("since"))
        grid = grid.unionByName(due.select(*by, "window_start")).distinct()
    return grid.join(periods.drop("window_end"), [*by, "window_start"], "left").withColumn(
        "breach", F.coalesce("breach", F.lit(missing_breaches))
    )


def consecutive_alarm(
    filled: DataFrame, evaluation_periods: int, by: Sequence[str] = ("metric", "dimension")
) -> DataFrame:
    """ALARM where the last ``evaluation_periods`` periods all breach, else OK."""
    last = Window.partitionBy(*by).orderBy("window_start").rowsBetween(1 - evaluation_periods, 0)
    breaches = F.sum(F.col("breach").cast("int")).over(last)
    return filled.withColumn("state", F.when(breaches == evaluation_periods, "ALARM").otherwise("OK"))


def backlog_alarm(
    points: DataFrame,
    threshold: float = QUEUE_DEPTH_LIMIT,
    period: str = "5 minutes",
    evaluation_periods: int = 3,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Queue depth above the limit for several periods in a row; a missing period does not breach."""
    breaches = threshold_alarm(points, threshold, "max", period)
    return consecutive_alarm(fill_periods(breaches, period, False, start=start, end=end), evaluation_periods)


def missing_data_alarm(
    points: DataFrame,
    threshold: float = INDEX_AGE_LIMIT_DAYS,
    period: str = "1 day",
    start: Column | None = None,
    end: Column | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Daily maximum above the limit; a day without data breaches too, also of an expected dimension that never reports."""
    breaches = threshold_alarm(points, threshold, "max", period)
    return consecutive_alarm(fill_periods(breaches, period, True, start=start, end=end, expected=expected), 1)


def alarm_transitions(states: DataFrame, ok_action: Column, by: Sequence[str] = ("metric", "dimension")) -> DataFrame:
    """Entries into ALARM and returns to OK; an alarm starts out OK.

    ``notify`` is false for a return to OK of an alarm without an OK action.
    """
    previous = F.lag("state", 1, "OK").over(Window.partitionBy(*by).orderBy("window_start"))
    return (
        states.withColumn("previous_state", previous)
        .filter(F.col("state") != F.col("previous_state"))
        .select(*by, "window_start", "previous_state", "state", ((F.col("state") == "ALARM") | ok_action).alias("notify"))
    )


# ---- queues, executions, errors -------------------------------------------------------------


def queue_demand(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """vCPU demand per queue against its compute environment, and what a resize would do.

    ``queues`` has ``queue, instance_types, desired_vcpus, max_vcpus``, one row per queue. An
    environment of unknown or mixed instance families gets the action ``unknown_family``.
    """

    def all_of(family: str) -> Column:
        return F.forall("instance_types", lambda i: i.startswith(family))

    family_gb = F.coalesce(*[F.when(all_of(f), F.lit(gb)) for f, gb in MEMORY_GB_PER_VCPU.items()])
    load = (
        jobs.filter(F.col("status").isin("RUNNABLE", "STARTING", "RUNNING"))
        .groupBy("queue")
        .agg(F.sum("vcpus").alias("job_vcpus"), F.sum("memory_mb").alias("job_memory_mb"))
    )
    by_memory = F.ceil(F.col("job_memory_mb") / (1024 * family_gb))
    demand = F.when(family_gb.isNotNull(), F.greatest("job_vcpus", by_memory))
    target = F.when(F.col("demand_vcpus").isNotNull(), F.least("demand_vcpus", F.col("max_vcpus")))
    return (
        queues.join(load, "queue", "left")
        .fillna(0, ["job_vcpus", "job_memory_mb"])
        .withColumn("demand_vcpus", demand)
        .withColumn("target_vcpus", target)
        .select(
            "queue",
            "job_vcpus",
            "job_memory_mb",
            "demand_vcpus",
            "target_vcpus",
            (F.col("demand_vcpus") > F.col("max_vcpus")).alias("capped"),
            F.when(F.col("target_vcpus").isNull(), "unknown_family")
            .when(F.col("target_vcpus") <= F.col("desired_vcpus"), "none")
            .when(F.col("target_vcpus") > EXPEDITED_VCPU_LIMIT, "over_limit")
            .otherwise("scale")
            .alias("action"),
        )
    )


def spot_reclaims(jobs: DataFrame) -> DataFrame:
    """Jobs that failed because their spot host was taken away."""
    return jobs.filter(F.col("status_reason").rlike(SPOT_RECLAIM))


def execution_outcome(history: DataFrame) -> DataFrame:
    """Last history event per execution with error name, cause and result.

    ``history`` has ``execution_arn, id, type, error, cause, output``. The cause is the
    ``errorMessage`` inside a JSON cause, else the cause as it is.
    """
    fields = ["id", "type", "error", "cause", "output"]
    last = history.groupBy("execution_arn").agg(F.max_by(F.struct(*fields), "id").alias("e"))
    return last.select(
        "execution_arn",
        F.col("e.id").alias("last_event_id"),
        F.col("e.type").alias("type"),
        F.col("e.error").alias("error"),
        F.coalesce(F.get_json_object("e.cause", "$.errorMessage"), F.col("e.cause")).alias("cause"),
        F.when(F.col("e.type") == "ExecutionSucceeded", F.get_json_object("e.output", "$.Result")).alias("result"),
    )


def orphan_jobs(history: DataFrame, executions: DataFrame) -> DataFrame:
    """Batch jobs submitted by executions that were aborted or timed out.

    ``history`` has ``execution_arn, id, resource_type, output``; rows carry the event id, which
    gives the order of submission.
    """
    stopped = executions.filter(F.col("status").isin("ABORTED", "TIMED_OUT")).select("execution_arn")
    submitted = history.filter("resource_type = 'batch'")
    return spread_join(submitted, stopped, ["execution_arn"], ["id"], "left_semi").select(
        "execution_arn", F.col("id").alias("event_id"), F.get_json_object("output", "$.JobId").alias("job_id")
    )


def structured_errors(stderr: DataFrame) -> DataFrame:
    """Error and cause of jobs whose last stderr line is a structured error message."""
    last = stderr.groupBy("job_id").agg(F.max_by("line", "line_no").alias("line"))
    parsed = F.from_json("line", "wdl_error_message BOOLEAN, error STRING, cause STRING")
    return (
        last.withColumn("e", parsed)
        .filter("e.wdl_error_message")
        .select("job_id", F.col("e.error").alias("error"), F.col("e.cause").alias("cause"))
    )
