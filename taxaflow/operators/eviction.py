"""Change detection between the index and its source, expiry, and eviction planning.

Anti and semi joins take their right side as it is: duplicates there change nothing, and Spark can
split a run that is hot on the left, since neither side was aggregated on the join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.lookups import spread_join
from taxaflow.operators.positions import with_positions
from taxaflow.session import settle

RUN = "pipeline_run_id"
BACKGROUND = "background_id"

# Fixed defaults of the eviction job.
TTL_DAYS = 30
TASK_CONCURRENCY = 6
RUNS_PER_TASK = 500


def deleted_runs(index: DataFrame, source_runs: DataFrame) -> DataFrame:
    """Distinct runs that are in the index and no longer in the source table."""
    return index.select(RUN).distinct().join(source_runs.select(RUN), RUN, "left_anti")


def expiry_cutoff(now: Column, ttl_days: int = TTL_DAYS) -> Column:
    """Start of the day ``ttl_days`` before ``now``."""
    return F.date_trunc("DAY", now).cast("timestamp_ntz") - F.make_interval(days=F.lit(ttl_days))


def expired_runs(index: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Status documents last read before the cutoff, or created before it and never read."""
    cutoff = expiry_cutoff(now, ttl_days)
    read, created = F.col("last_read_at"), F.col("created_at")
    return index.filter((read < cutoff) | (read.isNull() & (created < cutoff)))


def expired_by_background(expired: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Expired ``(background, run)`` rows without the excluded runs; duplicates are kept.

    Stays flat: a background may hold most runs, so its list is never built in one row.
    """
    rows = expired.select(BACKGROUND, RUN)
    if excluded is None:
        return rows
    return rows.join(excluded.select(RUN), RUN, "left_anti").select(BACKGROUND, RUN)


def runs_being_deleted(index: DataFrame) -> DataFrame:
    return index.filter(F.col("deletion_task").isNotNull())


def eviction_candidates(
    index: DataFrame, source_runs: DataFrame, being_deleted: DataFrame, now: Column, ttl_days: int = TTL_DAYS
) -> DataFrame:
    """Runs to evict: whole runs (``background_id`` NULL) and expired run/background pairs.

    A pair is left out when its run is already being deleted or will be deleted as a whole.
    """
    whole = deleted_runs(index, source_runs).join(being_deleted.select(RUN), RUN, "left_anti")
    expired = expired_by_background(expired_runs(index, now, ttl_days), being_deleted)
    pairs = expired_by_background(expired, whole)
    return whole.select(F.lit("run").alias("kind"), F.lit(None).cast("bigint").alias(BACKGROUND), RUN).unionByName(
        pairs.select(F.lit("run_background").alias("kind"), BACKGROUND, RUN)
    )


def capacity(running_tasks: int, concurrency: int = TASK_CONCURRENCY) -> int:
    return max(concurrency - running_tasks, 0)


def numbered_batches(candidates: DataFrame, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """Candidates with the number of the batch each one belongs to.

    Whole runs come first, then one background after the other, each cut into chunks of at most
    ``runs_per_task`` ids; ``batch_no`` counts the chunks over everything.
    """
    keyed = candidates.select(
        (F.col("kind") != "run").cast("int").alias("_order"),
        F.coalesce(BACKGROUND, F.lit(-1).cast("bigint")).alias("_background"),
        RUN,
    )
    group = ["_order", "_background"]
    placed = with_positions(keyed, [RUN], group).withColumn(
        "_chunk", F.expr(f"position div {runs_per_task}")
    )
    # The first run of each chunk stands for the chunk.
    heads = placed.filter(F.col("position") % runs_per_task == 0).select(*group, "_chunk")
    numbers = with_positions(heads, [*group, "_chunk"], name="batch_no")
    return placed.join(numbers, [*group, "_chunk"]).select(
        F.when(F.col("_order") == 0, "run").otherwise("run_background").alias("kind"),
        F.when(F.col("_order") == 1, F.col("_background")).alias(BACKGROUND),
        RUN,
        "batch_no",
    )


def eviction_batches(
    candidates: DataFrame, task_capacity: int, runs_per_task: int = RUNS_PER_TASK
) -> DataFrame:
    """One row per batch with its run ids; ``started`` marks those within the capacity."""
    return (
        numbered_batches(candidates, runs_per_task)
        .groupBy("batch_no", "kind", BACKGROUND)
        .agg(F.sort_array(F.collect_list(RUN)).alias("run_ids"))
        .withColumn("started", F.col("batch_no") < task_capacity)
    )


def first_batches(candidates: DataFrame, task_capacity: int, runs_per_task: int = RUNS_PER_TASK) -> DataFrame:
    """The batches an eviction run starts."""
    return eviction_batches(candidates, task_capacity, runs_per_task).filter("started")


# ---- deletion tasks -------------------------------------------------------------------------


def task_key(node: Column, task_id: Column) -> Column:
    return F.concat_ws(":", node, task_id.cast("string"))


def running_tasks(listing: DataFrame) -> DataFrame:
    """Flatten the nested ``node -> task`` maps of task listings to one row per task."""
    per_node = listing.select(F.explode("nodes").alias("_node", "_report"))
    tasks = per_node.select(F.explode("_report.tasks").alias("_key", "task"))
    return tasks.select(F.col("_key").alias("deletion_task"), "task.node", "task.id")


def completed_tasks(documents: DataFrame) -> DataFrame:
    """One row per finished task with its outcome.

    Failed means an error or any failure, whether or not the task says it completed.
    """
    no_failures = F.coalesce(F.size("response.failures"), F.lit(0)) <= 0
    clean = F.col("error").isNull() & no_failures
    return documents.select(
        task_key(F.col("task.node"), F.col("task.id")).alias("deletion_task"),
        F.col("task.node").alias("node"),
        F.col("task.id").alias("id"),
        (F.coalesce("completed", F.lit(False)) & clean).alias("succeeded"),
        (~clean).alias("failed"),
    )


def tasks_by_ids(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks whose key is in ``wanted.deletion_task``."""
    return tasks.join(wanted.select("deletion_task"), "deletion_task", "left_semi")


def task_flags(running: DataFrame, completed: DataFrame) -> DataFrame:
    """One row per known task key with its statuses."""
    flags = running.select(
        "deletion_task", F.lit(True).alias("running"), F.lit(False).alias("succeeded"), F.lit(False).alias("failed")
    ).unionByName(completed.select("deletion_task", F.lit(False).alias("running"), "succeeded", "failed"))
    return flags.groupBy("deletion_task").agg(
        F.bool_or("running").alias("running"), F.bool_or("succeeded").alias("succeeded"), F.bool_or("failed").alias("failed")
    )


def task_status(index: DataFrame, running: DataFrame, completed: DataFrame) -> DataFrame:
    """Each run under deletion with the status flags of its task.

    The flags are not exclusive, and a task that finished neither well nor badly has none.
    ``missing`` means no listing knows the task.
    """
    runs = runs_being_deleted(index).select(RUN, BACKGROUND, "deletion_task")
    known = task_flags(running, completed).withColumn("_found", F.lit(True))
    joined = spread_join(runs, known, ["deletion_task"], [RUN, BACKGROUND])
    return joined.select(
        RUN,
        BACKGROUND,
        "deletion_task",
        F.col("_found").isNull().alias("missing"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("running", "succeeded", "failed")],
    )


def task_counts(statuses: DataFrame) -> DataFrame:
    """Number of distinct tasks and of runs per status, one row."""
    per_task = statuses.groupBy("deletion_task").agg(
        F.count("*").alias("_runs"), *[F.first(c).alias(c) for c in ("missing", "running", "succeeded", "failed")]
    )
    states = ("missing", "running", "succeeded", "failed")
    return per_task.agg(
        *[F.count_if(c).alias(f"{c}_tasks") for c in states],
        *[F.coalesce(F.sum(F.when(F.col(c), F.col("_runs"))), F.lit(0)).alias(f"{c}_runs") for c in states],
    )


def task_cleanup_plan(statuses: DataFrame) -> DataFrame:
    """What to do for each run under deletion.

    Succeeded: drop the task and the status document. Failed: drop the task so the run is tried
    again. Running and succeeded runs are excluded from new evictions.
    """
    return statuses.select(
        RUN,
        BACKGROUND,
        "deletion_task",
        (F.col("succeeded") | F.col("failed")).alias("drop_task"),
        F.col("succeeded").alias("drop_status_document"),
        (F.col("running") | F.col("succeeded")).alias("exclude_from_eviction"),
    )


def excluded_runs(statuses: DataFrame) -> DataFrame:
    """Runs whose deletion is running or done; nothing new is started for them."""
    return statuses.filter(F.col("running") | F.col("succeeded")).select(RUN, BACKGROUND)


# ---- updates and deletes --------------------------------------------------------------------


def mark_being_deleted(index: DataFrame, marked: DataFrame) -> DataFrame:
    """Set ``is_complete = false`` and the task on every status document in ``marked``.

    ``marked`` has ``pipeline_run_id, background_id, task_id``; a NULL background marks the run in
    every background. A run/background mark wins over a whole-run mark.
    """
    whole = marked.filter(F.col(BACKGROUND).isNull()).groupBy(RUN).agg(F.max("task_id").alias("_run_task"))
    pairs = (
        marked.filter(F.col(BACKGROUND).isNotNull()).groupBy(RUN, BACKGROUND).agg(F.max("task_id").alias("_pair_task"))
    )
    joined = index.join(whole, RUN, "left").join(pairs, [RUN, BACKGROUND], "left")
    task = F.coalesce("_pair_task", "_run_task")
    return joined.select(
        *[
            F.when(task.isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c)
            if c == "is_complete"
            else (F.coalesce(task, F.col(c)).alias(c) if c == "deletion_task" else F.col(c))
            for c in index.columns
        ]
    )


def delete_by_run(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents left after deleting whole runs."""
    return documents.join(runs.select(RUN), RUN, "left_anti").select(*documents.columns)


def delete_by_run_background(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents left after deleting runs in one background each."""
    return documents.join(pairs.select(RUN, BACKGROUND), [RUN, BACKGROUND], "left_anti").select(*documents.columns)


def delete_status_documents(index: DataFrame, pairs: DataFrame) -> DataFrame:
    return delete_by_run_background(index, pairs)


def delete_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks left after deleting those in ``ids.deletion_task``."""
    return tasks.join(ids.select("deletion_task"), "deletion_task", "left_anti").select(*tasks.columns)


# ---- report ---------------------------------------------------------------------------------

# Fixed messages of the eviction report.
FAILED_TASKS = "Failed tasks found"
MISSING_TASKS = "Missing tasks found"
START_FAILED = "Eviction start failed"
MARK_FAILED = "Task ID set failed after eviction started"
CLEANUP_LABELS = {
    "succeeded": "Succeeded task deletion",
    "failed": "Failed task deletion",
    "pipeline_runs": "Pipeline_run cleanup",
}


def eviction_report(statuses: DataFrame, cleanup: DataFrame, started: DataFrame) -> DataFrame:
    """Warnings and errors of one eviction cycle with how often each occurred.

    ``cleanup (step, error)`` holds the results of the clean-up steps and
    ``started (batch_no, start_error, mark_error)`` those of the started batches. Failed or missing
    tasks count once each whatever their number; a failed start hides a failed mark.
    """
    tasks = task_counts(statuses).select(
        F.explode(
            F.array(
                F.struct(F.lit(FAILED_TASKS).alias("message"), F.col("failed_tasks").alias("n")),
                F.struct(F.lit(MISSING_TASKS).alias("message"), F.col("missing_tasks").alias("n")),
            )
        ).alias("r")
    )
    task_errors = tasks.filter("r.n > 0").select(F.lit("error").alias("severity"), "r.message", F.lit(1).cast("bigint").alias("n"))
    label = F.create_map(*[F.lit(x) for pair in CLEANUP_LABELS.items() for x in pair])
    warnings = (
        cleanup.filter("error IS NOT NULL")
        .groupBy(F.concat(label[F.col("step")], F.lit(" failed")).alias("message"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("warning").alias("severity"), "message", "n")
    )
    start_errors = (
        started.select(
            F.when(F.col("start_error").isNotNull(), START_FAILED)
            .when(F.col("mark_error").isNotNull(), MARK_FAILED)
            .alias("message")
        )
        .filter("message IS NOT NULL")
        .groupBy("message")
        .agg(F.count("*").alias("n"))
        .select(F.lit("error").alias("severity"), "message", "n")
    )
    return task_errors.unionByName(warnings).unionByName(start_errors)


class EvictionError(Exception):
    """An eviction cycle ended with warnings or errors."""


def raise_on_report(report: DataFrame) -> None:
    """Fail the job when the report is not empty; the report has a handful of rows at most."""
    lines = [f"{r.severity}: {r.message} ({r.n})" for r in report.orderBy("severity", "message").collect()]
    if lines:
        raise EvictionError("; ".join(lines))


def raise_on_failed_steps(report: DataFrame) -> None:
    """Fail the job when a step of the cycle failed, whatever the report says of the tasks that the cycle found."""
    raise_on_report(report.filter(~F.col("message").isin(FAILED_TASKS, MISSING_TASKS)))


def evicted_rows(batches: DataFrame, node: str) -> DataFrame:
    """Runs of the started batches with the id of their task."""
    return batches.select(
        BACKGROUND, F.explode("run_ids").alias(RUN), task_key(F.lit(node), F.col("batch_no")).alias("task_id")
    )


def finished_tasks(batches: DataFrame, node: str) -> DataFrame:
    """Log rows of batches whose documents have been deleted."""
    return batches.select(
        task_key(F.lit(node), F.col("batch_no")).alias("deletion_task"),
        F.lit(node).alias("node"),
        F.col("batch_no").alias("id"),
        F.lit(True).alias("succeeded"),
        F.lit(False).alias("failed"),
    )


def delete_evicted(documents: DataFrame, evicted: DataFrame) -> DataFrame:
    """Documents left after the evicted runs, in one background or in all, are gone."""
    whole, pairs = evicted.filter(F.col(BACKGROUND).isNull()), evicted.filter(F.col(BACKGROUND).isNotNull())
    return delete_by_run_background(delete_by_run(documents, whole), pairs)


def evict(
    index: DataFrame,
    source_runs: DataFrame,
    running: DataFrame,
    completed: DataFrame,
    *,
    now: Column,
    ttl_days: int = TTL_DAYS,
    concurrency: int = TASK_CONCURRENCY,
    runs_per_task: int = RUNS_PER_TASK,
    dry_run: bool = False,
    node: str = "evict",
) -> dict[str, DataFrame | int]:
    """One eviction cycle; returns its frames and the capacity it found.

    Reconciles earlier deletion tasks, then plans as many batches as the capacity allows: ``batches``
    to start, ``evicted`` runs to delete, the ``index`` to write with their marks and without what
    succeeded before, and the ``completed_tasks`` to write, where this cycle's tasks count as done
    once their documents are gone. ``node`` names the cycle and makes its task ids unique. A dry run
    changes nothing. The single number read on the driver is the count of running tasks; it decides
    the early exit.
    """
    statuses = settle(task_status(index, running, completed))
    running_count = statuses.filter("running").select("deletion_task").distinct().count()
    free = capacity(running_count, concurrency)
    result: dict[str, DataFrame | int] = {"statuses": statuses, "capacity": free, "running_tasks": running_count}
    kept_index, kept_completed = index, completed
    if not dry_run:
        plan = task_cleanup_plan(statuses)
        kept_index = delete_status_documents(index, plan.filter("drop_status_document"))
        kept_completed = delete_tasks(completed, plan.filter("drop_task"))
    result |= {"index": kept_index, "completed_tasks": kept_completed}
    if free == 0:
        return result
    candidates = eviction_candidates(index, source_runs, excluded_runs(statuses), now, ttl_days)
    batches = settle(first_batches(candidates, free, runs_per_task))
    result |= {"candidates": candidates, "batches": batches}
    if dry_run:
        return result
    evicted = evicted_rows(batches, node)
    result["evicted"] = evicted
    result["index"] = mark_being_deleted(kept_index, evicted)
    result["completed_tasks"] = kept_completed.unionByName(finished_tasks(batches, node))
    return result
