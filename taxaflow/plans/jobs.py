"""Whole jobs over tables: index requested runs, and one eviction cycle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.operators import eviction, scoring
from taxaflow.sources import keyed_tables, sinks


@dataclass
class ScoringTables:
    counts: DataFrame
    runs: DataFrame
    configs: DataFrame
    lineages: DataFrame
    summaries: DataFrame
    contigs: DataFrame


def index_job(
    spark: SparkSession, tables: ScoringTables, events: DataFrame, documents_path: str, status_path: str, now: Column
) -> DataFrame:
    """Index every valid request and return one result row each.

    The status documents are begun first and completed last, so a failure in between leaves them
    incomplete; running the job again repairs that.
    """
    requests = scoring.request_validation(events).filter("is_valid")
    pairs = requests.select(*sinks.STATUS_KEYS).distinct()
    begun = sinks.begun_documents(pairs, now)
    keyed_tables.upsert_table(spark, status_path, begun, sinks.STATUS_KEYS)
    documents = scoring.requested_documents(
        tables.counts, tables.runs, tables.configs, tables.lineages, tables.summaries, tables.contigs, pairs
    )
    keyed_tables.upsert_table(spark, documents_path, documents, sinks.DOCUMENT_KEYS)
    done = begun.withColumn("is_complete", F.lit(True))
    keyed_tables.upsert_table(spark, status_path, done, sinks.STATUS_KEYS)
    written = keyed_tables.read_table(spark, documents_path).join(pairs, sinks.STATUS_KEYS, "left_semi")
    return scoring.index_runs(requests, written, keyed_tables.read_table(spark, status_path))


TASK_KEY = ("deletion_task",)


def evict_job(
    spark: SparkSession,
    source_runs: DataFrame,
    running: DataFrame,
    documents_path: str,
    index_path: str,
    tasks_path: str,
    now: Column,
    cycle: str,
    *,
    dry_run: bool = False,
    strict: bool = True,
    **options,
) -> DataFrame:
    """One eviction cycle over three keyed tables: documents, status index and task log.

    Earlier tasks are reconciled first: status documents of succeeded ones and log rows of succeeded and
    failed ones go. Then the documents of the planned runs are deleted, their status documents marked,
    and the new tasks logged. Each step touches only the buckets of its own rows and is one version of
    its table; a step that its table refuses is part of the report and changes nothing, any other error ends
    the cycle, and a cycle that breaks off is taken up by the next one. Without deleted documents nothing is
    marked, without marks nothing is logged. ``cycle`` makes task ids unique. The report covers reconciled
    tasks, clean-up and starts; ``strict`` raises when it is not empty, after all steps. Without it, whoever
    goes on with the tables asks ``eviction.raise_on_failed_steps`` first. A dry run writes nothing.
    """
    index, completed = keyed_tables.read_table(spark, index_path), keyed_tables.read_table(spark, tasks_path)
    result = eviction.evict(index, source_runs, running, completed, now=now, dry_run=dry_run, node=f"evict-{cycle}", **options)
    steps: list[tuple[str, str | None]] = []
    starts: list[tuple[int, str | None, str | None]] = []
    if not dry_run:
        steps = clean_up(spark, result["statuses"], index_path, tasks_path)
        if "evicted" in result:
            starts = [(0, *start(spark, result, index, f"evict-{cycle}", documents_path, index_path, tasks_path))]
    report = eviction.eviction_report(
        result["statuses"],
        spark.createDataFrame(steps, "step STRING, error STRING"),
        spark.createDataFrame(starts, "batch_no BIGINT, start_error STRING, mark_error STRING"),
    )
    if strict:
        eviction.raise_on_report(report)
    return report


def attempt(step: Callable[[], None]) -> str | None:
    """Run a step; the kind of its error when its table refused it. An error of Spark or of the code is raised."""
    try:
        step()
        return None
    except OSError as error:
        return type(error).__name__


def clean_up(spark: SparkSession, statuses: DataFrame, index_path: str, tasks_path: str) -> list[tuple[str, str | None]]:
    """Remove what finished tasks left; one (step, error) for the status documents and each outcome of tasks.

    Status documents go before the log rows of their tasks, so what is left after a failure is found again.
    """
    done = eviction.task_cleanup_plan(statuses).filter("drop_status_document")
    steps = [("pipeline_runs", attempt(lambda: keyed_tables.delete_rows(spark, index_path, done, lambda rows: eviction.delete_status_documents(rows, done))))]
    for outcome in ("succeeded", "failed"):
        tasks = statuses.filter(outcome).select("deletion_task").distinct()
        if outcome == "succeeded" and steps[0][1] is not None:
            continue
        error = attempt(lambda tasks=tasks: keyed_tables.delete_rows(spark, tasks_path, tasks, lambda rows: eviction.delete_tasks(rows, tasks), TASK_KEY))
        steps.append((outcome, error))
    return steps


def start(
    spark: SparkSession, result: dict, index: DataFrame, node: str, documents_path: str, index_path: str, tasks_path: str
) -> tuple[str | None, str | None]:
    """Delete the documents of the planned runs, mark their status documents, log their tasks: start and mark error."""
    evicted = result["evicted"]
    failure = attempt(lambda: delete_documents(spark, documents_path, evicted))
    if failure is not None:
        return failure, None

    def mark() -> None:
        done = eviction.task_cleanup_plan(result["statuses"]).filter("drop_status_document")
        own = index.join(evicted.select(eviction.RUN).distinct(), eviction.RUN, "left_semi")
        marked = eviction.mark_being_deleted(eviction.delete_status_documents(own, done), evicted)
        keyed_tables.upsert_table(spark, index_path, marked, sinks.STATUS_KEYS)
        keyed_tables.upsert_table(spark, tasks_path, eviction.finished_tasks(result["batches"], node), TASK_KEY, TASK_KEY)

    return None, attempt(mark)


def delete_documents(spark: SparkSession, path: str, evicted: DataFrame) -> None:
    """Delete the evicted runs from a keyed table of documents."""
    keyed_tables.delete_rows(spark, path, evicted, lambda rows: eviction.delete_evicted(rows, evicted))
