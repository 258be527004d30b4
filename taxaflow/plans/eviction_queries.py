"""Registered queries of change detection and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import eviction as op
from taxaflow.plans import eviction_inputs as src
from taxaflow.plans import jobs
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.session import new_shared_path
from taxaflow.sources import keyed_tables
from taxaflow.sources.tables import Tables

NOW = "TIMESTAMP_NTZ'1998-07-01 12:00:00'"
RUNS_PER_TASK = 50

INDEX = """
idx AS (
    SELECT o_orderkey AS pipeline_run_id, o_custkey % 26 + b.shift AS background_id,
        o_orderpriority <> '3-MEDIUM' AS is_complete, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days(CAST(o_custkey % 400 AS INTEGER)) END AS last_read_at,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'node' || (o_custkey % 4) || ':' || o_custkey END AS deletion_task
    FROM orders JOIN (SELECT 0 AS shift UNION ALL SELECT 1) b ON b.shift = 0 OR o_orderpriority = '5-LOW'
),
source_runs AS (SELECT o_orderkey AS pipeline_run_id FROM orders WHERE o_orderstatus <> 'P')"""
TASKS = """
running AS (
    SELECT 'node' || (c_custkey % 4) || ':' || c_custkey AS deletion_task, 'node' || (c_custkey % 4) AS node, c_custkey AS id
    FROM customer WHERE c_mktsegment = 'BUILDING'
),
completed AS (
    SELECT 'node' || (c_custkey % 4) || ':' || c_custkey AS deletion_task, 'node' || (c_custkey % 4) AS node, c_custkey AS id,
        c_nationkey % 5 <> 0 AND c_nationkey % 9 <> 0 AND c_nationkey % 6 <> 0 AS succeeded,
        c_nationkey % 9 = 0 OR c_nationkey % 6 = 0 AS failed
    FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD')
),
statuses AS (
    SELECT i.pipeline_run_id, i.background_id, i.deletion_task,
        r.deletion_task IS NULL AND c.deletion_task IS NULL AS missing, r.deletion_task IS NOT NULL AS running,
        COALESCE(c.succeeded, FALSE) AS succeeded, COALESCE(c.failed, FALSE) AS failed
    FROM idx i LEFT JOIN running r ON r.deletion_task = i.deletion_task
    LEFT JOIN completed c ON c.deletion_task = i.deletion_task
    WHERE i.deletion_task IS NOT NULL
),
being_deleted AS (SELECT pipeline_run_id FROM statuses WHERE running OR succeeded)"""
EXPIRED = """
expired AS (
    SELECT * FROM idx
    WHERE last_read_at < TIMESTAMP '1998-06-01' OR (last_read_at IS NULL AND created_at < TIMESTAMP '1998-06-01')
)"""
CANDIDATES = """
whole AS (
    SELECT DISTINCT pipeline_run_id FROM idx
    WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM source_runs)
        AND pipeline_run_id NOT IN (SELECT pipeline_run_id FROM being_deleted)
),
candidates AS (
    SELECT 'run' AS kind, CAST(NULL AS BIGINT) AS background_id, pipeline_run_id FROM whole
    UNION ALL
    SELECT 'run_background', background_id, pipeline_run_id FROM expired
    WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM being_deleted)
        AND pipeline_run_id NOT IN (SELECT pipeline_run_id FROM whole)
),
chunks AS (
    SELECT *, (row_number() OVER (PARTITION BY kind, background_id ORDER BY pipeline_run_id) - 1) // 50 AS chunk FROM candidates
),
numbered AS (
    SELECT kind, background_id, pipeline_run_id,
        dense_rank() OVER (ORDER BY kind, background_id NULLS FIRST, chunk) - 1 AS batch_no FROM chunks
),
batches AS (
    SELECT batch_no, kind, background_id, list_sort(list(pipeline_run_id)) AS run_ids FROM numbered GROUP BY ALL
)"""
PLANNED = (INDEX, TASKS, EXPIRED, CANDIDATES)


def now():
    return F.expr(NOW)


def statuses(t: Tables) -> DataFrame:
    running = op.running_tasks(src.running_listing(t))
    completed = op.completed_tasks(src.completed_documents(t))
    return op.task_status(src.index_documents(t), running, completed)


def candidates(t: Tables) -> DataFrame:
    return op.eviction_candidates(
        src.index_documents(t), src.source_runs(t), op.excluded_runs(statuses(t)), now()
    )


@query(
    sql(
        INDEX,
        select="""SELECT DISTINCT pipeline_run_id FROM idx
        WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM source_runs)""",
    )
)
def deleted_runs(t: Tables) -> DataFrame:
    return op.deleted_runs(src.index_documents(t), src.source_runs(t))


@query(sql(INDEX, EXPIRED, select="SELECT pipeline_run_id, background_id, created_at, last_read_at FROM expired"))
def expired_runs(t: Tables) -> DataFrame:
    rows = op.expired_runs(src.index_documents(t), now())
    return rows.select("pipeline_run_id", "background_id", "created_at", "last_read_at")


@query(
    sql(
        INDEX,
        TASKS,
        EXPIRED,
        select="""SELECT background_id, pipeline_run_id FROM expired
        WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM being_deleted)""",
    )
)
def expired_by_background(t: Tables) -> DataFrame:
    return op.expired_by_background(op.expired_runs(src.index_documents(t), now()), op.excluded_runs(statuses(t)))


@query(sql(*PLANNED, select="SELECT * FROM candidates"))
def eviction_candidates(t: Tables) -> DataFrame:
    return candidates(t)


@query(sql(*PLANNED, select="SELECT *, batch_no < 6 AS started FROM batches"))
def eviction_batches(t: Tables) -> DataFrame:
    return op.eviction_batches(candidates(t), op.TASK_CONCURRENCY, RUNS_PER_TASK)


@query(sql(*PLANNED, select="SELECT *, TRUE AS started FROM batches WHERE batch_no < 6"))
def eviction_first_batches(t: Tables) -> DataFrame:
    return op.first_batches(candidates(t), op.TASK_CONCURRENCY, RUNS_PER_TASK)


@query(sql(INDEX, TASKS, select="SELECT * FROM statuses"))
def task_status(t: Tables) -> DataFrame:
    return statuses(t)


@query(
    sql(
        INDEX,
        TASKS,
        select="""SELECT pipeline_run_id, background_id, deletion_task, succeeded OR failed AS drop_task,
            succeeded AS drop_status_document, running OR succeeded AS exclude_from_eviction FROM statuses""",
    )
)
def task_cleanup_plan(t: Tables) -> DataFrame:
    return op.task_cleanup_plan(statuses(t))


@query(sql(INDEX, select="SELECT * FROM idx WHERE deletion_task IS NOT NULL"))
def runs_being_deleted(t: Tables) -> DataFrame:
    return op.runs_being_deleted(src.index_documents(t))


@query(
    sql(
        INDEX,
        TASKS,
        select="""SELECT 'running' AS source, deletion_task, node, id FROM running
        WHERE deletion_task IN (SELECT deletion_task FROM idx)
        UNION ALL SELECT 'completed', deletion_task, node, id FROM completed
        WHERE deletion_task IN (SELECT deletion_task FROM idx)""",
    )
)
def tasks_by_ids(t: Tables) -> DataFrame:
    wanted = op.runs_being_deleted(src.index_documents(t))
    found = [
        op.tasks_by_ids(tasks, wanted).select(F.lit(label).alias("source"), "deletion_task", "node", "id")
        for label, tasks in (
            ("running", op.running_tasks(src.running_listing(t))),
            ("completed", op.completed_tasks(src.completed_documents(t))),
        )
    ]
    return found[0].unionByName(found[1])


@query(
    sql(
        *PLANNED,
        select="""SELECT i.pipeline_run_id, i.background_id,
            CASE WHEN p.batch_no IS NOT NULL OR w.batch_no IS NOT NULL THEN FALSE ELSE i.is_complete END AS is_complete,
            i.created_at, i.last_read_at,
            COALESCE('evict:' || COALESCE(p.batch_no, w.batch_no), i.deletion_task) AS deletion_task
        FROM idx i
        LEFT JOIN numbered w ON w.kind = 'run' AND w.pipeline_run_id = i.pipeline_run_id
        LEFT JOIN numbered p ON p.kind = 'run_background' AND p.pipeline_run_id = i.pipeline_run_id
            AND p.background_id = i.background_id""",
    )
)
def mark_being_deleted(t: Tables) -> DataFrame:
    marked = op.numbered_batches(candidates(t), RUNS_PER_TASK).select(
        "pipeline_run_id", "background_id", F.concat(F.lit("evict:"), F.col("batch_no")).alias("task_id")
    )
    return op.mark_being_deleted(src.index_documents(t), marked)


@query(
    sql(
        INDEX,
        TASKS,
        EXPIRED,
        CANDIDATES,
        select="""SELECT pipeline_run_id, background_id, created_at FROM idx
        WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM whole)""",
    )
)
def delete_by_run(t: Tables) -> DataFrame:
    documents = src.index_documents(t).select("pipeline_run_id", "background_id", "created_at")
    return op.delete_by_run(documents, candidates(t).filter("kind = 'run'"))


@query(
    sql(
        INDEX,
        EXPIRED,
        select="""SELECT i.pipeline_run_id, i.background_id, i.created_at FROM idx i
        WHERE NOT EXISTS (SELECT 1 FROM expired e
            WHERE e.pipeline_run_id = i.pipeline_run_id AND e.background_id = i.background_id)""",
    )
)
def delete_by_run_background(t: Tables) -> DataFrame:
    index = src.index_documents(t)
    documents = index.select("pipeline_run_id", "background_id", "created_at")
    return op.delete_by_run_background(documents, op.expired_runs(index, now()))


@query(
    sql(
        INDEX,
        TASKS,
        select="""SELECT i.* FROM idx i WHERE NOT EXISTS (SELECT 1 FROM statuses s
            WHERE s.succeeded AND s.pipeline_run_id = i.pipeline_run_id AND s.background_id = i.background_id)""",
    )
)
def delete_status_documents(t: Tables) -> DataFrame:
    return op.delete_status_documents(src.index_documents(t), statuses(t).filter("succeeded"))


@query(
    sql(
        INDEX,
        TASKS,
        select="""SELECT * FROM completed WHERE deletion_task NOT IN (
            SELECT deletion_task FROM statuses WHERE succeeded OR failed)""",
    )
)
def delete_tasks(t: Tables) -> DataFrame:
    plan = op.task_cleanup_plan(statuses(t))
    return op.delete_tasks(op.completed_tasks(src.completed_documents(t)), plan.filter("drop_task"))


TASK_COUNTS = """
task_counts AS (
    SELECT count(DISTINCT deletion_task) FILTER (missing) AS missing_tasks,
        count(DISTINCT deletion_task) FILTER (running) AS running_tasks,
        count(DISTINCT deletion_task) FILTER (succeeded) AS succeeded_tasks,
        count(DISTINCT deletion_task) FILTER (failed) AS failed_tasks,
        count(*) FILTER (missing) AS missing_runs, count(*) FILTER (running) AS running_runs,
        count(*) FILTER (succeeded) AS succeeded_runs, count(*) FILTER (failed) AS failed_runs
    FROM statuses
)"""


@query(sql(INDEX, TASKS, TASK_COUNTS, select="SELECT * FROM task_counts"))
def task_counts(t: Tables) -> DataFrame:
    return op.task_counts(statuses(t))


@query(
    sql(
        *PLANNED,
        TASK_COUNTS,
        select="""
        SELECT 'error' AS severity, 'Failed tasks found' AS message, CAST(1 AS BIGINT) AS n FROM task_counts WHERE failed_tasks > 0
        UNION ALL SELECT 'error', 'Missing tasks found', 1 FROM task_counts WHERE missing_tasks > 0
        UNION ALL SELECT 'warning', 'Succeeded task deletion failed', count(*) FROM statuses
            WHERE succeeded AND background_id % 7 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'warning', 'Failed task deletion failed', count(*) FROM statuses
            WHERE failed AND background_id % 7 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'error', 'Eviction start failed', count(*) FROM batches
            WHERE batch_no % 5 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'error', 'Task ID set failed after eviction started', count(*) FROM batches
            WHERE batch_no % 5 <> 0 AND batch_no % 3 = 0 HAVING count(*) > 0""",
    )
)
def eviction_report(t: Tables) -> DataFrame:
    status = statuses(t)
    cleanup = status.filter("succeeded OR failed").selectExpr(
        "IF(succeeded, 'succeeded', 'failed') AS step", "IF(background_id % 7 = 0, 'timeout', NULL) AS error"
    )
    started = op.eviction_batches(candidates(t), op.TASK_CONCURRENCY, RUNS_PER_TASK).selectExpr(
        "batch_no", "IF(batch_no % 5 = 0, 'rejected', NULL) AS start_error", "IF(batch_no % 3 = 0, 'conflict', NULL) AS mark_error"
    )
    return op.eviction_report(status, cleanup, started)


@query(
    sql(
        *PLANNED,
        select="""SELECT i.pipeline_run_id, i.background_id,
            CASE WHEN p.batch_no IS NOT NULL OR w.batch_no IS NOT NULL THEN FALSE ELSE i.is_complete END AS is_complete,
            i.created_at, i.last_read_at,
            COALESCE('evict:' || COALESCE(p.batch_no, w.batch_no), i.deletion_task) AS deletion_task
        FROM idx i
        LEFT JOIN numbered w ON w.kind = 'run' AND w.pipeline_run_id = i.pipeline_run_id
        LEFT JOIN numbered p ON p.kind = 'run_background' AND p.pipeline_run_id = i.pipeline_run_id
            AND p.background_id = i.background_id
        WHERE NOT EXISTS (SELECT 1 FROM statuses s
            WHERE s.succeeded AND s.pipeline_run_id = i.pipeline_run_id AND s.background_id = i.background_id)""",
    )
)
def evict(t: Tables) -> DataFrame:
    """Status documents after one whole cycle with capacity for every batch."""
    result = op.evict(
        src.index_documents(t),
        src.source_runs(t),
        op.running_tasks(src.running_listing(t)),
        op.completed_tasks(src.completed_documents(t)),
        now=now(),
        concurrency=10_000_000,
        runs_per_task=RUNS_PER_TASK,
    )
    return result["index"]


CYCLES, CYCLE_CAPACITY, CYCLE_RUNS, CYCLE_BUCKET = 3, 4, 3, 500


def cycle_sql(c: int) -> str:
    """Status documents, task log and documents after cycle ``c``, from those of the cycle before."""
    return f"""
statuses{c} AS (
    SELECT i.pipeline_run_id, i.background_id, i.deletion_task,
        COALESCE(t.succeeded, FALSE) AS succeeded, COALESCE(t.failed, FALSE) AS failed
    FROM idx{c} i LEFT JOIN log{c} t ON t.deletion_task = i.deletion_task WHERE i.deletion_task IS NOT NULL
),
busy{c} AS (SELECT pipeline_run_id FROM statuses{c} WHERE succeeded),
whole{c} AS (
    SELECT DISTINCT pipeline_run_id FROM idx{c}
    WHERE pipeline_run_id NOT IN (SELECT pipeline_run_id FROM source_runs)
        AND pipeline_run_id NOT IN (SELECT pipeline_run_id FROM busy{c})
),
candidates{c} AS (
    SELECT 'run' AS kind, CAST(NULL AS BIGINT) AS background_id, pipeline_run_id FROM whole{c}
    UNION ALL
    SELECT 'run_background', background_id, pipeline_run_id FROM idx{c}
    WHERE (last_read_at < TIMESTAMP '1998-06-01' OR (last_read_at IS NULL AND created_at < TIMESTAMP '1998-06-01'))
        AND pipeline_run_id NOT IN (SELECT pipeline_run_id FROM busy{c})
        AND pipeline_run_id NOT IN (SELECT pipeline_run_id FROM whole{c})
),
chunks{c} AS (
    SELECT *, (row_number() OVER (PARTITION BY kind, background_id ORDER BY pipeline_run_id) - 1) // 3 AS chunk FROM candidates{c}
),
batches{c} AS (
    SELECT * FROM (SELECT kind, background_id, pipeline_run_id,
        dense_rank() OVER (ORDER BY kind, background_id NULLS FIRST, chunk) - 1 AS batch_no FROM chunks{c})
    WHERE batch_no < 4
),
idx{c + 1} AS (
    SELECT i.pipeline_run_id, i.background_id, i.is_complete AND p.batch_no IS NULL AND w.batch_no IS NULL AS is_complete,
        i.created_at, i.last_read_at,
        COALESCE('evict-{c}:' || COALESCE(p.batch_no, w.batch_no), i.deletion_task) AS deletion_task
    FROM idx{c} i
    LEFT JOIN batches{c} w ON w.kind = 'run' AND w.pipeline_run_id = i.pipeline_run_id
    LEFT JOIN batches{c} p ON p.kind = 'run_background' AND p.pipeline_run_id = i.pipeline_run_id AND p.background_id = i.background_id
    WHERE NOT EXISTS (SELECT 1 FROM statuses{c} s
        WHERE s.succeeded AND s.pipeline_run_id = i.pipeline_run_id AND s.background_id = i.background_id)
),
log{c + 1} AS (
    SELECT * FROM log{c} WHERE deletion_task NOT IN (SELECT deletion_task FROM statuses{c} WHERE succeeded OR failed)
    UNION ALL SELECT DISTINCT 'evict-{c}:' || batch_no, TRUE, FALSE FROM batches{c}
),
docs{c + 1} AS (
    SELECT d.* FROM docs{c} d WHERE NOT EXISTS (SELECT 1 FROM batches{c} b WHERE b.pipeline_run_id = d.pipeline_run_id
        AND (b.kind = 'run' OR b.background_id = d.background_id))
)"""


@query(
    sql(
        INDEX,
        TASKS,
        """
idx0 AS (SELECT * FROM idx),
log0 AS (SELECT deletion_task, succeeded, failed FROM completed),
docs0 AS (SELECT pipeline_run_id, background_id FROM idx)""",
        *(cycle_sql(c) for c in range(CYCLES)),
        select="""SELECT COALESCE(i.pipeline_run_id, d.pipeline_run_id) AS pipeline_run_id,
            COALESCE(i.background_id, d.background_id) AS background_id, i.is_complete, i.deletion_task,
            t.deletion_task IS NOT NULL AS logged, d.pipeline_run_id IS NOT NULL AS has_documents
        FROM idx3 i FULL JOIN docs3 d ON d.pipeline_run_id = i.pipeline_run_id AND d.background_id = i.background_id
        LEFT JOIN log3 t ON t.deletion_task = i.deletion_task""",
    )
)
def evict_cycles(t: Tables) -> DataFrame:
    """Three eviction jobs over the same tables: status index, task log and documents.

    The tasks that the log holds as failed are reported and no obstacle; a step that failed is.
    """
    keys = ["pipeline_run_id", "background_id"]
    index, tasks, documents = (new_shared_path(t.spark, name) for name in ("index", "tasks", "documents"))
    status = src.index_documents(t)
    keyed_tables.upsert_table(t.spark, index, status, keys, bucket_rows=CYCLE_BUCKET)
    keyed_tables.upsert_table(t.spark, tasks, op.completed_tasks(src.completed_documents(t)), jobs.TASK_KEY, jobs.TASK_KEY)
    keyed_tables.upsert_table(t.spark, documents, status.select(*keys), keys, bucket_rows=CYCLE_BUCKET)
    running = op.running_tasks(src.running_listing(t)).filter("false")
    for cycle in range(CYCLES):
        report = jobs.evict_job(
            t.spark, src.source_runs(t), running, documents, index, tasks, now(), str(cycle),
            strict=False, concurrency=CYCLE_CAPACITY, runs_per_task=CYCLE_RUNS,
        )
        op.raise_on_failed_steps(report)
    index, tasks = keyed_tables.read_table(t.spark, index), keyed_tables.read_table(t.spark, tasks)
    left = keyed_tables.read_table(t.spark, documents).select(*keys, F.lit(True).alias("has_documents"))
    logged = tasks.select("deletion_task", F.lit(True).alias("logged"))
    rows = index.select(*keys, "is_complete", "deletion_task").join(left, keys, "full").join(logged, "deletion_task", "left")
    return rows.select(*keys, "is_complete", "deletion_task", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("logged", "has_documents")))
