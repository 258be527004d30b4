"""Registered queries of bulk job planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import bulk as op
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.session import new_shared_path
from taxaflow.sources.files import read_job_spec as read_spec
from taxaflow.sources.tables import Tables

SKIP = [batch % 7 for batch in range(40)]


def spec_records(t: Tables) -> DataFrame:
    """Spec records of at most a hundred neighbouring customers each, with one to three backgrounds."""
    return (
        t.customer.groupBy(F.expr("c_custkey div 100").alias("record_no"))
        .agg(F.sort_array(F.collect_list("c_custkey")).alias("pipeline_run_ids"))
        .withColumn("background_ids", F.expr("sequence(1L, 1 + record_no % 3)"))
    )


PAIRS = f"""
pairs AS (
    SELECT c.c_custkey // 100 AS record_no, CAST(b.background_id - 1 AS INTEGER) AS background_pos,
        c.c_custkey AS pipeline_run_id, CAST(b.background_id AS BIGINT) AS background_id,
        CAST(row_number() OVER (PARTITION BY c.c_custkey // 100, b.background_id ORDER BY c.c_custkey) - 1 AS INTEGER) AS run_pos
    FROM customer c JOIN (VALUES (1), (2), (3)) b(background_id) ON b.background_id <= 1 + c.c_custkey // 100 % 3
),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY record_no, run_pos, background_pos) - 1 AS position FROM pairs
),
striped AS (SELECT *, CAST(position % 50 AS INTEGER) AS batch, position // 50 AS "offset" FROM numbered),
skips AS (SELECT CAST(i AS INTEGER) AS batch, i % 7 AS skip FROM range(40) r(i)),
resumed AS (
    SELECT s.record_no, s.run_pos, s.background_pos, s.pipeline_run_id, s.background_id, s.position, s.batch,
        s."offset" - k.skip AS "offset"
    FROM striped s JOIN skips k ON k.batch = s.batch WHERE s."offset" >= k.skip
),
progress AS (
    SELECT batch, count(*) AS total, COALESCE(min("offset") FILTER (pipeline_run_id % 97 = 13), count(*)) AS success_count,
        count(*) FILTER (pipeline_run_id % 97 = 13) > 0 AS failed
    FROM resumed GROUP BY batch
)"""


def numbered(t: Tables) -> DataFrame:
    return op.numbered_pairs(spec_records(t))


def progress(t: Tables) -> DataFrame:
    resumed = op.resume_skip(op.striped_batches(numbered(t)), SKIP)
    return op.batch_progress(resumed.withColumn("failed", F.expr("pipeline_run_id % 97 = 13")))


@query(sql(PAIRS, select="SELECT * FROM numbered"))
def expand_pairs(t: Tables) -> DataFrame:
    return numbered(t)


@query(sql(PAIRS, select="SELECT * FROM striped"))
def striped_batches(t: Tables) -> DataFrame:
    return op.striped_batches(numbered(t))


@query(sql(PAIRS, select="SELECT * FROM resumed"))
def resume_skip(t: Tables) -> DataFrame:
    return op.resume_skip(op.striped_batches(numbered(t)), SKIP)


@query(sql(PAIRS, select="SELECT * FROM progress"))
def batch_progress(t: Tables) -> DataFrame:
    return progress(t)


@query(
    sql(
        PAIRS,
        select="""SELECT DISTINCT batch, reached, CAST(floor(reached / total * 100) AS BIGINT) AS percent FROM (
            SELECT p.*, CAST(floor(i * 0.01::DOUBLE * total) AS BIGINT) AS reached FROM progress p, range(1, 101) r(i))
        WHERE reached > 0 AND reached <= success_count""",
    )
)
def progress_checkpoints(t: Tables) -> DataFrame:
    return op.progress_checkpoints(progress(t))


@query(
    """SELECT user_id, failed, succeeded, CASE WHEN failed > 0 THEN failed || ' / ' || (failed + succeeded)
            || ' pipeline runs failed to index. See logs for more details.' END AS message
    FROM (SELECT user_id, count(*) FILTER (event_type IN ('error', 'signup')) AS failed,
        count(*) FILTER (event_type NOT IN ('error', 'signup')) AS succeeded FROM events GROUP BY user_id)"""
)
def result_summary(t: Tables) -> DataFrame:
    results = t.events.selectExpr(
        "user_id",
        "IF(event_type = 'error', 'error', 'response') AS kind",
        "IF(event_type = 'signup', 'Unhandled', NULL) AS function_error",
    )
    return op.result_summary(results, ["user_id"])


@query(
    """SELECT c_custkey // 100 AS first_run_block, list_sort(list(c_custkey)) AS pipeline_run_ids,
        generate_series(1, 1 + c_custkey // 100 % 3) AS background_ids, 50 AS concurrency, [0, 2] AS skip
    FROM customer GROUP BY c_custkey // 100"""
)
def read_job_spec(t: Tables) -> DataFrame:
    """Specs written as JSON documents, one per line, and read back by their schema."""
    path = new_shared_path(t.spark, "job-specs")
    spec_records(t).select(
        F.array(F.struct("background_ids", "pipeline_run_ids")).alias("job_params"),
        F.lit(50).alias("concurrency"),
        F.array(F.lit(0), F.lit(2)).alias("skip"),
    ).write.json(path)
    return (
        read_spec(t.spark, path, one_per_file=False)
        .select(F.explode("job_params").alias("r"), "concurrency", "skip")
        .select(
            F.expr("r.pipeline_run_ids[0] div 100").alias("first_run_block"),
            "r.pipeline_run_ids",
            "r.background_ids",
            "concurrency",
            "skip",
        )
    )
