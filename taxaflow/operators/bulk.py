"""Bulk re-indexing: expand job specs, stripe them over batches, resume, and account for results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.positions import with_positions

# Fixed defaults of the bulk job.
CONCURRENCY = 50
FAILURE_MESSAGE = "%d / %d pipeline runs failed to index. See logs for more details."


def expand_pairs(records: DataFrame) -> DataFrame:
    """All run/background pairs of each spec record, with their order.

    ``records`` has ``record_no, pipeline_run_ids, background_ids``. The runs of a record are dealt
    out before each is paired, so one large record is not expanded by one task.
    """
    runs = records.select("record_no", "background_ids", F.posexplode("pipeline_run_ids").alias("run_pos", "pipeline_run_id"))
    runs = runs.repartition("record_no", "run_pos")
    return runs.select(
        "record_no", "run_pos", "pipeline_run_id", F.posexplode("background_ids").alias("background_pos", "background_id")
    )


def numbered_pairs(records: DataFrame) -> DataFrame:
    """Expanded pairs with their position in the flattened list of the whole spec."""
    pairs = expand_pairs(records)
    return with_positions(pairs, ["record_no", "run_pos", "background_pos"])


def striped_batches(numbered: DataFrame, batches: int = CONCURRENCY) -> DataFrame:
    """Item ``i`` goes to batch ``i mod n``; ``offset`` is its place there."""
    return numbered.withColumn("batch", (F.col("position") % batches).cast("int")).withColumn(
        "offset", F.expr(f"position div {batches}")
    )


def _skipped(skip: Sequence[int]) -> Column:
    """Items to skip in the row's batch, NULL past the end of the list."""
    return F.get(F.array(*[F.lit(s).cast("bigint") for s in skip]), F.col("batch"))


def resume_skip(striped: DataFrame, skip: Sequence[int] = ()) -> DataFrame:
    """Leave out the first ``skip[b]`` items of batch ``b`` and renumber the rest.

    Batches past the end of a non-empty list are dropped, as pairing both lists up does.
    """
    if not skip:
        return striped
    return striped.filter(F.col("offset") >= _skipped(skip)).withColumn("offset", F.col("offset") - _skipped(skip))


def batch_progress(outcomes: DataFrame) -> DataFrame:
    """Successes before the first failure of each batch; ``outcomes`` has ``batch, offset, failed``."""
    return (
        outcomes.groupBy("batch")
        .agg(F.count("*").alias("total"), F.min(F.when(F.col("failed"), F.col("offset"))).alias("_first_failure"))
        .select(
            "batch",
            "total",
            F.coalesce("_first_failure", "total").alias("success_count"),
            F.col("_first_failure").isNotNull().alias("failed"),
        )
    )


def progress_checkpoints(progress: DataFrame) -> DataFrame:
    """Each percent mark a batch reached, at most one hundred per batch."""
    hundredths = F.sequence(F.lit(1), F.lit(100))
    marks = F.array_distinct(
        F.transform(hundredths, lambda i: F.floor(i.cast("double") * F.lit(0.01) * F.col("total")))
    )
    return (
        progress.withColumn("reached", F.explode(marks))
        .filter((F.col("reached") > 0) & (F.col("reached") <= F.col("success_count")))
        .select(
            "batch", "reached", F.floor(F.col("reached") / F.col("total") * 100).cast("bigint").alias("percent")
        )
    )


def result_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Failed and succeeded invocations; an error or a response with a function error failed."""
    failed = (F.col("kind") == "error") | F.col("function_error").isNotNull()
    return (
        results.groupBy(*by)
        .agg(F.count_if(failed).alias("failed"), F.count_if(~failed).alias("succeeded"))
        .withColumn(
            "message",
            F.when(
                F.col("failed") > 0,
                F.format_string(FAILURE_MESSAGE, F.col("failed"), F.col("failed") + F.col("succeeded")),
            ),
        )
    )
