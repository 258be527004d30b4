"""Row positions in a total order, without sorting any group in a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.session import settle


def with_positions(
    df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the zero-based position of each row in its ``within`` group by ``order``.

    ``(*within, *order)`` must be unique and should be narrow. Rows are range-partitioned on the
    whole key, so a group holding most of the data is spread over many tasks; the position is the
    row's place inside its partition plus the group's rows in earlier partitions. The partition
    numbers are checkpointed because the counts and the rows must agree on them.
    """
    keys = [*within, *order]
    placed = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    # One row per (group, partition) that meets; the window sees at most one row per partition.
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        placed.groupBy(*within, "_part")
        .agg(F.count("*").alias("_rows"), F.min("_seq").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_g_{c}") for c in within], F.col("_part").alias("_g_part"), "_first", "_before")
    )
    if not within:
        # One row per partition.
        parts = F.broadcast(parts)
    match = F.col("_part") == F.col("_g_part")
    for c in within:
        match = match & placed[c].eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(parts, match).select(
        *df.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias(name)
    )
