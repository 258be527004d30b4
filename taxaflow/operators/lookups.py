"""Joins from many rows to one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    copies: int = 8,
) -> DataFrame:
    """Join ``rows`` to an aggregated ``groups`` table whose keys may be hot in ``rows``.

    A table that was just aggregated on the join key keeps its exchange, and Spark's own skew
    handling cannot split such a join. Each group row is repeated ``copies`` times and each row
    picks one copy by a hash of ``spread_by``: a hot key lands in ``copies`` partitions, and the
    new exchange lets adaptive execution split them further. Meant for groups that are few next to
    the rows; settle the groups first where they are many.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(copies)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")

