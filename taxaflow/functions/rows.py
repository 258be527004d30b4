"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns so that later filters on them do not evaluate them again.

    A filter on a projected column is pushed below the projection together with a copy of its
    expression, down to the scan if it can. Generated columns stay where they are, which keeps
    costly parsing above the filters that come first.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))
