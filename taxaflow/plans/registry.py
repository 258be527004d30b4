"""Register of queries: name, function over the tables, and the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxaflow.session import DEFAULT_CONF
from taxaflow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register ``f(tables) -> DataFrame`` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            prepare(spark)
            return build(Tables(spark, directory))

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return build

    return register


def prepare(spark: SparkSession) -> None:
    """The operators' settings where the caller's session has none of its own.

    Alarm and thread times are read as UTC; a session in another zone keeps it and gets its zone's
    rows.
    """
    for key, value in DEFAULT_CONF.items():
        if key not in spark.conf.getAll and spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)
