"""Index status documents, source runs and deletion tasks projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxaflow.sources.tables import Tables


def index_documents(t: Tables) -> DataFrame:
    """Every order is a run in one background, low-priority ones in two."""
    return t.orders.selectExpr(
        "o_orderkey AS pipeline_run_id",
        """explode(IF(o_orderpriority = '5-LOW',
            array(o_custkey % 26, o_custkey % 26 + 1), array(o_custkey % 26))) AS background_id""",
        "o_orderpriority <> '3-MEDIUM' AS is_complete",
        "o_orderdate AS created_at",
        """IF(o_orderkey % 3 = 0, NULL,
            o_orderdate + make_dt_interval(CAST(o_custkey % 400 AS INT))) AS last_read_at""",
        """IF(o_orderpriority = '1-URGENT',
            concat('node', o_custkey % 4, ':', o_custkey), NULL) AS deletion_task""",
    )


def source_runs(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus <> 'P'").selectExpr("o_orderkey AS pipeline_run_id")


def running_listing(t: Tables) -> DataFrame:
    """Task listings: one node report per running task, nested as node -> tasks -> task."""
    return t.customer.filter("c_mktsegment = 'BUILDING'").selectExpr(
        """map(concat('node', c_custkey % 4), named_struct('tasks', map(
            concat('node', c_custkey % 4, ':', c_custkey),
            named_struct('node', concat('node', c_custkey % 4), 'id', c_custkey)))) AS nodes"""
    )


def completed_documents(t: Tables) -> DataFrame:
    """Finished tasks; those of the HOUSEHOLD segment are in no listing and so go missing."""
    return t.customer.filter("c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD')").selectExpr(
        "c_nationkey % 5 <> 0 AS completed",
        "IF(c_nationkey % 9 = 0, 'node lost', NULL) AS error",
        "named_struct('node', concat('node', c_custkey % 4), 'id', c_custkey) AS task",
        """named_struct('failures', IF(c_nationkey % 6 = 0,
            array(named_struct('status', 404)), CAST(array() AS ARRAY<STRUCT<status: INT>>))) AS response""",
    )
