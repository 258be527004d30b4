"""Imports every module that registers queries."""

from __future__ import annotations

from taxaflow.plans import (  # noqa: F401
    alert_queries,
    bulk_queries,
    eviction_queries,
    io_queries,
    metrics_queries,
    read_queries,
    refdata_queries,
    scoring_queries,
    stream_queries,
)
from taxaflow.plans.registry import ORACLES, QUERIES  # noqa: F401
