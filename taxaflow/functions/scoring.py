"""Column expressions of taxon scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
GENUS_CARRIER_LIMIT = -100000000
ZSCORE_MIN = -99.0
ZSCORE_MAX = 99.0
ZSCORE_UNDEFINED = 100.0
SHORT_READ_TECHNOLOGY = "Illumina"


def lineage_join_id(tax_id: Column) -> Column:
    """Genus id carried by ids below the limit, every other id unchanged."""
    return F.when(tax_id < GENUS_CARRIER_LIMIT, -(tax_id % F.lit(GENUS_CARRIER_LIMIT))).otherwise(tax_id)


def clamp_strict(value: Column, low: float, high: float) -> Column:
    """Clamp that stays NULL on NULL; ``greatest``/``least`` alone would skip the NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def taxon_zscore(
    *,
    rpm: Column,
    bpm: Column,
    counts: Column,
    technology: Column,
    total_ercc_reads: Column,
    mean: Column,
    stdev: Column,
    mean_mass_normalized: Column,
    stdev_mass_normalized: Column,
) -> Column:
    """Standard score against the background, 100 where it is not defined.

    The mass-normalized model is used as soon as its mean exists, and then needs spike-in reads.
    A run of unknown technology counts as not short-read. Division by zero is undefined.
    """
    short_read = F.coalesce(technology == SHORT_READ_TECHNOLOGY, F.lit(False))
    plain = F.try_divide(F.when(short_read, rpm).otherwise(bpm) - mean, stdev)
    per_spike_in = counts.cast("double") / F.when(short_read, total_ercc_reads.cast("double")).otherwise(F.lit(1.0))
    normalized = F.when(
        total_ercc_reads > 0,
        F.try_divide(per_spike_in - mean_mass_normalized, stdev_mass_normalized),
    )
    raw = F.when(mean_mass_normalized.isNull(), plain).otherwise(normalized)
    return F.coalesce(clamp_strict(raw, ZSCORE_MIN, ZSCORE_MAX), F.lit(ZSCORE_UNDEFINED))


def document_id(tax_id: Column, tax_level: Column, run_id: Column, background_id: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in (tax_id, tax_level, run_id, background_id)])


def run_status_id(run_id: Column, background_id: Column) -> Column:
    return F.concat_ws("_", run_id.cast("string"), background_id.cast("string"))
