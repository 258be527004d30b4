"""Scoring inputs projected from the driver's tables.

Aggregates use integer units (cents, whole units), so a value does not depend on the order in
which partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.sources.tables import Tables


def _hits(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_suppkey AS pipeline_run_id",
        "l_partkey AS p",
        "l_partkey",
        "l_linenumber",
        "l_returnflag",
        "CASE l_returnflag WHEN 'A' THEN 'NT' WHEN 'N' THEN 'NR' ELSE 'merged_NT_NR' END AS count_type",
        "CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS tax_level",
        "CAST(l_quantity AS BIGINT) AS quantity",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
        "CAST(round(l_discount * 100) AS BIGINT) AS discount_pct",
        "CAST(round(l_tax * 100) AS BIGINT) AS tax_pct",
        "CASE WHEN l_partkey % 10 = 0 THEN -100000000 - l_partkey ELSE l_partkey END AS tax_id",
    )


def taxon_counts(t: Tables) -> DataFrame:
    """Counts by hits, which are hardly ever alike in all keys, dealt by run and taxon as the look-up of contigs wants them."""
    grouped = _hits(t).repartition("pipeline_run_id", "tax_id").groupBy("pipeline_run_id", "tax_id", "p", "count_type", "tax_level").agg(
        F.expr("CAST(count(*) AS DOUBLE) AS n"),
        F.expr("sum(quantity) AS count"),
        F.expr("CAST(sum(cents) AS DOUBLE) AS cents"),
        F.expr("CAST(sum(discount_pct) AS DOUBLE) AS discount_pct"),
        F.expr("CAST(sum(tax_pct) AS DOUBLE) AS tax_pct"),
        F.expr("CAST(max(quantity) AS DOUBLE) AS alignment_length"),
    )
    return grouped.selectExpr(
        "pipeline_run_id",
        "tax_id",
        "count_type",
        "tax_level",
        "p % 20 AS genus_taxid",
        "p % 5 AS family_taxid",
        "2L AS superkingdom_taxid",
        "IF(p % 7 = 0, 1, 0) AS is_phage",
        "count",
        "100D - discount_pct / n AS percent_identity",
        "alignment_length",
        "-(tax_pct / n) / 100D AS e_value",
        "cents / 100000D AS rpm",
        "2D * (cents / 100000D) AS bpm",
        "concat('taxon ', p) AS name",
    )


def pipeline_runs(t: Tables) -> DataFrame:
    return t.supplier.selectExpr(
        "s_suppkey AS id",
        "CASE s_suppkey % 4 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN NULL ELSE s_suppkey END AS total_ercc_reads",
        "CASE s_nationkey % 3 WHEN 0 THEN 'Illumina' WHEN 1 THEN 'Nanopore' END AS technology",
        "s_suppkey % 27 AS alignment_config_id",
    )


def alignment_configs(t: Tables) -> DataFrame:
    return t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_regionkey + 1 AS lineage_version")


def taxon_lineages(t: Tables) -> DataFrame:
    """One range per part, and a second one covering every version where the brand is Brand#7."""
    ranges = t.part.selectExpr(
        "p_partkey AS taxid",
        "p_name AS genus_name",
        "p_brand AS family_common_name",
        "1 + p_size % 3 AS version_start",
        "2 + p_size % 3 + p_size % 2 AS version_end",
        "p_brand = 'Brand#7' AS widened",
    )
    return ranges.withColumn(
        "r",
        F.explode(
            F.expr(
                """filter(array(
                    struct(version_start, version_end, true AS used),
                    struct(1 AS version_start, 5 AS version_end, widened AS used)
                ), x -> x.used)"""
            )
        ),
    ).select("taxid", "genus_name", "family_common_name", "r.version_start", "r.version_end")


def taxon_summaries(t: Tables) -> DataFrame:
    """Background 1 is every hit, background 2 only flag A, whose hits are those of type NT; taxa with p % 13 = 0 have no model."""
    hits = _hits(t).filter("p % 13 <> 0").withColumn("whole", F.expr("CAST(round(cents / 100D) AS BIGINT)"))
    grouped = hits.groupBy("tax_id", "p", "tax_level", "count_type").agg(
        F.count("*").cast("double").alias("n"),
        F.sum("cents").cast("double").alias("cents"),
        F.sum("whole").cast("double").alias("whole"),
        F.sum(F.expr("CAST(whole * whole AS DECIMAL(20, 0))")).cast("double").alias("whole2"),
        F.sum("quantity").cast("double").alias("quantity"),
        F.sum(F.col("quantity") * F.col("quantity")).cast("double").alias("quantity2"),
    )
    return grouped.selectExpr(
        "explode(IF(count_type = 'NT', array(1L, 2L), array(1L))) AS background_id",
        "tax_id",
        "tax_level",
        "count_type",
        "cents / n / 100000D + IF(p % 17 = 0, 100000D, 0D) AS mean",
        "IF(p % 11 = 0, 0D, sqrt(n * whole2 - whole * whole) / n / 1000D) AS stdev",
        "IF(p % 3 = 0, quantity / n / 100D, NULL) AS mean_mass_normalized",
        "IF(p % 3 = 0, sqrt(n * quantity2 - quantity * quantity) / n / 100D, NULL) AS stdev_mass_normalized",
    )


def contigs(t: Tables) -> DataFrame:
    rows = _hits(t).withColumn("known", F.col("l_linenumber") != 1)
    return rows.selectExpr(
        "pipeline_run_id",
        "IF(known, tax_id, NULL) AS species_taxid_nt",
        "l_partkey - l_partkey % 3 AS species_taxid_nr",
        "tax_id AS species_taxid_merged_nt_nr",
        "IF(known, p % 20, NULL) AS genus_taxid_nt",
        "p % 20 AS genus_taxid_nr",
        "p % 20 AS genus_taxid_merged_nt_nr",
        """CASE l_linenumber WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN '{}' ELSE '{"a":1}' END AS lineage_json""",
    )


def request_events(t: Tables) -> DataFrame:
    """Request events as JSON text: every supplier asks for background 1, some for 2, some badly."""
    return t.supplier.select(
        F.explode(
            F.expr(
                """filter(array(
                    format_string('{"pipeline_run_id":%d,"background_id":1}', s_suppkey),
                    IF(s_nationkey % 2 = 0, format_string(
                        '{"pipeline_run_id":%d,"background_id":2,"es_batchsize":500,"pipeline_runs_index_name":"runs_2"}',
                        s_suppkey), NULL),
                    IF(s_nationkey % 5 = 1, format_string('{"pipeline_run_id":"%d","background_id":1}', s_suppkey), NULL),
                    IF(s_nationkey % 5 = 2, format_string('{"pipeline_run_id":%d}', s_suppkey), NULL),
                    IF(s_nationkey % 5 = 3, format_string('{"pipeline_run_id":%d,"background_id":1,"es_host":7}', s_suppkey), NULL),
                    IF(s_nationkey % 5 = 4, format_string('[%d]', s_suppkey), NULL)
                ), x -> x IS NOT NULL)"""
            )
        ).alias("event")
    )
