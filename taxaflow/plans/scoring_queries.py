"""Registered queries of taxon scoring, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.scoring import lineage_join_id
from taxaflow.operators import scoring as op
from taxaflow.plans import jobs
from taxaflow.plans import scoring_inputs as src
from taxaflow.plans.registry import query
from taxaflow.session import new_shared_path
from taxaflow.sources.keyed_tables import read_table
from taxaflow.sources.tables import Tables

NOW = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"

HITS = """
hits AS (
    SELECT l_suppkey AS pipeline_run_id, l_partkey AS p, l_partkey, l_linenumber, l_returnflag,
        CASE l_returnflag WHEN 'A' THEN 'NT' WHEN 'N' THEN 'NR' ELSE 'merged_NT_NR' END AS count_type,
        CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS tax_level,
        CASE WHEN l_partkey % 10 = 0 THEN -100000000 - l_partkey ELSE l_partkey END AS tax_id,
        CAST(l_quantity AS BIGINT) AS quantity,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        CAST(round(l_discount * 100) AS BIGINT) AS discount_pct,
        CAST(round(l_tax * 100) AS BIGINT) AS tax_pct
    FROM lineitem
)"""
COUNTS = """
taxon_counts AS (
    SELECT pipeline_run_id, tax_id, count_type, tax_level, p % 20 AS genus_taxid, p % 5 AS family_taxid,
        CAST(2 AS BIGINT) AS superkingdom_taxid, CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS is_phage,
        CAST(sum(quantity) AS BIGINT) AS counts,
        100.0::DOUBLE - CAST(sum(discount_pct) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS percent_identity,
        CAST(max(quantity) AS DOUBLE) AS alignment_length,
        -(CAST(sum(tax_pct) AS DOUBLE) / CAST(count(*) AS DOUBLE)) / 100.0::DOUBLE AS e_value,
        CAST(sum(cents) AS DOUBLE) / 100000.0::DOUBLE AS rpm,
        2.0::DOUBLE * (CAST(sum(cents) AS DOUBLE) / 100000.0::DOUBLE) AS bpm,
        'taxon ' || p AS name
    FROM hits GROUP BY pipeline_run_id, tax_id, p, count_type, tax_level
)"""
RUNS = """
pipeline_runs AS (
    SELECT s_suppkey AS id,
        CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE s_suppkey END AS total_ercc_reads,
        CASE s_nationkey % 3 WHEN 0 THEN 'Illumina' WHEN 1 THEN 'Nanopore' END AS technology,
        s_suppkey % 27 AS alignment_config_id
    FROM supplier
),
run_config AS (
    SELECT r.id AS pipeline_run_id, r.total_ercc_reads, r.technology, n.n_regionkey + 1 AS lineage_version
    FROM pipeline_runs r JOIN nation n ON n.n_nationkey = r.alignment_config_id
)"""
LINEAGES = """
taxon_lineages AS (
    SELECT p_partkey AS taxid, p_name AS genus_name, p_brand AS common_name,
        1 + p_size % 3 AS version_start, 2 + p_size % 3 + p_size % 2 AS version_end
    FROM part
    UNION ALL
    SELECT p_partkey, p_name, p_brand, 1, 5 FROM part WHERE p_brand = 'Brand#7'
)"""
SUMMARIES = """
model AS (
    SELECT b.background_id, tax_id, p, tax_level, count_type, CAST(count(*) AS DOUBLE) AS n,
        CAST(sum(cents) AS DOUBLE) AS cents,
        CAST(sum(CAST(round(cents / 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) AS whole,
        CAST(sum(CAST(round(cents / 100.0::DOUBLE) AS BIGINT) * CAST(round(cents / 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) AS whole2,
        CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(quantity * quantity) AS DOUBLE) AS quantity2
    FROM hits JOIN (SELECT 1 AS background_id UNION ALL SELECT 2) b
        ON b.background_id = 1 OR l_returnflag = 'A'
    WHERE p % 13 <> 0
    GROUP BY b.background_id, tax_id, p, tax_level, count_type
),
taxon_summaries AS (
    SELECT CAST(background_id AS BIGINT) AS background_id, tax_id, tax_level, count_type,
        cents / n / 100000.0::DOUBLE + CASE WHEN p % 17 = 0 THEN 100000.0::DOUBLE ELSE 0.0::DOUBLE END AS mean,
        CASE WHEN p % 11 = 0 THEN 0.0::DOUBLE ELSE sqrt(n * whole2 - whole * whole) / n / 1000.0::DOUBLE END AS stdev,
        CASE WHEN p % 3 = 0 THEN quantity / n / 100.0::DOUBLE END AS mean_mass_normalized,
        CASE WHEN p % 3 = 0 THEN sqrt(n * quantity2 - quantity * quantity) / n / 100.0::DOUBLE END AS stdev_mass_normalized
    FROM model
)"""
CONTIGS = """
contigs AS (
    SELECT pipeline_run_id,
        CASE WHEN l_linenumber <> 1 THEN tax_id END AS species_taxid_nt,
        l_partkey - l_partkey % 3 AS species_taxid_nr,
        tax_id AS species_taxid_merged_nt_nr,
        CASE WHEN l_linenumber <> 1 THEN p % 20 END AS genus_taxid_nt,
        p % 20 AS genus_taxid_nr,
        p % 20 AS genus_taxid_merged_nt_nr,
        CASE l_linenumber WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN '{}' ELSE '{"a":1}' END AS lineage_json
    FROM hits
),
good_contigs AS (SELECT * FROM contigs WHERE lineage_json IS NOT NULL AND lineage_json NOT IN ('', '{}')),
contig_counts AS (
    SELECT pipeline_run_id, tax_id, count_type, count(*) AS contigs FROM (
        SELECT pipeline_run_id, 'NT' AS count_type, species_taxid_nt AS tax_id FROM good_contigs
        UNION ALL SELECT pipeline_run_id, 'NR', species_taxid_nr FROM good_contigs
        UNION ALL SELECT pipeline_run_id, 'merged_NT_NR', species_taxid_merged_nt_nr FROM good_contigs
        UNION ALL SELECT pipeline_run_id, 'NT', genus_taxid_nt FROM good_contigs
        UNION ALL SELECT pipeline_run_id, 'NR', genus_taxid_nr FROM good_contigs
        UNION ALL SELECT pipeline_run_id, 'merged_NT_NR', genus_taxid_merged_nt_nr FROM good_contigs
    ) WHERE tax_id <> 0 GROUP BY ALL
)"""
EVENTS = """
request_events AS (
    SELECT '{"pipeline_run_id":' || s_suppkey || ',"background_id":1}' AS event FROM supplier
    UNION ALL SELECT '{"pipeline_run_id":' || s_suppkey || ',"background_id":2,"es_batchsize":500,"pipeline_runs_index_name":"runs_2"}'
        FROM supplier WHERE s_nationkey % 2 = 0
    UNION ALL SELECT '{"pipeline_run_id":"' || s_suppkey || '","background_id":1}' FROM supplier WHERE s_nationkey % 5 = 1
    UNION ALL SELECT '{"pipeline_run_id":' || s_suppkey || '}' FROM supplier WHERE s_nationkey % 5 = 2
    UNION ALL SELECT '{"pipeline_run_id":' || s_suppkey || ',"background_id":1,"es_host":7}' FROM supplier WHERE s_nationkey % 5 = 3
    UNION ALL SELECT '[' || s_suppkey || ']' FROM supplier WHERE s_nationkey % 5 = 4
),
requests AS (
    SELECT DISTINCT s_suppkey AS pipeline_run_id, b.background_id
    FROM supplier JOIN (SELECT 1 AS background_id UNION ALL SELECT 2) b
        ON b.background_id = 1 OR s_nationkey % 2 = 0
)"""
ZSCORE = """
    COALESCE(CASE WHEN raw IS NOT NULL THEN greatest(-99.0::DOUBLE, least(99.0::DOUBLE, raw)) END, 100.0::DOUBLE)"""
RAW = """
    CASE WHEN s.mean_mass_normalized IS NULL
        THEN (CASE WHEN rc.technology = 'Illumina' THEN c.rpm ELSE c.bpm END - s.mean) / NULLIF(s.stdev, 0)
        WHEN rc.total_ercc_reads > 0
        THEN (CAST(c.counts AS DOUBLE)
            / CASE WHEN rc.technology = 'Illumina' THEN CAST(rc.total_ercc_reads AS DOUBLE) ELSE 1.0::DOUBLE END
            - s.mean_mass_normalized) / NULLIF(s.stdev_mass_normalized, 0)
    END"""
JOIN_ID = "CASE WHEN c.tax_id < -100000000 THEN -1 * (c.tax_id % -100000000) ELSE c.tax_id END"


def scored_cte(pairs: bool) -> str:
    request_join = "JOIN requests q ON q.pipeline_run_id = c.pipeline_run_id" if pairs else ""
    background = "q.background_id" if pairs else "1"
    return f"""
scored AS (
    SELECT pipeline_run_id, tax_id, count_type, tax_level, genus_taxid, family_taxid, is_phage, counts,
        percent_identity, alignment_length, e_value, rpm, superkingdom_taxid, name, genus_name, common_name,
        stdev, mean, stdev_mass_normalized, mean_mass_normalized, background_id,
        TIMESTAMP '2024-02-01 00:00:00' AS created_at, {ZSCORE} AS zscore
    FROM (
        SELECT c.*, l.genus_name, l.common_name, s.stdev, s.mean, s.stdev_mass_normalized, s.mean_mass_normalized,
            CAST({background} AS BIGINT) AS background_id, {RAW} AS raw
        FROM taxon_counts c
        {request_join}
        LEFT JOIN run_config rc ON rc.pipeline_run_id = c.pipeline_run_id
        LEFT JOIN taxon_lineages l ON l.taxid = {JOIN_ID}
            AND l.version_start <= rc.lineage_version AND l.version_end >= rc.lineage_version
        LEFT JOIN taxon_summaries s ON s.background_id = {background} AND s.count_type = c.count_type
            AND s.tax_level = c.tax_level AND s.tax_id = c.tax_id
    )
)"""


DOCS = """
flat AS (
    SELECT s.*, COALESCE(k.contigs, 0) AS contigs,
        first_value(struct_pack(tax_level := s.tax_level, genus_taxid := s.genus_taxid, family_taxid := s.family_taxid,
            superkingdom_taxid := s.superkingdom_taxid, name := s.name, common_name := s.common_name,
            genus_name := s.genus_name, is_phage := s.is_phage)) OVER (
            PARTITION BY s.pipeline_run_id, s.background_id, s.tax_id ORDER BY s.tax_level, s.count_type,
            s.genus_taxid, s.family_taxid, s.superkingdom_taxid, s.name, s.common_name, s.genus_name) AS head
    FROM scored s LEFT JOIN contig_counts k
        ON k.pipeline_run_id = s.pipeline_run_id AND k.tax_id = s.tax_id AND k.count_type = s.count_type
),
documents_flat AS (
    SELECT pipeline_run_id, background_id, tax_id, head.tax_level AS tax_level, head.genus_taxid AS genus_taxid,
        head.family_taxid AS family_taxid, head.superkingdom_taxid AS superkingdom_taxid, head.name AS name,
        head.common_name AS common_name, head.genus_name AS genus_name, head.is_phage AS is_phage,
        tax_id || '_' || head.tax_level || '_' || pipeline_run_id || '_' || background_id AS doc_id,
        count_type, counts, stdev, mean, stdev_mass_normalized, mean_mass_normalized, percent_identity, e_value,
        rpm, zscore, alignment_length, contigs
    FROM flat
)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def scored(t: Tables, background_id: int | None = 1, requests: DataFrame | None = None) -> DataFrame:
    return op.scored_taxon_counts(
        src.taxon_counts(t),
        src.pipeline_runs(t),
        src.alignment_configs(t),
        src.taxon_lineages(t),
        src.taxon_summaries(t),
        now=F.expr(NOW),
        background_id=background_id,
        requests=requests,
        by_taxon=True,
    )


def requests(t: Tables) -> DataFrame:
    return op.request_validation(src.request_events(t))


def documents(t: Tables) -> DataFrame:
    return op.requested_documents(
        src.taxon_counts(t),
        src.pipeline_runs(t),
        src.alignment_configs(t),
        src.taxon_lineages(t),
        src.taxon_summaries(t),
        src.contigs(t),
        requests(t).filter("is_valid"),
    )


SCORED_ALL = (HITS, COUNTS, RUNS, LINEAGES, SUMMARIES)


@query(sql(*SCORED_ALL, scored_cte(False), select="SELECT * FROM scored"))
def scored_taxon_counts(t: Tables) -> DataFrame:
    return scored(t)


@query(sql(*SCORED_ALL, EVENTS, scored_cte(True), select="SELECT * FROM scored"))
def scored_requests(t: Tables) -> DataFrame:
    """The flagship for every requested (run, background) pair."""
    return scored(t, None, requests(t).filter("is_valid"))


@query(
    sql(
        HITS,
        COUNTS,
        select=f"""SELECT c.pipeline_run_id, c.tax_id, c.count_type, c.tax_level,
            {JOIN_ID} AS lineage_taxon_join_id FROM taxon_counts c""",
    )
)
def lineage_join_ids(t: Tables) -> DataFrame:
    counts = src.taxon_counts(t).select(*op.COUNT_KEYS)
    return counts.withColumn("lineage_taxon_join_id", lineage_join_id(F.col("tax_id")))


@query(sql(RUNS, select="SELECT * FROM run_config"))
def run_config(t: Tables) -> DataFrame:
    return op.run_config(src.pipeline_runs(t), src.alignment_configs(t))


@query(
    sql(
        HITS,
        COUNTS,
        RUNS,
        LINEAGES,
        select=f"""SELECT c.pipeline_run_id, c.tax_id, c.count_type, c.tax_level, rc.lineage_version,
            {JOIN_ID} AS lineage_taxon_join_id, l.genus_name, l.common_name
        FROM taxon_counts c LEFT JOIN run_config rc ON rc.pipeline_run_id = c.pipeline_run_id
        LEFT JOIN taxon_lineages l ON l.taxid = {JOIN_ID}
            AND l.version_start <= rc.lineage_version AND l.version_end >= rc.lineage_version""",
    )
)
def versioned_lineage(t: Tables) -> DataFrame:
    counts = src.taxon_counts(t).select(*op.COUNT_KEYS)
    config = op.run_config(src.pipeline_runs(t), src.alignment_configs(t))
    with_version = counts.join(config.select("pipeline_run_id", "lineage_version"), "pipeline_run_id", "left")
    return op.versioned_lineage(with_version, src.taxon_lineages(t))


@query(
    sql(
        HITS,
        COUNTS,
        SUMMARIES,
        select="""SELECT c.pipeline_run_id, c.tax_id, c.count_type, c.tax_level, CAST(2 AS BIGINT) AS background_id,
            s.mean, s.stdev, s.mean_mass_normalized, s.stdev_mass_normalized
        FROM taxon_counts c LEFT JOIN taxon_summaries s ON s.background_id = 2 AND s.count_type = c.count_type
            AND s.tax_level = c.tax_level AND s.tax_id = c.tax_id""",
    )
)
def background_summary(t: Tables) -> DataFrame:
    return op.background_summary(src.taxon_counts(t).select(*op.COUNT_KEYS), src.taxon_summaries(t), 2)


@query(
    sql(
        HITS,
        COUNTS,
        RUNS,
        SUMMARIES,
        select=f"""SELECT pipeline_run_id, tax_id, count_type, tax_level, {ZSCORE} AS zscore FROM (
            SELECT c.pipeline_run_id, c.tax_id, c.count_type, c.tax_level, {RAW} AS raw
            FROM taxon_counts c LEFT JOIN run_config rc ON rc.pipeline_run_id = c.pipeline_run_id
            LEFT JOIN taxon_summaries s ON s.background_id = 2 AND s.count_type = c.count_type
                AND s.tax_level = c.tax_level AND s.tax_id = c.tax_id)""",
    )
)
def taxon_zscore(t: Tables) -> DataFrame:
    counts = src.taxon_counts(t).withColumnRenamed("count", "counts")
    with_run = counts.join(op.run_config(src.pipeline_runs(t), src.alignment_configs(t)), "pipeline_run_id", "left")
    with_model = op.background_summary(with_run, src.taxon_summaries(t), 2)
    return with_model.select(*op.COUNT_KEYS, op.zscore_column().alias("zscore"))


@query(sql(HITS, CONTIGS, select="SELECT * FROM good_contigs"))
def contig_filter(t: Tables) -> DataFrame:
    return op.contig_filter(src.contigs(t))


@query(sql(HITS, CONTIGS, select="SELECT * FROM contig_counts"))
def contig_counts(t: Tables) -> DataFrame:
    return op.contig_counts(op.contig_filter(src.contigs(t)))


@query(
    sql(
        *SCORED_ALL,
        CONTIGS,
        EVENTS,
        scored_cte(True),
        DOCS,
        select="""SELECT pipeline_run_id, background_id, tax_id, head.tax_level AS tax_level, head.genus_taxid AS genus_taxid,
            head.family_taxid AS family_taxid, head.superkingdom_taxid AS superkingdom_taxid, head.name AS name,
            head.common_name AS common_name, head.genus_name AS genus_name, head.is_phage AS is_phage,
            list(struct_pack(count_type := count_type, counts := counts, stdev := stdev, mean := mean,
                stdev_mass_normalized := stdev_mass_normalized, mean_mass_normalized := mean_mass_normalized,
                percent_identity := percent_identity, e_value := e_value, rpm := rpm, zscore := zscore,
                alignment_length := alignment_length, contigs := contigs) ORDER BY tax_level, count_type) AS metric_list,
            tax_id || '_' || head.tax_level || '_' || pipeline_run_id || '_' || background_id AS doc_id
        FROM flat GROUP BY ALL""",
    )
)
def taxon_documents(t: Tables) -> DataFrame:
    return documents(t)


@query(sql(*SCORED_ALL, CONTIGS, EVENTS, scored_cte(True), DOCS, select="SELECT * FROM documents_flat"))
def taxon_documents_flat(t: Tables) -> DataFrame:
    return op.taxon_documents_flat(documents(t))


@query(sql(*SCORED_ALL, CONTIGS, EVENTS, scored_cte(True), DOCS, select="SELECT DISTINCT doc_id FROM documents_flat"))
def document_id(t: Tables) -> DataFrame:
    return op.document_ids(src.taxon_counts(t), requests(t).filter("is_valid"))


@query(
    sql(
        EVENTS,
        select="""SELECT event, is_valid,
            CASE WHEN is_valid THEN CAST(json_extract_string(event, '$.pipeline_run_id') AS BIGINT) END AS pipeline_run_id,
            CASE WHEN is_valid THEN CAST(json_extract_string(event, '$.background_id') AS BIGINT) END AS background_id,
            CASE WHEN is_valid THEN COALESCE(CAST(json_extract_string(event, '$.es_batchsize') AS BIGINT), 1000) END AS es_batchsize,
            CASE WHEN is_valid THEN COALESCE(json_extract_string(event, '$.scored_taxon_counts_index_name'), 'scored_taxon_counts') END
                AS scored_taxon_counts_index_name,
            CASE WHEN is_valid THEN COALESCE(json_extract_string(event, '$.pipeline_runs_index_name'), 'pipeline_runs') END
                AS pipeline_runs_index_name,
            CASE WHEN is_valid THEN json_extract_string(event, '$.es_host') END AS es_host
        FROM (SELECT event, COALESCE(json_type(event) = 'OBJECT'
            AND json_type(event, '$.pipeline_run_id') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
            AND json_type(event, '$.background_id') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
            AND COALESCE(json_type(event, '$.es_batchsize') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), TRUE)
            AND COALESCE(json_type(event, '$.es_host') = 'VARCHAR', TRUE), FALSE) AS is_valid
            FROM request_events)""",
    )
)
def request_validation(t: Tables) -> DataFrame:
    return requests(t)


@query(
    sql(
        *SCORED_ALL,
        EVENTS,
        select="""SELECT q.pipeline_run_id, CAST(q.background_id AS BIGINT) AS background_id,
            CAST(CASE q.background_id WHEN 2 THEN 500 ELSE 1000 END AS BIGINT) AS es_batchsize,
            COALESCE(d.documents, 0) AS documents, TRUE AS success, TRUE AS is_complete,
            TIMESTAMP '2024-02-01 00:00:00' AS created_at, NULL::TIMESTAMP AS last_read_at, NULL::VARCHAR AS deletion_task
        FROM requests q LEFT JOIN (
            SELECT pipeline_run_id, count(DISTINCT tax_id) AS documents FROM taxon_counts GROUP BY 1
        ) d ON d.pipeline_run_id = q.pipeline_run_id""",
    )
)
def index_runs(t: Tables) -> DataFrame:
    """The indexing job over every request, run twice, and what it left in its tables.

    The first run begins from nothing, the second one repeats it; documents are counted in the table.
    """
    tables = jobs.ScoringTables(
        src.taxon_counts(t), src.pipeline_runs(t), src.alignment_configs(t), src.taxon_lineages(t), src.taxon_summaries(t), src.contigs(t)
    )
    documents_path, status_path = new_shared_path(t.spark, "documents"), new_shared_path(t.spark, "status")
    for _ in range(2):
        results = jobs.index_job(t.spark, tables, src.request_events(t), documents_path, status_path, F.expr(NOW))
    status = read_table(t.spark, status_path).select("pipeline_run_id", "background_id", "is_complete", "created_at", "last_read_at", "deletion_task")
    return results.join(status, ["pipeline_run_id", "background_id"])
