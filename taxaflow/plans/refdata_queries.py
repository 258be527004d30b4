"""Registered queries of reference-data versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import refdata as op
from taxaflow.plans import refdata_inputs as src
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.sources.tables import Tables

TODAY = "1998-07-01"
OBJECTS = f"""
objects AS (
    SELECT 'ncbi-indexes-' || {src.ENV} || '/' ||
        CASE o_orderpriority WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') || '-rerun'
            WHEN '3-MEDIUM' THEN 'smoketest-' || (o_custkey % 7) ELSE strftime(o_orderdate, '%Y-%m-%d') END
        || '/index-generation-2/' || {src.FILE} AS key,
        CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS last_modified
    FROM orders
)"""
VERSIONS = """
versions AS (SELECT DISTINCT 'v' || p_size || '.' || (length(p_name) % 3) AS version FROM part),
expected AS (
    SELECT version, 'index-generation-' || version || '/' || f AS artifact FROM versions, unnest(['assemble.wdl',
        'compress-nr.wdl', 'compress-nt.wdl', 'download-nr.wdl', 'download-nt.wdl', 'download-taxonomy.wdl',
        'index-nr.wdl', 'index-nt.wdl', 'index-taxonomy.wdl']) u(f)
    UNION ALL SELECT version, 'index-generation:' || version FROM versions
),
present AS (
    SELECT 'index-generation-v' || p_size || '.' || (length(p_name) % 3) || '/' || ['assemble.wdl',
        'compress-nr.wdl', 'compress-nt.wdl', 'download-nr.wdl', 'download-nt.wdl', 'download-taxonomy.wdl',
        'index-nr.wdl', 'index-nt.wdl', 'index-taxonomy.wdl'][p_partkey % 9 + 1] AS artifact FROM part
    UNION SELECT 'index-generation:v' || p_size || '.' || (length(p_name) % 3) FROM part WHERE p_type = 'ECONOMY'
)"""
HANDOFF = """
named AS (
    SELECT l_orderkey AS run_id, CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS ord, l_partkey % 8 AS k, l_linenumber,
        ['nt', 'nr', 'accession2taxid_nucl_gb', 'accession2taxid_nucl_wgs', 'accession2taxid_pdb',
        'accession2taxid_prot', 'taxdump', 'log'][l_partkey % 8 + 1] AS name
    FROM lineitem
),
outputs AS (
    SELECT DISTINCT run_id, ord, name, CASE WHEN k = 5 THEN ''
        ELSE 's3://refs/' || run_id || '/' || ['Download', 'Compress', 'Index'][ord + 1] || '/' || name END AS value
    FROM named WHERE NOT (k = 4 AND ord = 0)
),
expected AS (
    SELECT DISTINCT n.run_id, n.ord + 1 AS ord, u.name FROM named n, unnest(['nt', 'nr', 'accession2taxid_nucl_gb',
        'accession2taxid_nucl_wgs', 'accession2taxid_pdb', 'accession2taxid_prot', 'taxdump']) u(name)
    WHERE n.ord < 2
)"""


@query(
    sql(
        OBJECTS,
        select="""SELECT env, kind, max(key) AS key FROM (
            SELECT regexp_extract(key, '^ncbi-indexes-([^/]+)/', 1) AS env, key,
                CASE WHEN key LIKE '%versioned-taxid-lineages.csv.gz' THEN 'lineages'
                    WHEN key LIKE '%nt\\_compressed.fa' ESCAPE '\\' THEN 'nt' WHEN key LIKE '%nr\\_compressed.fa' ESCAPE '\\' THEN 'nr' END AS kind
            FROM objects WHERE split_part(key, '/', 2) SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}.*')
        WHERE kind IS NOT NULL GROUP BY env, kind""",
    )
)
def latest_artifact(t: Tables) -> DataFrame:
    return op.latest_artifact(src.index_objects(t))


@query(
    sql(
        OBJECTS,
        select="""SELECT split_part(key, '/', 1) AS prefix, max(key) AS key FROM objects
        WHERE key LIKE '%readme.txt' GROUP BY 1""",
    )
)
def latest_by_suffix(t: Tables) -> DataFrame:
    return op.latest_by_suffix(src.index_objects(t), F.substring_index("key", "/", 1), "readme.txt")


@query("SELECT lower(p_type) AS workflow, max(p_size || '.' || p_partkey) AS version FROM part GROUP BY 1")
def latest_release(t: Tables) -> DataFrame:
    return op.latest_release(src.release_tags(t))


@query(
    sql(
        VERSIONS,
        select="""SELECT version, list_sort(list(artifact) FILTER (absent)) AS missing, bool_or(absent) AS rejected FROM (
            SELECT version, artifact, artifact NOT IN (SELECT artifact FROM present) AS absent FROM expected)
        GROUP BY version""",
    ).replace("list_sort(list(artifact) FILTER (absent))", "COALESCE(list_sort(list(artifact) FILTER (absent)), [])")
)
def missing_artifacts(t: Tables) -> DataFrame:
    return op.missing_artifacts(src.pinned_versions(t), src.published_files(t), src.image_tags(t))


@query(
    sql(
        HANDOFF,
        select="""SELECT e.run_id, ['Download', 'Compress', 'Index'][e.ord + 1] AS stage,
            ['', 'download', 'compress'][e.ord + 1] || '_out_' || e.name AS input,
            NULLIF(arg_max(o.value, o.ord), '') AS value
        FROM expected e LEFT JOIN outputs o ON o.run_id = e.run_id AND o.name = e.name AND o.ord < e.ord
        GROUP BY e.run_id, e.ord, e.name""",
    )
)
def stage_handoff(t: Tables) -> DataFrame:
    return op.stage_handoff(src.stage_outputs(t))


SHORT_READ = """
outputs AS (
    SELECT l_orderkey AS run_id, l_linenumber % 4 AS ord,
        ['gsnap_filter_out_gsnap_filter_1_fa', 'gsnap_filter_out_gsnap_filter_merged_fa',
        'czid_dedup_out_duplicate_cluster_sizes_tsv', 'czid_dedup_out_duplicate_clusters_csv', 'gsnap_out_gsnap_m8',
        'gsnap_out_gsnap_deduped_m8', 'rapsearch2_out_rapsearch2_hitsummary_tab',
        'refined_gsnap_out_assembly_gsnap_blast_top_m8', 'assembly_out_assembly_contigs_fasta'][l_suppkey % 9 + 1] AS source,
        CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 's3://samples/' || l_orderkey || '/'
            || ['HostFilter', 'NonHostAlignment', 'Postprocess', 'Experimental'][l_linenumber % 4 + 1] || '/' || l_partkey END AS value
    FROM lineitem
),
wanted(ord, stage, input, source) AS (VALUES
    (1, 'NonHostAlignment', 'host_filter_out_gsnap_filter_1_fa', 'gsnap_filter_out_gsnap_filter_1_fa'),
    (1, 'NonHostAlignment', 'host_filter_out_gsnap_filter_2_fa', 'gsnap_filter_out_gsnap_filter_2_fa'),
    (1, 'NonHostAlignment', 'host_filter_out_gsnap_filter_merged_fa', 'gsnap_filter_out_gsnap_filter_merged_fa'),
    (1, 'NonHostAlignment', 'duplicate_cluster_sizes_tsv', 'czid_dedup_out_duplicate_cluster_sizes_tsv'),
    (1, 'NonHostAlignment', 'czid_dedup_out_duplicate_clusters_csv', 'czid_dedup_out_duplicate_clusters_csv'),
    (2, 'Postprocess', 'host_filter_out_gsnap_filter_1_fa', 'gsnap_filter_out_gsnap_filter_1_fa'),
    (2, 'Postprocess', 'host_filter_out_gsnap_filter_2_fa', 'gsnap_filter_out_gsnap_filter_2_fa'),
    (2, 'Postprocess', 'host_filter_out_gsnap_filter_merged_fa', 'gsnap_filter_out_gsnap_filter_merged_fa'),
    (2, 'Postprocess', 'gsnap_out_gsnap_m8', 'gsnap_out_gsnap_m8'),
    (2, 'Postprocess', 'gsnap_out_gsnap_deduped_m8', 'gsnap_out_gsnap_deduped_m8'),
    (2, 'Postprocess', 'gsnap_out_gsnap_hitsummary_tab', 'gsnap_out_gsnap_hitsummary_tab'),
    (2, 'Postprocess', 'gsnap_out_gsnap_counts_with_dcr_json', 'gsnap_out_gsnap_counts_with_dcr_json'),
    (2, 'Postprocess', 'rapsearch2_out_rapsearch2_m8', 'rapsearch2_out_rapsearch2_m8'),
    (2, 'Postprocess', 'rapsearch2_out_rapsearch2_deduped_m8', 'rapsearch2_out_rapsearch2_deduped_m8'),
    (2, 'Postprocess', 'rapsearch2_out_rapsearch2_hitsummary_tab', 'rapsearch2_out_rapsearch2_hitsummary_tab'),
    (2, 'Postprocess', 'rapsearch2_out_rapsearch2_counts_with_dcr_json', 'rapsearch2_out_rapsearch2_counts_with_dcr_json'),
    (2, 'Postprocess', 'duplicate_cluster_sizes_tsv', 'czid_dedup_out_duplicate_cluster_sizes_tsv'),
    (2, 'Postprocess', 'czid_dedup_out_duplicate_clusters_csv', 'czid_dedup_out_duplicate_clusters_csv'),
    (3, 'Experimental', 'taxid_fasta_in_annotated_merged_fa', 'refined_annotated_out_assembly_refined_annotated_merged_fa'),
    (3, 'Experimental', 'taxid_fasta_in_gsnap_hitsummary_tab', 'gsnap_out_gsnap_hitsummary_tab'),
    (3, 'Experimental', 'taxid_fasta_in_rapsearch2_hitsummary_tab', 'rapsearch2_out_rapsearch2_hitsummary_tab'),
    (3, 'Experimental', 'gsnap_m8_gsnap_deduped_m8', 'gsnap_out_gsnap_deduped_m8'),
    (3, 'Experimental', 'refined_gsnap_in_gsnap_reassigned_m8', 'refined_gsnap_out_assembly_gsnap_reassigned_m8'),
    (3, 'Experimental', 'refined_gsnap_in_gsnap_hitsummary2_tab', 'refined_gsnap_out_assembly_gsnap_hitsummary2_tab'),
    (3, 'Experimental', 'refined_gsnap_in_gsnap_blast_top_m8', 'refined_gsnap_out_assembly_gsnap_blast_top_m8'),
    (3, 'Experimental', 'contig_in_contig_coverage_json', 'coverage_out_assembly_contig_coverage_json'),
    (3, 'Experimental', 'contig_in_contig_stats_json', 'assembly_out_assembly_contig_stats_json'),
    (3, 'Experimental', 'contig_in_contigs_fasta', 'assembly_out_assembly_contigs_fasta'),
    (3, 'Experimental', 'fastqs_0', NULL),
    (3, 'Experimental', 'fastqs_1', NULL),
    (3, 'Experimental', 'nonhost_fasta_refined_taxid_annot_fasta', 'refined_taxid_fasta_out_assembly_refined_taxid_annot_fasta'),
    (3, 'Experimental', 'duplicate_clusters_csv', 'czid_dedup_out_duplicate_clusters_csv')
),
given AS (
    SELECT o_orderkey AS run_id, name, 's3://samples/' || o_orderkey || '/input' AS value
    FROM orders, unnest(['fastqs_0', 'fastqs_1']) AS n(name) WHERE name = 'fastqs_0' OR o_orderpriority <> '5-LOW'
),
best AS (SELECT run_id, source, ord, max(value) AS value FROM outputs GROUP BY run_id, source, ord)"""
LANES = """
outputs AS (
    SELECT l_orderkey AS run_id, [0, 0, 0, 1, 1, 2, 2, 2, 3][(l_linenumber + l_suppkey) % 9 + 1] AS ord,
        ['nt', 'nr', 'accession2taxid_nucl_gb', 'accession2taxid_nucl_wgs', 'accession2taxid_pdb',
        'accession2taxid_prot', 'taxdump'][l_partkey % 7 + 1] AS source,
        's3://refs/' || ['DownloadTaxonomy', 'DownloadNT', 'DownloadNR', 'CompressNT', 'CompressNR', 'IndexNT',
        'IndexNR', 'IndexTaxonomy', 'Assemble'][(l_linenumber + l_suppkey) % 9 + 1] || '/' || source AS value
    FROM lineitem
),
wanted(ord, stage, input, source) AS (VALUES
    (1, 'CompressNR', 'download_out_nr', 'nr'),
    (1, 'CompressNR', 'download_out_accession2taxid_pdb', 'accession2taxid_pdb'),
    (1, 'CompressNR', 'download_out_accession2taxid_prot', 'accession2taxid_prot'),
    (1, 'CompressNT', 'download_out_nt', 'nt'),
    (1, 'CompressNT', 'download_out_accession2taxid_nucl_gb', 'accession2taxid_nucl_gb'),
    (1, 'CompressNT', 'download_out_accession2taxid_nucl_wgs', 'accession2taxid_nucl_wgs'),
    (2, 'IndexNR', 'compress_out_nr', 'nr'),
    (2, 'IndexNT', 'compress_out_nt', 'nt'),
    (2, 'IndexTaxonomy', 'taxdump', 'taxdump'),
    (3, 'Assemble', 'compress_out_nt', 'nt'),
    (3, 'Assemble', 'compress_out_nr', 'nr'),
    (3, 'Assemble', 'accession2taxid_nucl_gb', 'accession2taxid_nucl_gb'),
    (3, 'Assemble', 'accession2taxid_nucl_wgs', 'accession2taxid_nucl_wgs'),
    (3, 'Assemble', 'accession2taxid_pdb', 'accession2taxid_pdb'),
    (3, 'Assemble', 'accession2taxid_prot', 'accession2taxid_prot')
),
best AS (SELECT run_id, source, ord, max(value) AS value FROM outputs GROUP BY run_id, source, ord)"""
RESOLVED = """SELECT r.run_id, w.stage, w.input, NULLIF(arg_max(b.value, b.ord), '') AS value
    FROM (SELECT DISTINCT run_id, ord + 1 AS ord FROM outputs) r JOIN wanted w ON w.ord = r.ord
    LEFT JOIN best b ON b.run_id = r.run_id AND b.source = w.source AND b.ord < w.ord
    WHERE w.source IS NOT NULL GROUP BY r.run_id, w.stage, w.input"""


@query(
    sql(
        SHORT_READ,
        select=f"""{RESOLVED}
        UNION ALL SELECT r.run_id, w.stage, w.input, g.value
        FROM (SELECT DISTINCT run_id, ord + 1 AS ord FROM outputs) r JOIN wanted w ON w.ord = r.ord
        LEFT JOIN given g ON g.run_id = r.run_id AND g.name = w.input WHERE w.source IS NULL""",
    )
)
def stage_handoff_short_read(t: Tables) -> DataFrame:
    return op.stage_handoff(src.short_read_outputs(t), op.SHORT_READ_PHASES, op.SHORT_READ_INPUTS, src.short_read_inputs(t))


@query(sql(LANES, select=RESOLVED))
def stage_handoff_lanes(t: Tables) -> DataFrame:
    return op.stage_handoff(src.lane_outputs(t), op.LANE_PHASES, op.LANE_INPUTS)


@query(
    f"""SELECT env, version, age_days, CASE WHEN age_days IS NULL THEN 'UNPARSEABLE' WHEN age_days > 400 THEN 'STALE'
            ELSE 'OK' END AS status
    FROM (SELECT env, version, CAST(date_diff('day', TRY_CAST(CASE WHEN regexp_full_match(version, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
            THEN version END AS DATE), DATE '{TODAY}') AS INTEGER) AS age_days
        FROM (SELECT 'env-' || o_orderkey AS env, CASE o_orderpriority WHEN '1-URGENT' THEN '-'
            WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') || '-rerun'
            WHEN '3-MEDIUM' THEN replace(strftime(o_orderdate, '%Y-%m-%d'), '-0', '-3')
            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS version FROM orders))"""
)
def index_staleness(t: Tables) -> DataFrame:
    return op.index_staleness(src.serving_pointers(t), F.expr(f"DATE'{TODAY}'"))


@query(
    sql(
        OBJECTS,
        f"""
dated AS (
    SELECT DISTINCT regexp_extract(key, '^ncbi-indexes-([^/]+)/', 1) AS env, split_part(key, '/', 2) AS version
    FROM objects WHERE regexp_full_match(split_part(key, '/', 2), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
),
pointers AS (
    SELECT {src.ENV} AS env, min(strftime(o_orderdate, '%Y-%m-%d')) AS current FROM orders GROUP BY 1
)""",
        select="""SELECT d.env, d.version, CASE WHEN row_number() OVER (PARTITION BY d.env ORDER BY d.version DESC) <= 3
            OR d.version = p.current OR (d.env = 'prod' AND d.version = '1996-02-29') THEN 'KEEP' ELSE 'PRUNE' END AS action
        FROM dated d LEFT JOIN pointers p ON p.env = d.env""",
    )
)
def retention_plan(t: Tables) -> DataFrame:
    return op.retention_plan(op.dated_versions(src.index_objects(t)), src.version_pointers(t))


GATE = f"""
scores AS (
    SELECT strftime(l_shipdate, '%Y-%m') AS version, CAST(2 + l_suppkey % 2 AS INTEGER) AS major,
        1 - l_discount / CASE WHEN month(l_shipdate) % 2 = 0 THEN 6 ELSE 4 END AS nt_score,
        CASE WHEN month(l_shipdate) <> 11 THEN 1 - l_tax / 8 END AS nr_score
    FROM lineitem
),
candidates AS (
    SELECT DISTINCT {src.ENV} AS env, strftime(o_orderdate, '%Y-%m') AS version, CAST(2 + o_custkey % 2 AS INTEGER) AS major
    FROM orders
),
passes AS (
    SELECT version, major, count(*) = count(*) FILTER (nt_score >= 0.98 AND nr_score >= 0.98) AS passed
    FROM scores GROUP BY version, major
)"""


@query(
    sql(
        GATE,
        select="""SELECT c.env, c.version, c.major, CASE WHEN c.env = 'dev' AND c.version = '1997-04' THEN 'ALREADY_CURRENT'
            WHEN p.passed THEN 'PROMOTE' ELSE 'REFUSE' END AS decision
        FROM candidates c LEFT JOIN passes p ON p.version = c.version AND p.major = c.major""",
    )
)
def promotion_gate(t: Tables) -> DataFrame:
    return op.promotion_gate(src.promotion_candidates(t), src.scores(t))


@query(
    f"""SELECT env, key FROM (SELECT {src.ENV} AS env, concat('samples/', o_orderkey, '/', {src.STEP_FILE}) AS key FROM orders)
    WHERE env IN ('dev', 'staging') AND (
        regexp_full_match(key, '.*bowtie2_(ercc|host|human)_filtered\\d+\\.fastq') OR regexp_full_match(key, '.*bowtie2_(host|human)\\.bam')
        OR regexp_full_match(key, '.*fastp\\d+\\.fastq') OR regexp_full_match(key, '.*hisat2_host_filtered\\d+\\.fastq')
        OR regexp_full_match(key, '.*sample_(quality_filtered|validated)\\.fastq')
        OR regexp_full_match(key, '.*sample\\.hostfiltered\\.(bam|fastq)') OR regexp_full_match(key, '.*sample\\.humanfiltered\\.bam')
        OR regexp_full_match(key, '.*valid_input\\d+\\.fastq') OR regexp_full_match(key, '.*validated_\\d+\\.fastq\\.gz'))"""
)
def restricted_files(t: Tables) -> DataFrame:
    return op.restricted_files(src.step_files(t))


@query(
    f"""SELECT *, CASE
        WHEN bucket = 'references' AND is_current AND key LIKE 'ncbi-indexes-%' AND age_days >= 180 THEN 'archive'
        WHEN bucket = 'workflows' AND NOT is_current AND age_days >= 60 THEN 'expire'
        WHEN bucket = 'benchmark' AND NOT is_current AND age_days >= 90 THEN 'expire'
        WHEN bucket IN ('workflows', 'benchmark') AND NOT is_current AND age_days >= 30 THEN 'archive'
        WHEN bucket = 'logs' AND age_days >= CASE WHEN is_current THEN 365 ELSE 30 END THEN 'expire'
        ELSE 'none' END AS action
    FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'workflows' WHEN 2 THEN 'benchmark' ELSE 'logs' END AS bucket,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'host/' ELSE 'ncbi-indexes-dev/' END || o_orderkey AS key,
        o_orderstatus <> 'P' AS is_current, o_orderdate AS since,
        CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') AS INTEGER) AS age_days FROM orders)"""
)
def lifecycle_actions(t: Tables) -> DataFrame:
    return op.lifecycle_actions(src.stored_objects(t), F.expr(f"DATE'{TODAY}'"))
