"""Explicit schemas of every operator input; nothing is inferred."""

from __future__ import annotations

TAXON_COUNTS = """
    pipeline_run_id BIGINT, tax_id BIGINT, count_type STRING, tax_level INT, genus_taxid BIGINT,
    family_taxid BIGINT, superkingdom_taxid BIGINT, is_phage INT, count BIGINT,
    percent_identity DOUBLE, alignment_length DOUBLE, e_value DOUBLE, rpm DOUBLE, bpm DOUBLE,
    name STRING
"""
PIPELINE_RUNS = "id BIGINT, total_ercc_reads BIGINT, technology STRING, alignment_config_id BIGINT"
ALIGNMENT_CONFIGS = "id BIGINT, lineage_version INT"
TAXON_LINEAGES = """
    taxid BIGINT, genus_name STRING, family_common_name STRING, version_start INT, version_end INT
"""
TAXON_SUMMARIES = """
    background_id BIGINT, tax_id BIGINT, tax_level INT, count_type STRING, mean DOUBLE,
    stdev DOUBLE, mean_mass_normalized DOUBLE, stdev_mass_normalized DOUBLE
"""
CONTIGS = """
    pipeline_run_id BIGINT, species_taxid_nt BIGINT, species_taxid_nr BIGINT,
    species_taxid_merged_nt_nr BIGINT, genus_taxid_nt BIGINT, genus_taxid_nr BIGINT,
    genus_taxid_merged_nt_nr BIGINT, lineage_json STRING
"""
RUN_STATUS = """
    pipeline_run_id BIGINT, background_id BIGINT, is_complete BOOLEAN, created_at TIMESTAMP_NTZ,
    last_read_at TIMESTAMP_NTZ, deletion_task STRING
"""
RUNNING_TASKS = "nodes MAP<STRING, STRUCT<tasks: MAP<STRING, STRUCT<node: STRING, id: BIGINT>>>>"
COMPLETED_TASKS = """
    completed BOOLEAN, error STRING, task STRUCT<node: STRING, id: BIGINT>,
    response STRUCT<failures: ARRAY<STRUCT<status: INT>>>
"""
JOB_SPEC = """
    job_params ARRAY<STRUCT<background_ids: ARRAY<BIGINT>, pipeline_run_ids: ARRAY<BIGINT>>>,
    concurrency INT, skip ARRAY<INT>
"""
LOG_BATCH = """
    logGroup STRING, logStream STRING,
    logEvents ARRAY<STRUCT<id: STRING, timestamp: BIGINT, message: STRING>>
"""
JOBS = """
    queue STRING, job_id STRING, status STRING, created_at_ms BIGINT, vcpus INT, memory_mb BIGINT,
    status_reason STRING
"""
EXECUTIONS = "execution_arn STRING, state_machine STRING, status STRING, stop_date TIMESTAMP_NTZ"
METRIC_POINTS = "metric STRING, dimension STRING, ts TIMESTAMP_NTZ, value DOUBLE"
OBJECTS = "key STRING, size BIGINT, last_modified TIMESTAMP_NTZ"
BENCHMARK_ROWS = """
    version STRING, index_version STRING, sample STRING, timestamp TIMESTAMP_NTZ, wall_seconds INT,
    NT_aupr DOUBLE, NR_aupr DOUBLE
"""
