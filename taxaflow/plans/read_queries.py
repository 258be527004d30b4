"""Registered queries of sequencing reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import reads as op
from taxaflow.plans import read_inputs as src
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import sql
from taxaflow.sources import reads as files
from taxaflow.sources.tables import Tables

MAX_FRAGMENTS = 40

CLUSTERS = """
clusters AS (
    SELECT source AS file, text, min(doc_id) AS pos, count(*) AS cluster_size FROM documents GROUP BY source, text
)"""


@query(
    sql(
        CLUSTERS,
        select="SELECT file, pos, 'R' || pos || ' 00' AS header, text AS sequence, cluster_size FROM clusters",
    )
)
def dedup_reads(t: Tables) -> DataFrame:
    return op.dedup_reads(src.reads(t))


@query(
    sql(
        CLUSTERS,
        select="""SELECT file, pos, 'R' || pos AS representative, cluster_size,
            cluster_size || chr(9) || 'R' || pos AS line FROM clusters""",
    )
)
def duplicate_clusters(t: Tables) -> DataFrame:
    return op.duplicate_clusters(src.reads(t)).drop("sequence_key")


@query(
    sql(
        CLUSTERS,
        select="""SELECT d.source AS file, d.doc_id AS pos, 'R' || d.doc_id AS read_id, 'R' || c.pos AS representative
        FROM documents d JOIN clusters c ON c.file = d.source AND c.text = d.text""",
    )
)
def cluster_members(t: Tables) -> DataFrame:
    return op.cluster_members(src.reads(t))


@query(
    """SELECT lang, count(*) FILTER (length(text) < 50) AS "<50", count(*) FILTER (length(text) BETWEEN 50 AND 499) AS "50-500",
        count(*) FILTER (length(text) BETWEEN 500 AND 9999) AS "500-10000", count(*) FILTER (length(text) >= 10000) AS "10000+"
    FROM documents GROUP BY lang"""
)
def read_length_summary(t: Tables) -> DataFrame:
    return op.read_length_summary(src.reads(t), ["lang"])


@query(
    """SELECT file, lines, lines % 4 = 0 AS valid, CASE WHEN lines % 4 <> 0 THEN 'InvalidFileFormatError' END AS error,
        CASE WHEN lines % 4 <> 0 THEN 'The .fastq file ' || file || ' has an invalid number of lines.' END AS cause
    FROM (SELECT source || '_' || lang AS file, CAST(sum(CASE lang WHEN 'de' THEN 5 WHEN 'es' THEN 3 ELSE 4 END) AS BIGINT) AS lines
        FROM documents GROUP BY 1)"""
)
def fastq_validity(t: Tables) -> DataFrame:
    return op.fastq_validity(src.fastq_lines(t))


@query(
    """SELECT source || '_' || lang AS file, doc_id AS pos,
        CASE WHEN source = 'src3' THEN 'header' WHEN lang = 'es' THEN 'separator' ELSE 'quality length' END AS reason
    FROM documents WHERE source = 'src3' OR lang IN ('es', 'fr')"""
)
def invalid_records(t: Tables) -> DataFrame:
    return op.invalid_records(src.fastq_records(t)).select("file", "pos", "reason")


@query(
    f"""SELECT file, doc_id, pos FROM (SELECT source AS file, doc_id,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < {MAX_FRAGMENTS}"""
)
def cap_fragments(t: Tables) -> DataFrame:
    return op.cap_fragments(src.dense_reads(t), MAX_FRAGMENTS)


FILES = """
files AS (
    SELECT 'sample-' || conv_id AS sample, 'samples/' || conv_id || '/fastqs_' || turn || '_' || role
        || CASE WHEN role = 'assistant' THEN '.fa' WHEN length(text) % 2 = 0 THEN '.fasta.gz' ELSE '.fastq.gz' END AS key
    FROM conversations
)"""


@query(
    sql(
        FILES,
        select="""SELECT sample, count(*) AS files, CASE WHEN bool_and(key LIKE '%.fasta' OR key LIKE '%.fa'
            OR key LIKE '%.fasta.gz' OR key LIKE '%.fa.gz') THEN 'fasta' ELSE 'fastq' END AS format FROM files GROUP BY sample""",
    )
)
def input_format(t: Tables) -> DataFrame:
    return op.input_format(src.sample_files(t))


@query(
    sql(
        FILES,
        select="""SELECT sample, key, 'fastqs_' || (row_number() OVER (PARTITION BY sample ORDER BY key) - 1) AS input_name
        FROM files""",
    )
)
def input_names(t: Tables) -> DataFrame:
    return op.input_names(src.sample_files(t))


@query(
    """SELECT 'R' || doc_id AS read_id, 'R' || doc_id || chr(9) || lang AS header,
        replace(replace(replace(text, chr(13), ''), '>', ''), chr(10), '') AS sequence FROM documents"""
)
def read_fasta(t: Tables) -> DataFrame:
    """Documents written as FASTA files and read back."""
    return files.read_fasta(t.spark, src.write_fasta(t)).select("read_id", "header", "sequence")


@query(
    """SELECT 'R' || doc_id AS read_id, replace(replace(text, chr(10), ''), chr(13), '') AS sequence,
        length(replace(replace(text, chr(10), ''), chr(13), '')) - CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS quality_length
    FROM documents"""
)
def read_fastq(t: Tables) -> DataFrame:
    """Documents written as FASTQ files, quality lines full of ``@``, and read back."""
    records = files.read_fastq(t.spark, src.write_fastq(t))
    return records.select("read_id", "sequence", F.length("quality").cast("bigint").alias("quality_length"))
