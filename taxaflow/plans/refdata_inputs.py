"""Object listings, version pointers, stage outputs and scores projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.sources.tables import Tables

ENV = "CASE o_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END"
FILE = """CASE o_custkey % 4 WHEN 0 THEN 'nt_compressed.fa' WHEN 1 THEN 'nr_compressed.fa'
    WHEN 2 THEN 'versioned-taxid-lineages.csv.gz' ELSE 'readme.txt' END"""
STEP_FILE = """CASE o_custkey % 12
    WHEN 0 THEN concat('bowtie2_ercc_filtered', o_orderkey % 3, '.fastq') WHEN 1 THEN 'bowtie2_host.bam'
    WHEN 2 THEN concat('dedup', o_orderkey % 3, '.fastq') WHEN 3 THEN 'fastp.fastq'
    WHEN 4 THEN concat('fastp', o_orderkey % 3, '.fastq') WHEN 5 THEN 'sample.hostfiltered.bam'
    WHEN 6 THEN 'sample.humanfiltered.fastq' WHEN 7 THEN concat('validated_', o_orderkey % 3, '.fastq.gz')
    WHEN 8 THEN concat('valid_input', o_orderkey % 3, '.fastq.bak') WHEN 9 THEN 'sample_validated.fastq'
    WHEN 10 THEN 'report.json' ELSE concat('hisat2_human_filtered', o_orderkey % 3, '.fastq') END"""
MAJOR = "CAST(2 + o_custkey % 2 AS INT)"


def day(column: str) -> str:
    return f"date_format({column}, 'yyyy-MM-dd')"


def index_objects(t: Tables) -> DataFrame:
    """Artifacts under dated directories, some with a suffix, next to undated ones that sort higher."""
    return t.orders.selectExpr(
        f"""concat('ncbi-indexes-', {ENV}, '/',
            CASE o_orderpriority WHEN '2-HIGH' THEN concat({day("o_orderdate")}, '-rerun')
                WHEN '3-MEDIUM' THEN concat('smoketest-', o_custkey % 7) ELSE {day("o_orderdate")} END,
            '/index-generation-2/', {FILE}) AS key""",
        "CAST(floor(o_totalprice) AS BIGINT) AS size",
        "o_orderdate AS last_modified",
    )


def release_tags(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "lower(p_type) AS workflow",
        "concat('https://api/refs/tags/', lower(p_type), '-v', p_size, '.', p_partkey) AS url",
    )


VERSION = "concat('v', p_size, '.', length(p_name) % 3)"


def pinned_versions(t: Tables) -> DataFrame:
    return t.part.selectExpr(f"{VERSION} AS version").distinct()


def published_files(t: Tables) -> DataFrame:
    """Each part publishes one of the nine files of its version."""
    return t.part.selectExpr(
        f"""concat('index-generation-', {VERSION}, '/', element_at(array('assemble.wdl', 'compress-nr.wdl',
            'compress-nt.wdl', 'download-nr.wdl', 'download-nt.wdl', 'download-taxonomy.wdl', 'index-nr.wdl',
            'index-nt.wdl', 'index-taxonomy.wdl'), CAST(p_partkey % 9 + 1 AS INT))) AS key"""
    )


def image_tags(t: Tables) -> DataFrame:
    return t.part.filter("p_type = 'ECONOMY'").selectExpr(f"{VERSION} AS tag")


def stage_outputs(t: Tables) -> DataFrame:
    """One output per line item; a NULL value stands for a list."""
    stage = "CASE l_linenumber % 3 WHEN 1 THEN 'Download' WHEN 2 THEN 'Compress' ELSE 'Index' END"
    name = """element_at(array('nt', 'nr', 'accession2taxid_nucl_gb', 'accession2taxid_nucl_wgs',
        'accession2taxid_pdb', 'accession2taxid_prot', 'taxdump', 'log'), CAST(l_partkey % 8 + 1 AS INT))"""
    return t.lineitem.selectExpr(
        "l_orderkey AS run_id",
        f"{stage} AS stage",
        f"concat('index_generation.', {name}) AS name",
        f"""CASE WHEN l_partkey % 8 = 4 AND l_linenumber % 3 = 1 THEN NULL WHEN l_partkey % 8 = 5 THEN ''
            ELSE concat('s3://refs/', l_orderkey, '/', {stage}, '/', {name}) END AS value""",
    )


def short_read_outputs(t: Tables) -> DataFrame:
    """One short-read stage output per line item: names by part, an empty value for every ninth part."""
    stage = "element_at(array('HostFilter', 'NonHostAlignment', 'Postprocess', 'Experimental'), l_linenumber % 4 + 1)"
    name = """element_at(array('gsnap_filter_out_gsnap_filter_1_fa', 'gsnap_filter_out_gsnap_filter_merged_fa',
        'czid_dedup_out_duplicate_cluster_sizes_tsv', 'czid_dedup_out_duplicate_clusters_csv', 'gsnap_out_gsnap_m8',
        'gsnap_out_gsnap_deduped_m8', 'rapsearch2_out_rapsearch2_hitsummary_tab',
        'refined_gsnap_out_assembly_gsnap_blast_top_m8', 'assembly_out_assembly_contigs_fasta'), CAST(l_suppkey % 9 + 1 AS INT))"""
    return t.lineitem.selectExpr(
        "l_orderkey AS run_id",
        f"{stage} AS stage",
        f"concat('idseq_dag.', {name}) AS name",
        f"IF(l_partkey % 9 = 0, '', concat('s3://samples/', l_orderkey, '/', {stage}, '/', l_partkey)) AS value",
    )


def short_read_inputs(t: Tables) -> DataFrame:
    """Input files of each run; low-priority runs are unpaired."""
    return t.orders.selectExpr(
        "o_orderkey AS run_id",
        """explode(IF(o_orderpriority = '5-LOW', array('fastqs_0'), array('fastqs_0', 'fastqs_1'))) AS name""",
        "concat('s3://samples/', o_orderkey, '/input') AS value",
    )


def lane_outputs(t: Tables) -> DataFrame:
    """One output of a parallel lane per line item; the same names come back from later lanes."""
    stage = """element_at(array('DownloadTaxonomy', 'DownloadNT', 'DownloadNR', 'CompressNT', 'CompressNR', 'IndexNT',
        'IndexNR', 'IndexTaxonomy', 'Assemble'), CAST((l_linenumber + l_suppkey) % 9 + 1 AS INT))"""
    name = """element_at(array('nt', 'nr', 'accession2taxid_nucl_gb', 'accession2taxid_nucl_wgs', 'accession2taxid_pdb',
        'accession2taxid_prot', 'taxdump'), CAST(l_partkey % 7 + 1 AS INT))"""
    return t.lineitem.selectExpr(
        "l_orderkey AS run_id",
        f"{stage} AS stage",
        f"concat('index_generation.', {name}) AS name",
        f"concat('s3://refs/', {stage}, '/', {name}) AS value",
    )


def serving_pointers(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "concat('env-', o_orderkey) AS env",
        f"""CASE o_orderpriority WHEN '1-URGENT' THEN '-' WHEN '2-HIGH' THEN concat({day("o_orderdate")}, '-rerun')
            WHEN '3-MEDIUM' THEN replace({day("o_orderdate")}, '-0', '-3') ELSE {day("o_orderdate")} END AS version""",
    )


def version_pointers(t: Tables) -> DataFrame:
    """Per environment the oldest order date is serving; no environment but one has a fallback."""
    days = t.orders.select(F.expr(ENV).alias("env"), F.expr(day("o_orderdate")).alias("day"))
    return days.groupBy("env").agg(F.min("day").alias("current")).withColumn(
        "previous", F.when(F.col("env") == "prod", "1996-02-29").otherwise("-")
    )


def scores(t: Tables) -> DataFrame:
    """Sample scores per shipping month; odd months are the worse ones."""
    return t.lineitem.selectExpr(
        "date_format(l_shipdate, 'yyyy-MM') AS version",
        "CAST(2 + l_suppkey % 2 AS INT) AS major",
        "concat('sample-', l_suppkey) AS sample",
        "1 - l_discount / IF(month(l_shipdate) % 2 = 0, 6, 4) AS nt_score",
        "IF(month(l_shipdate) = 11, NULL, 1 - l_tax / 8) AS nr_score",
    )


def promotion_candidates(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        f"{ENV} AS env",
        "date_format(o_orderdate, 'yyyy-MM') AS version",
        f"{MAJOR} AS major",
        f"IF({ENV} = 'dev', '1997-04', '-') AS current",
    ).distinct()


def step_files(t: Tables) -> DataFrame:
    return t.orders.selectExpr(f"{ENV} AS env", f"concat('samples/', o_orderkey, '/', {STEP_FILE}) AS key")


def stored_objects(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "CASE o_custkey % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'workflows' WHEN 2 THEN 'benchmark' ELSE 'logs' END AS bucket",
        "concat(IF(o_orderpriority = '5-LOW', 'host/', 'ncbi-indexes-dev/'), o_orderkey) AS key",
        "o_orderstatus <> 'P' AS is_current",
        "o_orderdate AS since",
    )
