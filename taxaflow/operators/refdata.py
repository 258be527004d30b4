"""Dated reference-data versions: selection, completeness, hand-offs, age, retention, promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of reference-data management.
INDEX_ROOT = "ncbi-indexes"
ARTIFACT_SUFFIXES = {
    "lineages": "versioned-taxid-lineages.csv.gz",
    "nt": "nt_compressed.fa",
    "nr": "nr_compressed.fa",
}
WORKFLOW_NAME = "index-generation"
STAGE_FILES = [
    "assemble.wdl",
    "compress-nr.wdl",
    "compress-nt.wdl",
    "download-nr.wdl",
    "download-nt.wdl",
    "download-taxonomy.wdl",
    "index-nr.wdl",
    "index-nt.wdl",
    "index-taxonomy.wdl",
]
HANDOFF_NAMES = [
    "nt",
    "nr",
    "accession2taxid_nucl_gb",
    "accession2taxid_nucl_wgs",
    "accession2taxid_pdb",
    "accession2taxid_prot",
    "taxdump",
]
STAGES = ["Download", "Compress", "Index"]
# Phase of each stage when the databases are built in parallel lanes, and what each lane reads.
LANE_PHASES = {
    "DownloadTaxonomy": 0,
    "DownloadNT": 0,
    "DownloadNR": 0,
    "CompressNT": 1,
    "CompressNR": 1,
    "IndexNT": 2,
    "IndexNR": 2,
    "IndexTaxonomy": 2,
    "Assemble": 3,
}
LANE_INPUTS = {
    "CompressNR": {
        "download_out_nr": "nr",
        "download_out_accession2taxid_pdb": "accession2taxid_pdb",
        "download_out_accession2taxid_prot": "accession2taxid_prot",
    },
    "CompressNT": {
        "download_out_nt": "nt",
        "download_out_accession2taxid_nucl_gb": "accession2taxid_nucl_gb",
        "download_out_accession2taxid_nucl_wgs": "accession2taxid_nucl_wgs",
    },
    "IndexNR": {"compress_out_nr": "nr"},
    "IndexNT": {"compress_out_nt": "nt"},
    "IndexTaxonomy": {"taxdump": "taxdump"},
    "Assemble": {
        "compress_out_nt": "nt",
        "compress_out_nr": "nr",
        "accession2taxid_nucl_gb": "accession2taxid_nucl_gb",
        "accession2taxid_nucl_wgs": "accession2taxid_nucl_wgs",
        "accession2taxid_pdb": "accession2taxid_pdb",
        "accession2taxid_prot": "accession2taxid_prot",
    },
}
# Phase of each short-read stage, and the output each of its inputs is read from; None comes from the run's own inputs.
SHORT_READ_PHASES = {"HostFilter": 0, "NonHostAlignment": 1, "Postprocess": 2, "Experimental": 3}
SHORT_READ_INPUTS: dict[str, dict[str, str | None]] = {
    "HostFilter": {"fastqs_0": None, "fastqs_1": None},
    "NonHostAlignment": {
        "host_filter_out_gsnap_filter_1_fa": "gsnap_filter_out_gsnap_filter_1_fa",
        "host_filter_out_gsnap_filter_2_fa": "gsnap_filter_out_gsnap_filter_2_fa",
        "host_filter_out_gsnap_filter_merged_fa": "gsnap_filter_out_gsnap_filter_merged_fa",
        "duplicate_cluster_sizes_tsv": "czid_dedup_out_duplicate_cluster_sizes_tsv",
        "czid_dedup_out_duplicate_clusters_csv": "czid_dedup_out_duplicate_clusters_csv",
    },
    "Postprocess": {
        "host_filter_out_gsnap_filter_1_fa": "gsnap_filter_out_gsnap_filter_1_fa",
        "host_filter_out_gsnap_filter_2_fa": "gsnap_filter_out_gsnap_filter_2_fa",
        "host_filter_out_gsnap_filter_merged_fa": "gsnap_filter_out_gsnap_filter_merged_fa",
        "gsnap_out_gsnap_m8": "gsnap_out_gsnap_m8",
        "gsnap_out_gsnap_deduped_m8": "gsnap_out_gsnap_deduped_m8",
        "gsnap_out_gsnap_hitsummary_tab": "gsnap_out_gsnap_hitsummary_tab",
        "gsnap_out_gsnap_counts_with_dcr_json": "gsnap_out_gsnap_counts_with_dcr_json",
        "rapsearch2_out_rapsearch2_m8": "rapsearch2_out_rapsearch2_m8",
        "rapsearch2_out_rapsearch2_deduped_m8": "rapsearch2_out_rapsearch2_deduped_m8",
        "rapsearch2_out_rapsearch2_hitsummary_tab": "rapsearch2_out_rapsearch2_hitsummary_tab",
        "rapsearch2_out_rapsearch2_counts_with_dcr_json": "rapsearch2_out_rapsearch2_counts_with_dcr_json",
        "duplicate_cluster_sizes_tsv": "czid_dedup_out_duplicate_cluster_sizes_tsv",
        "czid_dedup_out_duplicate_clusters_csv": "czid_dedup_out_duplicate_clusters_csv",
    },
    "Experimental": {
        "taxid_fasta_in_annotated_merged_fa": "refined_annotated_out_assembly_refined_annotated_merged_fa",
        "taxid_fasta_in_gsnap_hitsummary_tab": "gsnap_out_gsnap_hitsummary_tab",
        "taxid_fasta_in_rapsearch2_hitsummary_tab": "rapsearch2_out_rapsearch2_hitsummary_tab",
        "gsnap_m8_gsnap_deduped_m8": "gsnap_out_gsnap_deduped_m8",
        "refined_gsnap_in_gsnap_reassigned_m8": "refined_gsnap_out_assembly_gsnap_reassigned_m8",
        "refined_gsnap_in_gsnap_hitsummary2_tab": "refined_gsnap_out_assembly_gsnap_hitsummary2_tab",
        "refined_gsnap_in_gsnap_blast_top_m8": "refined_gsnap_out_assembly_gsnap_blast_top_m8",
        "contig_in_contig_coverage_json": "coverage_out_assembly_contig_coverage_json",
        "contig_in_contig_stats_json": "assembly_out_assembly_contig_stats_json",
        "contig_in_contigs_fasta": "assembly_out_assembly_contigs_fasta",
        "fastqs_0": None,
        "fastqs_1": None,
        "nonhost_fasta_refined_taxid_annot_fasta": "refined_taxid_fasta_out_assembly_refined_taxid_annot_fasta",
        "duplicate_clusters_csv": "czid_dedup_out_duplicate_clusters_csv",
    },
}
DATED_VERSION = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MAX_AGE_DAYS = 400
RETAIN_COUNT = 3
PASSING_SCORE = 0.98
RESTRICTED_ENVIRONMENTS = ["dev", "staging"]
RESTRICTED_PATTERNS = [
    r".*bowtie2_ercc_filtered\d+\.fastq$",
    r".*bowtie2_host\.bam$",
    r".*bowtie2_host_filtered\d+\.fastq$",
    r".*bowtie2_human\.bam$",
    r".*bowtie2_human_filtered\d+\.fastq$",
    r".*fastp\d+\.fastq$",
    r".*hisat2_host_filtered\d+\.fastq$",
    r".*sample_quality_filtered\.fastq$",
    r".*sample_validated\.fastq$",
    r".*sample\.hostfiltered\.bam$",
    r".*sample\.hostfiltered\.fastq$",
    r".*sample\.humanfiltered\.bam$",
    r".*valid_input\d+\.fastq$",
    r".*validated_\d+\.fastq\.gz$",
]
# (bucket, current object or an older version of it, key prefix, age in days, action)
LIFECYCLE_RULES = [
    ("references", "current", "ncbi-indexes-", 180, "archive"),
    ("workflows", "noncurrent", "", 30, "archive"),
    ("workflows", "noncurrent", "", 60, "expire"),
    ("benchmark", "noncurrent", "", 30, "archive"),
    ("benchmark", "noncurrent", "", 90, "expire"),
    ("logs", "current", "", 365, "expire"),
    ("logs", "noncurrent", "", 30, "expire"),
]


# ---- selection ------------------------------------------------------------------------------


def latest_artifact(objects: DataFrame, root: str = INDEX_ROOT) -> DataFrame:
    """Greatest key per environment and artifact kind among date-named directories.

    The directory may carry a suffix after its date; any other sibling is never eligible.
    """
    pattern = rf"^{root}-([^/]+)/\d{{4}}-\d{{2}}-\d{{2}}[^/]*/"
    kind = F.coalesce(*[F.when(F.col("key").endswith(suffix), kind) for kind, suffix in ARTIFACT_SUFFIXES.items()])
    return (
        objects.filter(F.col("key").rlike(pattern))
        .select(F.regexp_extract("key", pattern, 1).alias("env"), kind.alias("kind"), "key")
        .filter("kind IS NOT NULL")
        .groupBy("env", "kind")
        .agg(F.max("key").alias("key"))
    )


def latest_by_suffix(objects: DataFrame, prefix: Column, suffix: str) -> DataFrame:
    """Greatest key with the suffix per prefix group."""
    return (
        objects.filter(F.col("key").endswith(suffix))
        .groupBy(prefix.alias("prefix"))
        .agg(F.max("key").alias("key"))
    )


def latest_release(tags: DataFrame) -> DataFrame:
    """Last release per workflow in string order, so 9 comes after 10; ``tags`` has ``workflow, url``."""
    name = F.substring_index("url", "/", -1)
    version = F.substr(name, F.instr(name, "-v") + 2)
    return tags.filter(F.instr(name, "-v") > 0).groupBy("workflow").agg(F.max(version).alias("version"))


# ---- completeness ---------------------------------------------------------------------------


def missing_artifacts(versions: DataFrame, objects: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Files and image each version lacks; a version with any of them missing is rejected."""
    files = F.array(*[F.lit(f) for f in STAGE_FILES])
    expected = versions.select("version").distinct().select(
        "version",
        F.explode(
            F.concat(
                F.transform(files, lambda f: F.concat(F.lit(f"{WORKFLOW_NAME}-"), F.col("version"), F.lit("/"), f)),
                F.array(F.concat(F.lit(f"{WORKFLOW_NAME}:"), F.col("version"))),
            )
        ).alias("artifact"),
    )
    present = objects.select(F.col("key").alias("artifact")).unionByName(
        image_tags.select(F.concat(F.lit(f"{WORKFLOW_NAME}:"), F.col("tag")).alias("artifact"))
    )
    lacking = expected.join(present.distinct().withColumn("_found", F.lit(True)), "artifact", "left")
    return (
        lacking.groupBy("version")
        .agg(F.sort_array(F.collect_list(F.when(F.col("_found").isNull(), F.col("artifact")))).alias("missing"))
        .withColumn("rejected", F.size("missing") > 0)
    )


# ---- stage hand-off -------------------------------------------------------------------------


def handoff_map(stages: Sequence[str] = STAGES, names: Sequence[str] = HANDOFF_NAMES) -> dict[str, dict[str, str]]:
    """Inputs of each stage that come from the stage before it, ``{stage: {input: output}}``."""
    return {
        after: {f"{before.lower()}_out_{name}": name for name in names} for before, after in zip(stages, stages[1:])
    }


def stage_handoff(
    outputs: DataFrame,
    phases: Mapping[str, int] | None = None,
    io_map: Mapping[str, Mapping[str, str | None]] | None = None,
    run_inputs: DataFrame | None = None,
) -> DataFrame:
    """Resolve each stage's inputs from what the run produced before it.

    ``outputs`` has ``run_id, stage, name, value``: the name carries its workflow as a prefix and a
    list value is NULL, which drops the output. ``phases`` numbers the stages; a later phase
    overwrites an output of the same name (in one phase the greatest value counts), and a run that
    reached a phase expects all inputs of the next one. An input without a source comes from ``run_inputs (run_id, name, value)``. A
    NULL ``value`` in the result means the input could not be resolved.
    """
    phases = {stage: i for i, stage in enumerate(STAGES)} if phases is None else phases
    io_map = handoff_map() if io_map is None else io_map
    spark = outputs.sparkSession
    # Both tables are fixed and hold a few rows, so broadcasting them is bounded.
    order = F.broadcast(spark.createDataFrame(list(phases.items()), "stage STRING, _order INT"))
    wanted = F.broadcast(
        spark.createDataFrame(
            [
                (i, stage, phases[stage], name, name if source is None else source, source is None)
                for i, (stage, name, source) in enumerate(
                    (stage, name, source) for stage, inputs in io_map.items() for name, source in inputs.items()
                )
            ],
            "_item INT, stage STRING, _needed INT, input STRING, _source STRING, _from_run BOOLEAN",
        )
    )
    rows = outputs.join(order, "stage").select(
        "run_id", "_order", F.expr("substring(name, instr(name, '.') + 1)").alias("_source"), "value"
    )
    fed = (
        rows.filter("value IS NOT NULL")
        .join(wanted.filter("NOT _from_run"), "_source")
        .filter("_needed > _order")
        .select("run_id", "_item", "_order", "value")
    )
    expected = (
        rows.select("run_id", (F.col("_order") + 1).alias("_needed"))
        .distinct()
        .join(wanted, "_needed")
        .select("run_id", "_item", F.lit(-2).alias("_order"), F.lit(None).cast("string").alias("value"))
    )
    resolved = fed.unionByName(expected)
    if run_inputs is not None:
        given = run_inputs.select("run_id", F.col("name").alias("_source"), "value")
        resolved = resolved.unionByName(
            given.join(wanted.filter("_from_run"), "_source").select(
                "run_id", "_item", F.lit(-1).alias("_order"), "value"
            )
        )
    latest = (
        resolved.groupBy("run_id", "_item")
        .agg(F.max(F.struct("_order", "value")).getField("value").alias("value"), F.min("_order").alias("_expected"))
        .filter("_expected = -2")
        .join(wanted, "_item")
    )
    return latest.select("run_id", "stage", "input", F.when(F.col("value") != "", F.col("value")).alias("value"))


# ---- age, retention, promotion --------------------------------------------------------------


def index_staleness(pointers: DataFrame, today: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Age of each serving version in whole days: OK, STALE, or UNPARSEABLE."""
    day = F.when(F.col("version").rlike(DATED_VERSION), F.try_to_date("version", "yyyy-MM-dd"))
    age = F.datediff(today, day)
    return pointers.withColumn("age_days", age).withColumn(
        "status",
        F.when(F.col("age_days").isNull(), "UNPARSEABLE").when(F.col("age_days") > max_age_days, "STALE").otherwise("OK"),
    )


def dated_versions(objects: DataFrame, root: str = INDEX_ROOT) -> DataFrame:
    """Distinct version directories per environment that are exactly a date."""
    pattern = rf"^{root}-([^/]+)/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/"
    return (
        objects.filter(F.col("key").rlike(pattern))
        .select(F.regexp_extract("key", pattern, 1).alias("env"), F.regexp_extract("key", pattern, 2).alias("version"))
        .distinct()
    )


def retention_plan(versions: DataFrame, pointers: DataFrame, retain: int = RETAIN_COUNT) -> DataFrame:
    """KEEP the newest versions and those the environment points at, PRUNE the others.

    ``versions`` are distinct and dated, so an environment has at most one per calendar day.
    """
    newest = F.row_number().over(Window.partitionBy("env").orderBy(F.col("version").desc()))
    ranked = versions.withColumn("_rank", newest).join(pointers.select("env", "current", "previous"), "env", "left")
    pointed = F.coalesce(F.col("version").isin(F.col("current"), F.col("previous")), F.lit(False))
    return ranked.select(
        "env", "version", F.when((F.col("_rank") <= retain) | pointed, "KEEP").otherwise("PRUNE").alias("action")
    )


def promotion_gate(
    candidates: DataFrame, scores: DataFrame, passing: float = PASSING_SCORE, allow_unverified: bool = False
) -> DataFrame:
    """Whether each candidate may become current; fails closed without a pass for its exact build.

    ``candidates`` has ``env, version, major, current``; ``scores`` has one row per sample with
    ``version, major, nt_score, nr_score``, and every sample must pass on both.
    """
    good = F.coalesce(F.col("nt_score") >= passing, F.lit(False)) & F.coalesce(F.col("nr_score") >= passing, F.lit(False))
    passes = scores.groupBy("version", "major").agg(F.bool_and(good).alias("passed"))
    return candidates.join(passes, ["version", "major"], "left").select(
        "env",
        "version",
        "major",
        F.when(F.col("current") == F.col("version"), "ALREADY_CURRENT")
        .when(F.lit(allow_unverified) | F.coalesce("passed", F.lit(False)), "PROMOTE")
        .otherwise("REFUSE")
        .alias("decision"),
    )


# ---- object clean-up ------------------------------------------------------------------------


def restricted_files(objects: DataFrame) -> DataFrame:
    """Objects of enabled environments whose whole key matches a restricted pattern."""
    pattern = "^(?:" + "|".join(p.removesuffix("$") for p in RESTRICTED_PATTERNS) + r")\z"
    return objects.filter(F.col("env").isin(*RESTRICTED_ENVIRONMENTS) & F.col("key").rlike(pattern))


def lifecycle_actions(objects: DataFrame, today: Column) -> DataFrame:
    """Strongest lifecycle action due for each object version: expire, archive, or none.

    ``objects`` has ``bucket, key, is_current, since``: when it was written, or for an older
    version when it was replaced.
    """
    age = F.datediff(today, F.col("since"))

    def due(action: str) -> Column:
        matches = F.lit(False)
        for bucket, scope, prefix, days, rule_action in LIFECYCLE_RULES:
            if rule_action == action:
                matches = matches | (
                    (F.col("bucket") == bucket)
                    & (F.col("is_current") == (scope == "current"))
                    & F.col("key").startswith(prefix)
                    & (age >= days)
                )
        return matches

    return objects.withColumn("age_days", age).withColumn(
        "action", F.when(due("expire"), "expire").when(due("archive"), "archive").otherwise("none")
    )
