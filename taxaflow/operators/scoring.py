"""Scored taxon counts and the nested document per taxon, for any number of runs at once.

Spark broadcasts a side when its measured size allows, and joins by sorted shuffle with skew
splitting otherwise. Each join key differs from the next one, so a hot run or a hot taxon can be split
in every join. Only run configs get a hint, behind a count: Spark takes the size of a join for the product of
its sides, and would move every count for a table of a few bytes a run.

Requested pairs are scored with one move of the counts for all that a taxon has: its lineages and its
models of the requested backgrounds come as one row of short lists. A count is repeated per background after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.rows import evaluated_once
from taxaflow.functions.scoring import document_id, lineage_join_id, taxon_zscore
from taxaflow.session import settle, staged

BROADCAST_RUNS = 500_000  # about 40 bytes each

COUNT_TYPES = ["NT", "NR", "merged_NT_NR"]
COUNT_KEYS = ["pipeline_run_id", "tax_id", "count_type", "tax_level"]
SCORED_COLUMNS = [
    "pipeline_run_id", "tax_id", "count_type", "tax_level", "genus_taxid", "family_taxid",
    "is_phage", "counts", "percent_identity", "alignment_length", "e_value", "rpm",
    "superkingdom_taxid", "name", "genus_name", "common_name", "stdev", "mean",
    "stdev_mass_normalized", "mean_mass_normalized", "background_id", "created_at", "zscore",
]
DOCUMENT_KEYS = ["pipeline_run_id", "background_id", "tax_id"]
DOCUMENT_SCALARS = [
    "tax_level", "genus_taxid", "family_taxid", "superkingdom_taxid", "name", "common_name",
    "genus_name", "is_phage",
]
METRIC_FIELDS = [
    "count_type", "counts", "stdev", "mean", "stdev_mass_normalized", "mean_mass_normalized",
    "percent_identity", "e_value", "rpm", "zscore", "alignment_length", "contigs",
]


def run_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs with their lineage version; a run whose config is unknown disappears."""
    versions = configs.select(F.col("id").alias("alignment_config_id"), "lineage_version")
    return runs.join(versions, "alignment_config_id").select(
        F.col("id").alias("pipeline_run_id"), "total_ercc_reads", "technology", "lineage_version"
    )


def are_few(rows: DataFrame, limit: int = BROADCAST_RUNS) -> bool:
    """Whether the rows are counted to be few enough for a broadcast, and the session does not forbid it."""
    allowed = rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip() != "-1"
    return allowed and rows.limit(limit + 1).count() <= limit


def broadcast_if_few(rows: DataFrame, limit: int = BROADCAST_RUNS) -> DataFrame:
    return F.broadcast(rows) if are_few(rows, limit) else rows


def requested_pairs(requests: DataFrame) -> DataFrame:
    """The different pairs, parsed once."""
    return settle(requests.select("pipeline_run_id", "background_id").distinct())


def requested_runs(runs: DataFrame, configs: DataFrame, requests: DataFrame) -> DataFrame:
    """Every requested run once, with its config and the list of its requested backgrounds."""
    wanted = requests.groupBy("pipeline_run_id").agg(F.collect_set(F.struct("background_id")).alias("_backgrounds"))
    return wanted.join(run_config(runs, configs), "pipeline_run_id", "left")


LINEAGE = ["genus_name", "common_name"]
MODEL = ["stdev", "mean", "stdev_mass_normalized", "mean_mass_normalized"]


def taxon_profiles(lineages: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per taxon that carries a lineage: its ranges, and the models of all ids that join to it.

    The lists hold a taxon's ranges, and a model per background, count type and level. They are written to
    the shared folder, because a join to rows just aggregated on its key cannot be split.
    """
    ranges = lineages.select(
        F.col("taxid").alias("_taxid"),
        F.struct("version_start", "version_end", "genus_name", F.col("family_common_name").alias("common_name")).alias("_range"),
    )
    models = summaries.select(
        lineage_join_id(F.col("tax_id")).alias("_taxid"),
        F.struct("background_id", "tax_id", "tax_level", "count_type", *MODEL).alias("_model"),
    )
    both = ranges.unionByName(models, allowMissingColumns=True).filter("_taxid IS NOT NULL")
    lists = both.groupBy("_taxid").agg(F.collect_list("_range").alias("_ranges"), F.collect_list("_model").alias("_models"))
    return staged(lists, "taxon-profiles")


def versioned_lineage(counts: DataFrame, lineages: DataFrame) -> DataFrame:
    """Lineage valid at the run's lineage version, both ends inclusive.

    ``counts`` needs ``tax_id`` and ``lineage_version``. Equality on the taxon carries the join and
    the version range is a residual condition. Overlapping ranges repeat a row.
    """
    left = counts.withColumn("lineage_taxon_join_id", lineage_join_id(F.col("tax_id")))
    ranges = lineages.select(
        F.col("taxid").alias("_taxid"),
        "genus_name",
        F.col("family_common_name").alias("common_name"),
        F.col("version_start").alias("_version_start"),
        F.col("version_end").alias("_version_end"),
    )
    valid = (
        (F.col("lineage_taxon_join_id") == F.col("_taxid"))
        & (F.col("_version_start") <= F.col("lineage_version"))
        & (F.col("_version_end") >= F.col("lineage_version"))
    )
    return left.join(ranges, valid, "left").drop("_taxid", "_version_start", "_version_end")


def background_summary(counts: DataFrame, summaries: DataFrame, background_id: int | None = None) -> DataFrame:
    """Background model of each count; one background given, or one per row in ``background_id``."""
    keys = ["background_id", "count_type", "tax_level", "tax_id"]
    model = summaries.select(*keys, "mean", "stdev", "mean_mass_normalized", "stdev_mass_normalized")
    if background_id is None:
        return counts.join(model, keys, "left")
    only = model.filter(F.col("background_id") == background_id).drop("background_id")
    return counts.join(only, keys[1:], "left").withColumn("background_id", F.lit(background_id).cast("bigint"))


def zscore_column() -> Column:
    return taxon_zscore(
        **{
            c: F.col(c)
            for c in (
                "rpm", "bpm", "counts", "technology", "total_ercc_reads", "mean", "stdev",
                "mean_mass_normalized", "stdev_mass_normalized",
            )
        }
    )


def scored_taxon_counts(
    counts: DataFrame,
    runs: DataFrame,
    configs: DataFrame,
    lineages: DataFrame,
    summaries: DataFrame,
    *,
    now: Column,
    background_id: int | None = None,
    requests: DataFrame | None = None,
    by_taxon: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Counts with run config, lineage, background model and z-score.

    Give one ``background_id`` for all runs, or ``requests (pipeline_run_id, background_id)`` to
    score exactly the requested pairs in one job. Counts and models are cut to the requested runs
    and backgrounds first, and a count is repeated per background only after the joins that do not
    depend on it. ``by_taxon`` looks up lineages and the models of one background in one move of the
    counts, as it is done for requests. ``ordered`` asks for a global order by taxon.
    """
    if (background_id is None) == (requests is None):
        raise ValueError("give either background_id or requests")
    wanted = counts.withColumnRenamed("count", "counts")
    if requests is not None:
        requests = requested_pairs(requests)
        with_model = requested_models(wanted, runs, configs, lineages, summaries, requests)
    elif by_taxon:
        with_model = models_by_taxon(wanted, runs, configs, lineages, summaries, background_id)
    else:
        with_run = wanted.join(broadcast_if_few(run_config(runs, configs)), "pipeline_run_id", "left")
        with_model = background_summary(versioned_lineage(with_run, lineages), summaries, background_id)
    scored = with_model.withColumn("created_at", now).withColumn("zscore", zscore_column()).select(*SCORED_COLUMNS)
    return scored.orderBy("tax_id") if ordered else scored


def requested_models(
    counts: DataFrame, runs: DataFrame, configs: DataFrame, lineages: DataFrame, summaries: DataFrame, requests: DataFrame
) -> DataFrame:
    """Counts of the requested pairs with run config, lineage and model, as the joins one by one give them.

    Rows stay where the join by ``lineage_taxon_join_id`` put them.
    """
    backgrounds = broadcast_if_few(requests.select("background_id").distinct())
    chosen = summaries.join(backgrounds, "background_id", "left_semi")
    asked = requested_runs(runs, configs, requests)
    joined = with_profiles(counts, asked, taxon_profiles(lineages, chosen), "inner")
    return from_profiles(joined, "inline(_backgrounds)").drop("_backgrounds")


def models_by_taxon(
    counts: DataFrame, runs: DataFrame, configs: DataFrame, lineages: DataFrame, summaries: DataFrame, background_id: int
) -> DataFrame:
    """Counts with run config, lineage and model of one background; runs without a config stay."""
    chosen = summaries.filter(F.col("background_id") == background_id)
    joined = with_profiles(counts, run_config(runs, configs), taxon_profiles(lineages, chosen), "left")
    return from_profiles(joined, f"CAST({background_id} AS BIGINT) AS background_id").drop("lineage_taxon_join_id")


def with_profiles(counts: DataFrame, runs: DataFrame, profiles: DataFrame, how: str) -> DataFrame:
    """Counts with columns of their run and the profile of their taxon; runs that are few come after the move by taxon."""
    late = are_few(runs)
    if not late:
        counts = counts.join(runs, "pipeline_run_id", how)
    elif how == "inner":
        counts = counts.join(F.broadcast(runs.select("pipeline_run_id")), "pipeline_run_id", "left_semi")
    left = counts.withColumn("lineage_taxon_join_id", lineage_join_id(F.col("tax_id")))
    joined = left.join(profiles, F.col("lineage_taxon_join_id") == F.col("_taxid"), "left").drop("_taxid")
    return joined.join(F.broadcast(runs), "pipeline_run_id", how) if late else joined


def from_profiles(joined: DataFrame, backgrounds: str) -> DataFrame:
    """A row per lineage range of the run's version, background and model; ``backgrounds`` gives ``background_id``."""
    valid = "r.version_start <= lineage_version AND r.version_end >= lineage_version"
    same = " AND ".join(f"m.{c} = {c}" for c in ("background_id", "tax_id", "tax_level", "count_type"))
    kept = [c for c in joined.columns if c not in ("_ranges", "_models")]
    ranged = joined.selectExpr(*kept, "_models", f"explode_outer(filter(_ranges, r -> {valid})) AS _r")
    paired = ranged.selectExpr(*kept, "_models", *(f"_r.{c}" for c in LINEAGE), backgrounds)
    found = paired.selectExpr(*kept, *LINEAGE, "background_id", f"explode_outer(filter(_models, m -> {same})) AS _m")
    return found.selectExpr(*kept, *LINEAGE, "background_id", *(f"_m.{c}" for c in MODEL))


def requested_documents(
    counts: DataFrame,
    runs: DataFrame,
    configs: DataFrame,
    lineages: DataFrame,
    summaries: DataFrame,
    contigs: DataFrame,
    requests: DataFrame,
) -> DataFrame:
    """``taxon_documents`` of the requested pairs, with the counts moved for contigs and for taxa only.

    Contigs are looked up before a count is repeated per background. The rows of a document share their
    taxon, so they are grouped where the join by taxon put them.
    """
    requests = requested_pairs(requests)
    wanted = of_requested_runs(counts.withColumnRenamed("count", "counts"), requests)
    with_model = requested_models(with_contigs(wanted, contigs, requests), runs, configs, lineages, summaries, requests)
    scored = with_model.withColumn("zscore", zscore_column())
    return grouped_documents(scored, "lineage_taxon_join_id").drop("lineage_taxon_join_id")


def of_requested_runs(rows: DataFrame, requests: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_few(requests.select("pipeline_run_id").distinct()), "pipeline_run_id", "left_semi")


def document_ids(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """Ids of ``requested_documents``: look-ups neither add nor remove one, so counts and pairs give them."""
    requests = requested_pairs(requests)
    least = F.expr("IF(bool_or(tax_level IS NULL), NULL, min(tax_level)) AS tax_level")
    taxa = of_requested_runs(counts, requests).groupBy("pipeline_run_id", "tax_id").agg(least)
    backgrounds = requests.groupBy("pipeline_run_id").agg(F.collect_set(F.struct("background_id")).alias("_backgrounds"))
    pairs = taxa.join(broadcast_if_few(backgrounds), "pipeline_run_id").selectExpr("*", "inline(_backgrounds)")
    return pairs.select(document_id(*(F.col(c) for c in ("tax_id", "tax_level", "pipeline_run_id", "background_id"))).alias("doc_id"))


def contig_filter(contigs: DataFrame) -> DataFrame:
    """Contigs with a lineage that says something."""
    return contigs.filter(F.col("lineage_json").isNotNull() & ~F.col("lineage_json").isin("", "{}"))


def contig_taxids(contigs: DataFrame) -> DataFrame:
    """Run, count type and taxon of every count a contig gives; species and genus both count, NULL and 0 do not."""
    taxids = contigs.selectExpr(
        "pipeline_run_id",
        """stack(6,
            'NT', species_taxid_nt, 'NR', species_taxid_nr,
            'merged_NT_NR', species_taxid_merged_nt_nr, 'NT', genus_taxid_nt,
            'NR', genus_taxid_nr, 'merged_NT_NR', genus_taxid_merged_nt_nr
        ) AS (count_type, tax_id)""",
    )
    return taxids.filter(F.col("tax_id") != 0)


def contig_counts(contigs: DataFrame) -> DataFrame:
    """Contigs per run, taxon and count type."""
    return contig_taxids(contigs).groupBy("pipeline_run_id", "tax_id", "count_type").agg(F.count("*").alias("contigs"))


def with_contigs(scored: DataFrame, contigs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Contig count of each scored row, looked up by the raw taxon id, 0 where none was found.

    With ``requests`` only the contigs of those runs are counted. A run's taxon has one row of counts, so
    both sides meet by run and taxon, and rows that were dealt by these stay where they are.
    """
    if requests is not None:
        contigs = of_requested_runs(contigs, requests)
    per_taxon = contig_taxids(contig_filter(contigs)).groupBy("pipeline_run_id", "tax_id").agg(
        *(F.count_if(F.col("count_type") == c).alias(f"_contigs_{c}") for c in COUNT_TYPES)
    )
    of_type = F.coalesce(*(F.when(F.col("count_type") == c, F.col(f"_contigs_{c}")) for c in COUNT_TYPES), F.lit(0).cast("bigint"))
    joined = scored.join(per_taxon, ["pipeline_run_id", "tax_id"], "left")
    return joined.select(*scored.columns, of_type.alias("contigs"))


def taxon_documents(scored: DataFrame, contigs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One document per run, background and taxon with its metrics in ``metric_list``.

    A group has at most one row per count type, level and matching lineage range, so the list is
    short whatever the data size. Scalars come from the least (tax_level, count_type) row.
    """
    return grouped_documents(with_contigs(scored, contigs, requests))


def grouped_documents(scored: DataFrame, *places: str) -> DataFrame:
    """Documents of scored rows with contigs; ``places`` are columns of the taxon that rows are already dealt by."""
    rank = f"min(struct(tax_level, count_type, struct({', '.join(DOCUMENT_SCALARS)}) AS scalars)) AS _head"
    entries = f"sort_array(collect_list(struct(tax_level, {', '.join(METRIC_FIELDS)}))) AS _metrics"
    grouped = scored.groupBy(*places, *DOCUMENT_KEYS).agg(F.expr(rank), F.expr(entries))
    doc_id = document_id(F.col("tax_id"), F.col("tax_level"), F.col("pipeline_run_id"), F.col("background_id"))
    metric = ", ".join(f"m.{c} AS {c}" for c in METRIC_FIELDS)
    return grouped.selectExpr(
        *places, *DOCUMENT_KEYS, "_head.scalars.*", f"transform(_metrics, m -> struct({metric})) AS metric_list"
    ).withColumn("doc_id", doc_id)


def taxon_documents_flat(documents: DataFrame) -> DataFrame:
    """Documents with one row per metric, for sinks and checks that want no nesting."""
    kept = [c for c in documents.columns if c != "metric_list"]
    return documents.selectExpr(*kept, "inline(metric_list)")


REQUEST_NUMBERS = {"pipeline_run_id": True, "background_id": True, "es_batchsize": False}
REQUEST_STRINGS = ["scored_taxon_counts_index_name", "pipeline_runs_index_name", "es_host"]
# Fixed defaults of an indexing request.
REQUEST_DEFAULTS = {
    "es_batchsize": 1000,
    "scored_taxon_counts_index_name": "scored_taxon_counts",
    "pipeline_runs_index_name": "pipeline_runs",
}


def request_validation(events: DataFrame, column: str = "event") -> DataFrame:
    """Parse request events (JSON text), flag them by the input contract and fill defaults.

    Required numbers must be JSON numbers, optional fields must have their type when present.
    Invalid rows stay in the result with ``is_valid = false`` so they can be quarantined.
    """
    def kind(field: str) -> str:
        return f"schema_of_variant(try_variant_get(_doc, '$.{field}', 'variant'))"

    checks = ["coalesce(startswith(schema_of_variant(_doc), 'OBJECT'), false)"]
    for field, required in REQUEST_NUMBERS.items():
        number = f"rlike({kind(field)}, '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$')"
        checks.append(f"coalesce({number}, {str(not required).lower()})")
    for field in REQUEST_STRINGS:
        checks.append(f"coalesce({kind(field)} = 'STRING', true)")

    def value(field: str, kind_name: str) -> str:
        found = f"try_variant_get(_doc, '$.{field}', '{kind_name}')"
        default = REQUEST_DEFAULTS.get(field)
        if default is not None:
            literal = f"'{default}'" if kind_name == "string" else f"{default}L"
            found = f"coalesce({found}, {literal})"
        return f"IF(is_valid, {found}, NULL) AS {field}"

    parsed = events.select("*", F.try_parse_json(column).alias("_doc"))
    checked = evaluated_once(parsed, F.expr(" AND ".join(checks)).alias("is_valid"))
    return checked.selectExpr(
        *events.columns,
        "is_valid",
        *[value(field, "bigint") for field in REQUEST_NUMBERS],
        *[value(field, "string") for field in REQUEST_STRINGS],
    )


def index_runs(requests: DataFrame, documents: DataFrame, status: DataFrame) -> DataFrame:
    """Result row per valid request: parameters, documents written, and whether its status is complete."""
    keys = ["pipeline_run_id", "background_id"]
    written = documents.groupBy(*keys).agg(F.count("*").alias("documents"))
    return (
        requests.filter("is_valid")
        .select(*keys, "es_batchsize")
        .join(written, keys, "left")
        .join(status.select(*keys, F.col("is_complete").alias("success")), keys, "left")
        .withColumn("documents", F.coalesce("documents", F.lit(0).cast("bigint")))
        .withColumn("success", F.coalesce("success", F.lit(False)))
    )
