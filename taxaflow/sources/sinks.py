"""Bulk export, run status, archive and metric sinks; keyed tables are in ``keyed_tables``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.scoring import document_id
from taxaflow.session import shuffles_dropped, staged
from taxaflow.sources.keyed_tables import rewrite, upsert_documents

STATUS_KEYS = ["pipeline_run_id", "background_id"]
DOCUMENT_KEYS = ["tax_id", "tax_level", "pipeline_run_id", "background_id"]
DOCUMENT_FIELDS = [
    "pipeline_run_id", "tax_id", "background_id", "tax_level", "genus_taxid", "family_taxid", "superkingdom_taxid",
    "name", "common_name", "genus_name", "is_phage", "metric_list",
]


# ---- bulk export ----------------------------------------------------------------------------


def bulk_lines(documents: DataFrame, index_name: str = "scored_taxon_counts") -> DataFrame:
    """Action line and document line per document; JSON nulls are kept."""
    doc_id = document_id(F.col("tax_id"), F.col("tax_level"), F.col("pipeline_run_id"), F.col("background_id"))
    return documents.select(
        doc_id.alias("doc_id"),
        F.format_string('{"index": {"_index": "%s", "_id":"%s" }} ', F.lit(index_name), doc_id).alias("action"),
        F.to_json(F.struct(*DOCUMENT_FIELDS), {"ignoreNullFields": "false"}).alias("body"),
    )


def bulk_export(
    documents: DataFrame, path: str, index_name: str = "scored_taxon_counts", batch_size: int = 1000, compression: str = "none"
) -> None:
    """Write bulk files with at most ``batch_size`` documents each; ``gzip`` is what bulk endpoints take besides plain text.

    Its fastest level is used: the files are read once, and their JSON repeats itself in short distances.
    """
    lines = bulk_lines(documents, index_name).select(F.concat_ws("\n", "action", "body").alias("value"))
    options = {"maxRecordsPerFile": str(batch_size), "compression": compression, "zlib.compress.level": "BEST_SPEED"}
    with shuffles_dropped(documents.sparkSession):
        lines.write.options(**options).text(path)


# ---- run status -----------------------------------------------------------------------------


def begun_documents(pairs: DataFrame, now: Column) -> DataFrame:
    """Fresh status documents of runs being indexed."""
    return pairs.select(*STATUS_KEYS).distinct().select(
        *STATUS_KEYS,
        F.lit(False).alias("is_complete"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_read_at"),
        F.lit(None).cast("string").alias("deletion_task"),
    )


def run_status_begin(index: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Status documents after the requested pairs start over.

    A begun document replaces the old one, which loses its last read time and deletion task.
    """
    return upsert_documents(index, begun_documents(requests, now), STATUS_KEYS)


def run_status_complete(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Set ``is_complete`` on the given pairs; nothing else changes."""
    done = pairs.select(*STATUS_KEYS).distinct().withColumn("_done", F.lit(True))
    return index.join(done, STATUS_KEYS, "left").select(
        *[
            (F.col("is_complete") | F.coalesce("_done", F.lit(False))).alias(c) if c == "is_complete" else F.col(c)
            for c in index.columns
        ]
    )


# ---- archive and metrics --------------------------------------------------------------------


def archive_if_absent(
    executions: DataFrame, archived: DataFrame, machine_prefix: str, name_prefix: str
) -> DataFrame:
    """Executions to archive: matching names, not archived yet, with the paths to write.

    ``executions`` has ``execution_arn, input`` where the JSON input names the ``OutputPrefix``.
    """
    arn = F.split("execution_arn", ":", 8)
    prefix = F.regexp_replace(F.get_json_object("input", "$.OutputPrefix"), "/$", "")
    wanted = executions.filter(F.get(arn, 6).startswith(machine_prefix) & F.get(arn, 7).startswith(name_prefix))
    return wanted.join(archived.select("execution_arn"), "execution_arn", "left_anti").select(
        "execution_arn",
        F.concat(prefix, F.lit("/sfn-desc/"), "execution_arn").alias("description_path"),
        F.concat(prefix, F.lit("/sfn-hist/"), "execution_arn").alias("history_path"),
    )


ARCHIVE_KEY = ["execution_arn", "kind"]


def archived_objects(executions: DataFrame, events: DataFrame, machine_prefix: str, name_prefix: str) -> DataFrame:
    """The objects of an archive: description and history of every matching execution, as ``kind, path, body``.

    ``executions`` has ``execution_arn``, the JSON ``input`` that names the output prefix, and any other
    columns of the description; ``events`` has ``execution_arn, event_id`` and the columns of a history
    event, which is listed in order of its id. An execution without events has an empty history.
    """
    nothing = executions.select("execution_arn").limit(0)
    wanted = archive_if_absent(executions, nothing, machine_prefix, name_prefix)
    described = executions.select("execution_arn", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
    event = F.struct("event_id", *(c for c in events.columns if c not in ("execution_arn", "event_id")))
    listed = events.join(wanted.select("execution_arn"), "execution_arn", "left_semi").groupBy("execution_arn")
    histories = listed.agg(F.sort_array(F.collect_list(event)).alias("events"))
    told = wanted.join(histories, "execution_arn", "left").select(
        "execution_arn", F.when(F.col("events").isNull(), '{"events":[]}').otherwise(F.to_json(F.struct("events"))).alias("body")
    )
    paths = wanted.select("execution_arn", F.expr("stack(2, 'description', description_path, 'history', history_path) AS (kind, path)"))
    bodies = described.withColumn("kind", F.lit("description")).unionByName(told.withColumn("kind", F.lit("history")))
    return paths.join(bodies, ARCHIVE_KEY).select(*ARCHIVE_KEY, "path", "body")


def archive(spark: SparkSession, path: str, objects: DataFrame) -> None:
    """Add the objects that a keyed archive does not hold yet; those it holds stay as they are."""
    new = staged(objects)

    def change(old: DataFrame | None) -> DataFrame:
        return new if old is None else old.unionByName(new.join(old.select(*ARCHIVE_KEY), ARCHIVE_KEY, "left_anti").select(*old.columns))

    rewrite(spark, path, new, ["execution_arn"], change, adds=True)


def emit_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows to a table partitioned by namespace."""
    metrics.write.mode("append").partitionBy("namespace").parquet(path)
