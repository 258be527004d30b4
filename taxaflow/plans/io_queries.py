"""Registered queries of scans, listings and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions import text
from taxaflow.plans import eviction_inputs as index
from taxaflow.plans import refdata_inputs as refdata
from taxaflow.plans import scoring_inputs as scoring
from taxaflow.plans.eviction_queries import INDEX
from taxaflow.plans.refdata_queries import OBJECTS
from taxaflow.plans.registry import query
from taxaflow.plans.scoring_queries import (
    CONTIGS,
    DOCS,
    EVENTS,
    SCORED_ALL,
    documents,
    requests,
    scored_cte,
    sql,
)
from taxaflow.session import new_shared_path
from taxaflow.sources import files, keyed_tables, sinks
from taxaflow.sources.tables import Tables, key_bounds, range_predicates, scan_table

NOW = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"
BULK_SPLITS = 8
EXECUTION_ARN = """concat('arn:aws:states:us-west-2:1:execution:', IF(user_id % 2 = 0, 'prod-main-1', 'dev-main-1'),
    IF(user_id % 3 = 0, ':prod-', ':test-'), event_id)"""


@query("SELECT l_suppkey, l_partkey, l_returnflag, l_quantity FROM lineitem WHERE l_quantity >= 25")
def scan_tables(t: Tables) -> DataFrame:
    lineitem = scan_table(t.spark, f"{t.directory}/lineitem.parquet")
    return lineitem.filter("l_quantity >= 25").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem")
def scan_ranges(t: Tables) -> DataFrame:
    """The table by the ranges that a relational scan would be split into, all of them together."""
    predicates = range_predicates("l_suppkey", key_bounds(t.lineitem, "l_suppkey", 8), "l_orderkey", 2)
    parts = [t.lineitem.filter(p).select("l_orderkey", "l_linenumber", "l_suppkey") for p in predicates]
    return functools.reduce(DataFrame.unionByName, parts)


@query(sql(INDEX, select="SELECT background_id, pipeline_run_id FROM idx"))
def scan_index(t: Tables) -> DataFrame:
    """Every status document; a table scan needs no paging."""
    return index.index_documents(t).select("background_id", "pipeline_run_id")


@query(sql(OBJECTS, select="SELECT * FROM objects WHERE key LIKE 'ncbi-indexes-prod/%' AND key LIKE '%.fa'"))
def list_objects(t: Tables) -> DataFrame:
    return files.list_objects(refdata.index_objects(t), "ncbi-indexes-prod/", ".fa")


@query(
    """SELECT 'flag=' || l_returnflag AS prefix, CAST(sum(length(l_orderkey || '-' || l_linenumber) + 1) AS BIGINT) AS bytes
    FROM lineitem GROUP BY l_returnflag"""
)
def list_store(t: Tables) -> DataFrame:
    """Objects written by prefix, then listed by tasks."""
    root = new_shared_path(t.spark, "objects")
    lines = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    lines.write.partitionBy("flag").text(root)
    prefixes = [f"flag={r[0]}" for r in t.lineitem.select("l_returnflag").distinct().collect()]  # three flags
    listed = files.list_store(t.spark, root, prefixes, ".txt")
    return listed.groupBy(F.substring_index("key", "/", 1).alias("prefix")).agg(F.sum("size").alias("bytes"))


SCORES = """SELECT strftime(l_shipdate, '%Y-%m') AS version, l_returnflag AS index_version, 'sample-' || l_suppkey AS sample,
        l_shipdate AS timestamp, CAST(l_quantity AS INTEGER) AS wall_seconds, l_extendedprice AS NT_aupr, l_tax AS NR_aupr
    FROM lineitem"""


def _scores(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "date_format(l_shipdate, 'yyyy-MM') AS version",
        "l_returnflag AS index_version",
        "concat('sample-', l_suppkey) AS sample",
        "l_shipdate AS timestamp",
        "CAST(l_quantity AS INT) AS wall_seconds",
        "l_extendedprice AS NT_aupr",
        "l_tax AS NR_aupr",
    )


@query(SCORES)
def load_benchmarks(t: Tables) -> DataFrame:
    """Scores written as CSV with a header and loaded back."""
    path = new_shared_path(t.spark, "benchmarks")
    _scores(t.lineitem).write.option("header", True).csv(path)
    return files.load_benchmarks(t.spark, path)


@query(SCORES)
def append_benchmarks(t: Tables) -> DataFrame:
    """Two deliveries of scores, the first of them twice, and the table that holds them once."""
    table, deliveries = new_shared_path(t.spark, "scores"), []
    for half in ("l_linenumber % 2 = 0", "l_linenumber % 2 = 1"):
        deliveries.append(new_shared_path(t.spark, "benchmarks"))
        _scores(t.lineitem.filter(half)).write.option("header", True).csv(deliveries[-1])
    for path in (*deliveries, deliveries[0]):
        files.append_benchmarks(t.spark, path, table)
    return keyed_tables.read_table(t.spark, table).drop("loaded_from")


def _old_documents(t: Tables) -> DataFrame:
    """An earlier index state: one document per run and part class, scored 0."""
    return t.lineitem.selectExpr(
        "l_suppkey AS pipeline_run_id", "l_partkey % 400 AS tax_id", "CAST(0 AS BIGINT) AS counts"
    ).distinct()


@query(
    """WITH new AS (
        SELECT l_suppkey AS pipeline_run_id, l_partkey % 200 AS tax_id, CAST(sum(l_quantity) AS BIGINT) AS counts
        FROM lineitem GROUP BY 1, 2),
    old AS (SELECT DISTINCT l_suppkey AS pipeline_run_id, l_partkey % 400 AS tax_id FROM lineitem)
    SELECT * FROM new UNION ALL SELECT pipeline_run_id, tax_id, CAST(0 AS BIGINT) FROM old o WHERE NOT EXISTS (
        SELECT 1 FROM new n WHERE n.pipeline_run_id = o.pipeline_run_id AND n.tax_id = o.tax_id)"""
)
def upsert_documents(t: Tables) -> DataFrame:
    """Two upserts into a keyed table whose buckets split, then its content."""
    keys = ["pipeline_run_id", "tax_id"]
    new = t.lineitem.groupBy(F.col("l_suppkey").alias("pipeline_run_id"), (F.col("l_partkey") % 200).alias("tax_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("counts")
    )
    path = new_shared_path(t.spark, "documents")
    for rows in (_old_documents(t), new):
        keyed_tables.upsert_table(t.spark, path, rows, keys, bucket_rows=2000)
    return keyed_tables.read_table(t.spark, path).select(*keys, "counts")


@query(
    sql(
        *SCORED_ALL,
        CONTIGS,
        EVENTS,
        scored_cte(True),
        DOCS,
        select="""SELECT doc_id, '{"index": {"_index": "scored_taxon_counts", "_id":"' || doc_id || '" }} ' AS action,
            count(*) AS metrics FROM documents_flat GROUP BY doc_id""",
    )
)
def bulk_export(t: Tables) -> DataFrame:
    """Bulk files written compressed and read back as action/document pairs."""
    path = new_shared_path(t.spark, "bulk")
    sinks.bulk_export(documents(t), path, compression="gzip")
    return read_bulk(t.spark, path)


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Id, action line and number of metrics of every document in bulk files; a record is cut and its document parsed once.

    Spark takes a small file for one of some MB and gives a task few of them; ``BULK_SPLITS`` of its tasks are made one
    while every core still has several.
    """
    pairs = spark.read.option("lineSep", '\n{"index"').text(path)
    splits = pairs.rdd.getNumPartitions()
    pairs = pairs.coalesce(max(min(splits, 4 * spark.sparkContext.defaultParallelism), splits // BULK_SPLITS))
    cut = F.split("value", "\n", 3)
    lines = pairs.select(F.get(cut, 0).alias("head"), F.get(cut, 1).alias("body"))
    whole = F.when(F.col("head").startswith('{"index"'), F.col("head")).otherwise(F.concat(F.lit('{"index"'), F.col("head")))
    listed = F.from_json("body", "metric_list ARRAY<STRUCT<count_type: STRING>>")["metric_list"]
    return lines.select(whole.alias("action"), F.array_size(listed).cast("bigint").alias("metrics")).select(
        F.get_json_object("action", "$.index._id").alias("doc_id"), "action", "metrics"
    )


@query(
    sql(
        INDEX,
        EVENTS,
        select="""SELECT pipeline_run_id, CAST(background_id AS BIGINT) AS background_id, FALSE AS is_complete,
            TIMESTAMP '2024-02-01' AS created_at, NULL::TIMESTAMP AS last_read_at, NULL::VARCHAR AS deletion_task FROM requests
        UNION ALL SELECT pipeline_run_id, background_id, is_complete, created_at, last_read_at, deletion_task FROM idx i
        WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.pipeline_run_id = i.pipeline_run_id AND r.background_id = i.background_id)""",
    )
)
def run_status_begin(t: Tables) -> DataFrame:
    return sinks.run_status_begin(index.index_documents(t), requests(t).filter("is_valid"), F.expr(NOW))


@query(
    sql(
        INDEX,
        EVENTS,
        select="""SELECT i.pipeline_run_id, i.background_id, i.is_complete OR r.pipeline_run_id IS NOT NULL AS is_complete,
            i.created_at, i.last_read_at, i.deletion_task FROM idx i
        LEFT JOIN requests r ON r.pipeline_run_id = i.pipeline_run_id AND r.background_id = i.background_id""",
    )
)
def run_status_complete(t: Tables) -> DataFrame:
    return sinks.run_status_complete(index.index_documents(t), requests(t).filter("is_valid"))


@query(
    f"""WITH executions AS (
        SELECT {EXECUTION_ARN.replace("IF(user_id % 2 = 0, 'prod-main-1', 'dev-main-1')",
            "CASE WHEN user_id % 2 = 0 THEN 'prod-main-1' ELSE 'dev-main-1' END").replace(
            "IF(user_id % 3 = 0, ':prod-', ':test-')", "CASE WHEN user_id % 3 = 0 THEN ':prod-' ELSE ':test-' END")} AS execution_arn,
            event_type, user_id FROM events)
    SELECT execution_arn, 's3://out/' || user_id || '/sfn-desc/' || execution_arn AS description_path,
        's3://out/' || user_id || '/sfn-hist/' || execution_arn AS history_path
    FROM executions WHERE user_id % 2 = 0 AND user_id % 3 = 0 AND event_type <> 'click'"""
)
def archive_if_absent(t: Tables) -> DataFrame:
    arn = F.expr(EXECUTION_ARN).alias("execution_arn")
    executions = t.events.select(arn, F.expr("""concat('{"OutputPrefix":"s3://out/', user_id, '/"}')""").alias("input"))
    archived = t.events.filter("event_type = 'click'").select(arn)
    return sinks.archive_if_absent(executions, archived, "prod-main-1", "prod")


@query(
    f"""WITH executions AS (
        SELECT {EXECUTION_ARN.replace("IF(user_id % 2 = 0, 'prod-main-1', 'dev-main-1')",
            "CASE WHEN user_id % 2 = 0 THEN 'prod-main-1' ELSE 'dev-main-1' END").replace(
            "IF(user_id % 3 = 0, ':prod-', ':test-')", "CASE WHEN user_id % 3 = 0 THEN ':prod-' ELSE ':test-' END")} AS execution_arn,
            event_type, user_id FROM events WHERE user_id % 2 = 0 AND user_id % 3 = 0)
    SELECT execution_arn, 'description' AS kind, 's3://out/' || user_id || '/sfn-desc/' || execution_arn AS path,
        CASE WHEN event_type = 'click' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, CAST(NULL AS INTEGER) AS events FROM executions
    UNION ALL
    SELECT execution_arn, 'history', 's3://out/' || user_id || '/sfn-hist/' || execution_arn, NULL, 2 FROM executions"""
)
def archive_executions(t: Tables) -> DataFrame:
    """Some executions archived while they run, then all of them; what the archive holds stays as it is."""
    arn, path = F.expr(EXECUTION_ARN).alias("execution_arn"), new_shared_path(t.spark, "archive")
    steps = F.expr("stack(2, 1, 'ExecutionStarted', 2, event_type) AS (event_id, type)")
    for status, chosen in (("RUNNING", "event_type = 'click'"), ("SUCCEEDED", "true")):
        events = t.events.filter(chosen)
        described = events.select(arn, F.expr("""concat('{"OutputPrefix":"s3://out/', user_id, '/"}')""").alias("input"), F.lit(status).alias("status"))
        history = events.select(arn, "event_type").select("execution_arn", steps)
        sinks.archive(t.spark, path, sinks.archived_objects(described, history, "prod-main-1", "prod"))
    return keyed_tables.read_table(t.spark, path).select(
        "execution_arn",
        "kind",
        "path",
        F.get_json_object("body", "$.status").alias("status"),
        F.json_array_length(F.get_json_object("body", "$.events")).alias("events"),
    )


@query(
    """WITH named AS (SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2, strpos(p_name, ' ') - 2)
            || upper(substr(p_name, strpos(p_name, ' ') + 1, 1)) || substr(p_name, strpos(p_name, ' ') + 2) AS stage,
            CASE WHEN p_size % 2 = 0 THEN 's3://refs/' ELSE 'https://refs/' END || p_brand || '/' || p_name AS uri,
            lower(p_type) || '-v' || p_size || '.' || (p_partkey % 10) || '.0' AS workflow FROM part)
    SELECT p_partkey, upper(regexp_replace(regexp_replace(stage || 'NT', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))
            || '_INPUT_URI' AS input_key,
        upper(regexp_replace('NT' || stage, '([^A-Z])([A-Z])', '\\1_\\2', 'g')) AS acronym_key,
        CASE WHEN uri LIKE 's3://%' THEN split_part(uri, '/', 3) END AS bucket,
        CASE WHEN uri LIKE 's3://%' THEN substr(uri, length('s3://refs/') + 1) END AS key,
        regexp_replace(workflow, 'v(\\d+)\\..+', '\\1') AS major, p_partkey % 3 = 0 AS gzipped
    FROM named"""
)
def text_functions(t: Tables) -> DataFrame:
    stage = F.replace(F.initcap("p_name"), F.lit(" "))
    uri = F.concat(F.expr("IF(p_size % 2 = 0, 's3://refs/', 'https://refs/')"), "p_brand", F.lit("/"), "p_name")
    workflow = F.expr("concat(lower(p_type), '-v', p_size, '.', p_partkey % 10, '.0')")
    return t.part.select(
        "p_partkey",
        text.stage_uri_key(F.concat(stage, F.lit("NT")), "input").alias("input_key"),
        text.snake_upper_acronyms(F.concat(F.lit("NT"), stage)).alias("acronym_key"),
        text.uri_bucket(uri).alias("bucket"),
        text.uri_key(uri).alias("key"),
        text.major_version(workflow).alias("major"),
        text.is_gzip(F.expr("IF(p_partkey % 3 = 0, concat(X'1F8B08', CAST(p_name AS BINARY)), CAST(p_name AS BINARY))")).alias("gzipped"),
    )


@query(
    """SELECT log_source || '-log-count' AS namespace, 'Event occurrences' AS metric, event_type AS dimension_value, n FROM (
        SELECT CASE WHEN user_id % 2 = 0 THEN 'Prod' ELSE 'Staging' END AS log_source, event_type, count(*) AS n
        FROM events GROUP BY 1, 2)"""
)
def emit_metrics(t: Tables) -> DataFrame:
    """Metric rows appended to a table by namespace, twice from halves, and read back."""
    path = new_shared_path(t.spark, "metrics")
    for source, half in (("Prod", "user_id % 2 = 0"), ("Staging", "user_id % 2 = 1")):
        rows = t.events.filter(half).groupBy(F.col("event_type").alias("dimension_value")).agg(F.count("*").alias("n"))
        sinks.emit_metrics(
            rows.select(F.lit(f"{source}-log-count").alias("namespace"), F.lit("Event occurrences").alias("metric"), "*"),
            path,
        )
    return t.spark.read.parquet(path).select("namespace", "metric", "dimension_value", "n")
