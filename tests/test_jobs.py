from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import eviction, scoring
from taxaflow.plans import eviction_inputs, jobs, scoring_inputs
from taxaflow.session import new_shared_path
from taxaflow.sources import keyed_tables
from taxaflow.sources.keyed_tables import read_table
from taxaflow.sources.tables import Tables

DIRECTORY = "/root/testdata/sf0.001"


def now():
    return F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")


@pytest.fixture()
def scoring_tables(spark):
    t = Tables(spark, DIRECTORY)
    return jobs.ScoringTables(
        scoring_inputs.taxon_counts(t),
        scoring_inputs.pipeline_runs(t),
        scoring_inputs.alignment_configs(t),
        scoring_inputs.taxon_lineages(t),
        scoring_inputs.taxon_summaries(t),
        scoring_inputs.contigs(t),
    )


def test_index_job_and_its_repeat(spark, rows, scoring_tables):
    documents, status = new_shared_path(spark, "documents"), new_shared_path(spark, "status")
    first = '{"pipeline_run_id": 1, "background_id": 1}'
    second = '{"pipeline_run_id": 2, "background_id": 2}'
    seen = []
    for events in ([first], [first, second, "[]"], [first, second]):
        frame = spark.createDataFrame([(e,) for e in events], "event STRING")
        result = jobs.index_job(spark, scoring_tables, frame, documents, status, now())
        seen.append(rows(result, "pipeline_run_id", "background_id", "success"))
        assert all(r.documents > 0 for r in result.collect())
    assert seen == [[(1, 1, True)], [(1, 1, True), (2, 2, True)], [(1, 1, True), (2, 2, True)]]
    assert rows(read_table(spark, status), "pipeline_run_id", "background_id", "is_complete") == [(1, 1, True), (2, 2, True)]
    written = read_table(spark, documents)
    assert written.count() == written.select("doc_id").distinct().count()
    assert written.count() == scoring_tables.counts.filter("pipeline_run_id IN (1, 2)").select("pipeline_run_id", "tax_id").distinct().count()


def test_failure_leaves_the_status_incomplete(spark, rows, scoring_tables):
    documents, status = new_shared_path(spark, "documents"), new_shared_path(spark, "status")
    broken = scoring_tables.counts.withColumn(
        "rpm", F.when(F.col("pipeline_run_id") == 1, F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.col("rpm"))
    )
    events = spark.createDataFrame([('{"pipeline_run_id": 1, "background_id": 1}',)], "event STRING")
    whole, scoring_tables.counts = scoring_tables.counts, broken
    with pytest.raises(Exception, match="bad row"):
        jobs.index_job(spark, scoring_tables, events, documents, status, now())
    assert rows(read_table(spark, status), "is_complete") == [(False,)]
    scoring_tables.counts = whole
    jobs.index_job(spark, scoring_tables, events, documents, status, now())
    assert rows(read_table(spark, status), "is_complete") == [(True,)]


EXPIRED = "TIMESTAMP_NTZ'1998-07-01 12:00:00'"


KEYS = ["pipeline_run_id", "background_id"]


def eviction_tables(spark, index=None, completed=None):
    """Source runs, running tasks, and paths of the documents, the status index and the task log."""
    t = Tables(spark, DIRECTORY)
    index = eviction_inputs.index_documents(t) if index is None else index
    completed = eviction.completed_tasks(eviction_inputs.completed_documents(t)) if completed is None else completed
    documents, status, tasks = (new_shared_path(spark, name) for name in ("documents", "status", "tasks"))
    keyed_tables.upsert_table(spark, documents, index.select(*KEYS), KEYS, bucket_rows=100)
    keyed_tables.upsert_table(spark, status, index, KEYS, bucket_rows=100)
    keyed_tables.upsert_table(spark, tasks, completed, jobs.TASK_KEY, jobs.TASK_KEY)
    running = eviction.running_tasks(eviction_inputs.running_listing(t))
    return eviction_inputs.source_runs(t), running, documents, status, tasks


def versions(spark, *paths):
    return [keyed_tables.current_version(spark, p).number for p in paths]


def test_evict_job(spark, rows):
    source, running, documents, status, tasks = eviction_tables(spark)
    whole = read_table(spark, documents).count()
    arguments = (spark, source, running, documents, status, tasks, F.expr(EXPIRED))
    options = {"concurrency": 100_000, "runs_per_task": 50}
    report = jobs.evict_job(*arguments, "a", strict=False, **options)
    assert rows(report, "severity", "message") == [("error", "Failed tasks found"), ("error", "Missing tasks found")]
    marked = read_table(spark, status).filter("deletion_task LIKE 'evict-a:%'").select(*KEYS)
    left = read_table(spark, documents)
    assert marked.count() > 0 and left.count() > 0
    assert left.join(marked, KEYS, "left_semi").count() == 0
    assert left.count() + marked.count() >= whole - marked.count()
    with pytest.raises(eviction.EvictionError, match="Missing tasks found"):
        jobs.evict_job(*arguments, "b", **options)


def test_dry_run_writes_nothing(spark):
    source, running, *paths = eviction_tables(spark)
    before = versions(spark, *paths)
    jobs.evict_job(spark, source, running, *paths, F.expr(EXPIRED), "a", dry_run=True, strict=False, concurrency=1000)
    assert versions(spark, *paths) == before


def test_failed_deletion_is_reported_and_marks_nothing(spark, rows):
    source, running, _, status, tasks = eviction_tables(spark)
    report = jobs.evict_job(spark, source, running, new_shared_path(spark, "absent"), status, tasks, F.expr(EXPIRED), "a", strict=False, concurrency=1000)
    assert ("error", "Eviction start failed") in rows(report, "severity", "message")
    assert read_table(spark, status).filter("deletion_task LIKE 'evict-a:%'").count() == 0


def failing(monkeypatch, path):
    """Every write of the table at ``path`` fails at its last step."""
    plain = keyed_tables.publish

    def publish(spark, at, version):
        if at == path:
            raise OSError("store is down")
        plain(spark, at, version)

    monkeypatch.setattr(keyed_tables, "publish", publish)


def test_failed_clean_up_is_a_warning(spark, rows, monkeypatch):
    """The report has the clean-up steps that failed; what they left is cleaned up by the next cycle."""
    source, running, documents, status, tasks = eviction_tables(spark)
    arguments = (spark, source, running, documents, status, tasks, F.expr(EXPIRED))
    before = rows(read_table(spark, tasks), "deletion_task")
    with monkeypatch.context() as broken:
        failing(broken, tasks)
        report = rows(jobs.evict_job(*arguments, "a", strict=False, concurrency=0), "severity", "message")
    assert ("warning", "Succeeded task deletion failed") in report and ("warning", "Failed task deletion failed") in report
    assert ("warning", "Pipeline_run cleanup failed") not in report
    assert rows(read_table(spark, tasks), "deletion_task") == before
    with monkeypatch.context() as broken:
        failing(broken, status)
        report = rows(jobs.evict_job(*arguments, "b", strict=False, concurrency=0), "severity", "message")
    assert ("warning", "Pipeline_run cleanup failed") not in report  # the first cycle had removed them all
    source, running, documents, status, tasks = eviction_tables(spark)
    with monkeypatch.context() as broken:
        failing(broken, status)
        report = rows(jobs.evict_job(spark, source, running, documents, status, tasks, F.expr(EXPIRED), "c", strict=False, concurrency=1000), "severity", "message")
    assert ("warning", "Pipeline_run cleanup failed") in report
    assert ("error", "Task ID set failed after eviction started") in report
    assert ("warning", "Succeeded task deletion failed") not in report  # kept, so that the runs are found again
    assert read_table(spark, tasks).filter("deletion_task LIKE 'evict-c:%'").count() == 0


def small_tables(spark, path):
    """Four expired runs in the driver's tables, as far as eviction reads them."""
    day = dt.datetime(1997, 1, 1)
    orders = [(r, r, "O", 1.0, day, "1-URGENT" if r == 4 else "2-HIGH") for r in range(1, 5)]
    customers = [(r, f"c{r}", 1, 1.0, "MACHINERY") for r in range(1, 5)]
    spark.createDataFrame(
        orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING").write.parquet(
        f"{path}/customer.parquet"
    )
    return str(path)


@pytest.mark.parametrize("table", ["documents", "index", "tasks"])
def test_a_failed_step_fails_the_query(spark, rows, monkeypatch, tmp_path, table):
    """Rows of the cycles are given out only if every step of every cycle was done."""
    from taxaflow.plans import eviction_queries, registered

    directory, paths, plain = small_tables(spark, tmp_path), {}, keyed_tables.publish

    def publish(spark, at, version):
        if at == paths[table] and version.number > 1:
            raise OSError("store is down")
        plain(spark, at, version)

    monkeypatch.setattr(eviction_queries, "new_shared_path", lambda spark, name: paths.setdefault(name, new_shared_path(spark, name)))
    done = registered.QUERIES["evict_cycles"](spark, directory)
    assert rows(done, "pipeline_run_id", "has_documents") == [(4, True)]  # its task had succeeded before
    paths.clear()
    monkeypatch.setattr(keyed_tables, "publish", publish)
    with pytest.raises(eviction.EvictionError, match="failed"):
        registered.QUERIES["evict_cycles"](spark, directory)


def test_an_error_of_spark_ends_the_cycle(spark):
    """Only what a table refuses is reported; other errors are raised where they happen, strict or not."""
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        jobs.attempt(lambda: spark.sql("SELECT raise_error('broken')").collect())
    with pytest.raises(ZeroDivisionError):
        jobs.attempt(lambda: 1 / 0)
    assert jobs.attempt(lambda: open("/absent/file")) == "FileNotFoundError"


def test_cycles_make_progress(spark, rows):
    """Twenty expired runs, two tasks of three runs a cycle: every cycle deletes the next runs."""
    day = dt.datetime(1998, 1, 1)
    index = spark.createDataFrame([(r, 1, True, day, day, None) for r in range(1, 21)], schemas.RUN_STATUS)
    logged = eviction.completed_tasks(eviction_inputs.completed_documents(Tables(spark, DIRECTORY))).limit(0)
    _, running, documents, status, tasks = eviction_tables(spark, index, logged)
    left, statuses, logged = [], [], []
    for c in range(5):
        jobs.evict_job(
            spark, index.select("pipeline_run_id"), running.limit(0), documents, status, tasks, F.expr(EXPIRED), str(c), concurrency=2, runs_per_task=3
        )
        left.append(read_table(spark, documents).count())
        statuses.append(read_table(spark, status).count())
        logged.append(rows(read_table(spark, tasks), "deletion_task"))
    assert left == [14, 8, 2, 0, 0]
    assert statuses == [20, 14, 8, 2, 0]
    assert logged == [[(f"evict-{c}:0",), (f"evict-{c}:1",)] for c in range(3)] + [[("evict-3:0",)], []]


def test_contigs_are_cut_to_the_requested_runs_first(spark, scoring_tables):
    """The semi-join stands below the aggregate of the contigs, and counts are cut before they are joined."""
    requests = spark.createDataFrame([(1, 1)], "pipeline_run_id BIGINT, background_id BIGINT")
    t = scoring_tables
    scored = scoring.scored_taxon_counts(t.counts, t.runs, t.configs, t.lineages, t.summaries, now=now(), requests=requests)
    plan = scoring.taxon_documents(scored, t.contigs, requests)._jdf.queryExecution().optimizedPlan().toString()
    stack = plan.index("Expand") if "Expand" in plan else plan.index("Generate stack")
    below = plan[stack:].split("\n")[:8]
    assert any("LeftSemi" in line for line in below), below


def test_hot_run_is_split_in_every_join_of_the_flagship(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    third = F.pmod(F.xxhash64("pipeline_run_id", "tax_id"), F.lit(3)) == 0
    other = F.pmod(F.xxhash64("pipeline_run_id", "tax_id", "count_type"), F.lit(3)) == 0
    path = new_shared_path(spark, "hot-counts")
    scoring_inputs.taxon_counts(t).withColumn(
        "pipeline_run_id", F.when(third, 3).otherwise(F.col("pipeline_run_id"))
    ).withColumn("tax_id", F.when(other, 7).otherwise(F.col("tax_id"))).write.parquet(path)
    changed = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        scored = scoring.scored_taxon_counts(
            spark.read.parquet(path),
            scoring_inputs.pipeline_runs(t),
            scoring_inputs.alignment_configs(t),
            scoring_inputs.taxon_lineages(t),
            scoring_inputs.taxon_summaries(t),
            now=now(),
            background_id=1,
        )
        plan = scored._jdf.queryExecution().executedPlan()
        plan.execute().count()
        assert plan.toString().split("Initial Plan")[0].count("SortMergeJoin(skew=true)") == 3
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
