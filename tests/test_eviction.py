from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import eviction as op

def now():
    return F.expr("TIMESTAMP_NTZ'2024-03-15 12:34:56'")



def status(run, background=1, created="2024-03-01", read=None, task=None, complete=True):
    parse = lambda s: None if s is None else dt.datetime.fromisoformat(s)
    return (run, background, complete, parse(created), parse(read), task)


def index_of(spark, *documents):
    return spark.createDataFrame(list(documents), schemas.RUN_STATUS)


def runs_of(spark, *runs):
    return spark.createDataFrame([(r,) for r in runs], "pipeline_run_id BIGINT")


@pytest.mark.parametrize(("source", "index", "deleted"), [([1], [1, 2], [2]), ([1, 2], [1, 2], []), ([], [3, 3], [3])])
def test_deleted_runs(spark, rows, source, index, deleted):
    documents = index_of(spark, *[status(r, b) for b, r in enumerate(index)])
    assert rows(op.deleted_runs(documents, runs_of(spark, *source))) == [(r,) for r in deleted]


def test_expiry_is_cut_at_the_day(spark, rows):
    index = index_of(
        spark,
        status(1, read="2024-02-13T23:59:59"),
        status(2, read="2024-02-14T00:00:00"),
        status(3, created="2024-02-13T23:59:59"),
        status(4, created="2024-02-14T00:00:00"),
        status(5, created="2020-01-01", read="2024-03-01"),
    )
    assert rows(op.expired_runs(index, now()), "pipeline_run_id") == [(1,), (3,)]


@pytest.mark.parametrize(
    ("pairs", "excluded", "expected"),
    [([(1, 1), (2, 1)], [], [(1, 1), (1, 2)]), ([(1, 1), (2, 2)], [2], [(1, 1)])],
)
def test_expired_by_background(spark, rows, pairs, excluded, expected):
    expired = index_of(spark, *[status(r, b) for r, b in pairs])
    got = op.expired_by_background(expired, runs_of(spark, *excluded))
    assert rows(got, "background_id", "pipeline_run_id") == expected


def task_tables(spark):
    listing = spark.createDataFrame(
        [({"aaaa": {"tasks": {"aaaa-1111:1111": ("aaaa-1111", 1111), "zz:9": ("zz", 9)}}},)], schemas.RUNNING_TASKS
    )
    completed = spark.createDataFrame(
        [
            (True, None, ("bbbb-2222", 2222), ([],)),
            (True, None, ("dddd-4444", 4444), ([(404,)],)),
            (False, "lost", ("eeee-5555", 5555), ([],)),
            (False, None, ("ffff-6666", 6666), ([],)),
        ],
        schemas.COMPLETED_TASKS,
    )
    return op.running_tasks(listing), op.completed_tasks(completed)


def task_index(spark):
    return index_of(
        spark,
        status(1, 1, task="aaaa-1111:1111"),
        status(2, 2, task="bbbb-2222:2222"),
        status(3, 3, task="cccc-3333:3333"),
        status(4, 4, task="dddd-4444:4444"),
        status(5, 5, task="eeee-5555:5555"),
        status(6, 6, task="ffff-6666:6666"),
        status(7, 7),
    )


def test_task_status(spark):
    statuses = op.task_status(task_index(spark), *task_tables(spark))
    flags = {r.pipeline_run_id: (r.missing, r.running, r.succeeded, r.failed) for r in statuses.collect()}
    assert flags == {
        1: (False, True, False, False),
        2: (False, False, True, False),
        3: (True, False, False, False),
        4: (False, False, False, True),
        5: (False, False, False, True),
        6: (False, False, False, False),
    }


def test_cleanup_plan_and_exclusions(spark, rows):
    statuses = op.task_status(task_index(spark), *task_tables(spark))
    assert rows(op.excluded_runs(statuses), "pipeline_run_id") == [(1,), (2,)]
    plan = op.task_cleanup_plan(statuses)
    assert rows(plan.filter("drop_status_document"), "pipeline_run_id") == [(2,)]
    assert rows(plan.filter("drop_task"), "pipeline_run_id") == [(2,), (4,), (5,)]
    [counts] = op.task_counts(statuses).collect()
    assert (counts.running_tasks, counts.missing_tasks, counts.failed_tasks, counts.succeeded_tasks) == (1, 1, 2, 1)


def test_tasks_by_ids(spark, rows):
    running, _ = task_tables(spark)
    wanted = op.runs_being_deleted(task_index(spark))
    assert rows(op.tasks_by_ids(running, wanted), "deletion_task") == [("aaaa-1111:1111",)]


@pytest.mark.parametrize(("limit", "running", "free"), [(1, 2, 0), (2, 1, 1), (6, 0, 6)])
def test_capacity(limit, running, free):
    assert op.capacity(running, limit) == free


def test_candidates_leave_out_runs_being_deleted(spark, rows):
    index = index_of(
        spark, *[status(r, created="2020-01-01") for r in (1, 5, 6)], status(6, 2, created="2020-01-01"), status(7, 3)
    )
    got = op.eviction_candidates(index, runs_of(spark, 6, 7), runs_of(spark, 1, 2), now())
    assert rows(got, "kind", "background_id", "pipeline_run_id") == [
        ("run", None, 5),
        ("run_background", 1, 6),
        ("run_background", 2, 6),
    ]


def candidates(spark, whole=(), pairs=()):
    data = [("run", None, r) for r in whole] + [("run_background", b, r) for b, r in pairs]
    return spark.createDataFrame(data, "kind STRING, background_id BIGINT, pipeline_run_id BIGINT")


@pytest.mark.parametrize(
    ("ids", "size", "expected"),
    [
        ([], 2, []),
        ([1], 2, [[1]]),
        ([1, 2, 3, 4], 2, [[1, 2], [3, 4]]),
        ([1, 2, 3, 4, 5], 2, [[1, 2], [3, 4], [5]]),
    ],
)
def test_batches(spark, ids, size, expected):
    batches = op.eviction_batches(candidates(spark, ids), 10, size).orderBy("batch_no").collect()
    assert [r.run_ids for r in batches] == expected
    assert [r.batch_no for r in batches] == list(range(len(expected)))


def test_capacity_is_spent_on_runs_then_backgrounds(spark):
    frame = candidates(spark, [9], [(1, 4), (2, 5), (1, 3)])
    for build in (lambda c: op.eviction_batches(frame, c, 1).filter("started"), lambda c: op.first_batches(frame, c, 1)):
        assert [(r.background_id, r.run_ids) for r in build(2).orderBy("batch_no").collect()] == [(None, [9]), (1, [3])]
        assert [(r.background_id, r.run_ids) for r in build(4).orderBy("batch_no").collect()] == [
            (None, [9]),
            (1, [3]),
            (1, [4]),
            (2, [5]),
        ]


def test_first_batches_are_the_first_of_all_batches(spark, rows):
    frame = candidates(spark, range(100, 130), [(b, r) for b in range(5) for r in range(b * 3)])
    whole = op.eviction_batches(frame, 50, 4)
    for cap in (1, 4, 9, 50):
        assert rows(op.first_batches(frame, cap, 4).drop("started")) == rows(whole.filter(F.col("batch_no") < cap).drop("started"))


def test_mark_being_deleted(spark, rows):
    index = index_of(spark, status(1, 1), status(1, 2), status(2, 1), status(3, 1, task="old"))
    marked = spark.createDataFrame(
        [(1, None, "t1"), (1, 2, "t2"), (2, 5, "t3")], "pipeline_run_id BIGINT, background_id BIGINT, task_id STRING"
    )
    got = op.mark_being_deleted(index, marked)
    assert rows(got, "pipeline_run_id", "background_id", "is_complete", "deletion_task") == [
        (1, 1, False, "t1"),
        (1, 2, False, "t2"),
        (2, 1, True, None),
        (3, 1, True, "old"),
    ]


def test_report(spark, rows):
    statuses = op.task_status(task_index(spark), *task_tables(spark))
    cleanup = spark.createDataFrame(
        [("succeeded", "boom"), ("failed", None), ("pipeline_runs", "boom")], "step STRING, error STRING"
    )
    started = spark.createDataFrame(
        [(0, "boom", None), (1, "boom", "boom"), (2, None, "boom"), (3, None, None)],
        "batch_no INT, start_error STRING, mark_error STRING",
    )
    report = op.eviction_report(statuses, cleanup, started)
    assert rows(report, "severity", "message", "n") == [
        ("error", "Eviction start failed", 2),
        ("error", "Failed tasks found", 1),
        ("error", "Missing tasks found", 1),
        ("error", "Task ID set failed after eviction started", 1),
        ("warning", "Pipeline_run cleanup failed", 1),
        ("warning", "Succeeded task deletion failed", 1),
    ]
    with pytest.raises(op.EvictionError, match="Missing tasks found"):
        op.raise_on_report(report)
    op.raise_on_report(report.limit(0))


def cycle(spark, **options):
    running, completed = task_tables(spark)
    index = task_index(spark).unionByName(index_of(spark, status(20), status(21, created="2020-01-01")))
    return op.evict(index, runs_of(spark, *range(1, 8), 21), running, completed, now=now(), **options)


def test_evict_cycle(spark, rows):
    result = cycle(spark, runs_per_task=2, node="evict-7")
    assert (result["running_tasks"], result["capacity"]) == (1, 5)
    documents = task_index(spark).unionByName(index_of(spark, status(20), status(21, created="2020-01-01")))
    assert rows(op.delete_evicted(documents, result["evicted"]), "pipeline_run_id") == [(r,) for r in range(1, 8)]
    index = {r.pipeline_run_id: (r.is_complete, r.deletion_task) for r in result["index"].collect()}
    assert 2 not in index and len(index) == 8
    assert index[20] == (False, "evict-7:0") and index[21] == (False, "evict-7:1")
    assert rows(result["completed_tasks"], "deletion_task", "succeeded") == [
        ("evict-7:0", True), ("evict-7:1", True), ("ffff-6666:6666", False)
    ]


def test_evict_stops_at_zero_capacity(spark, rows):
    result = cycle(spark, concurrency=1)
    assert result["capacity"] == 0 and "batches" not in result and "evicted" not in result


def test_dry_run_changes_nothing(spark, rows):
    result = cycle(spark, dry_run=True)
    assert len(rows(result["index"])) == 9 and len(rows(result["completed_tasks"])) == 4
    assert result["batches"].count() == 2 and "evicted" not in result
