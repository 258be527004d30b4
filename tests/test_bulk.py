from __future__ import annotations

import json
import math

import pytest

from taxaflow.operators import bulk as op
from taxaflow.sources import files


def records(spark, *specs):
    return spark.createDataFrame(
        [(i, list(runs), list(backgrounds)) for i, (runs, backgrounds) in enumerate(specs)],
        "record_no BIGINT, pipeline_run_ids ARRAY<BIGINT>, background_ids ARRAY<BIGINT>",
    )


def numbered(spark, n):
    return spark.range(n).selectExpr("id AS position", "id AS item")


def test_pairs_keep_the_order_of_the_spec(spark):
    frame = records(spark, ([7, 3], [2, 1]), ([], [5]), ([9], []), ([4], [8]))
    pairs = op.numbered_pairs(frame).orderBy("position").collect()
    assert [(r.pipeline_run_id, r.background_id) for r in pairs] == [(7, 2), (7, 1), (3, 2), (3, 1), (4, 8)]
    assert [r.position for r in pairs] == list(range(5))


def stripes(frame):
    batches: dict[int, list[tuple]] = {}
    for r in frame.collect():
        batches.setdefault(r.batch, []).append((r.offset, r["item"]))
    return {b: [item for _, item in sorted(v)] for b, v in batches.items()}


def test_stripes(spark):
    assert stripes(op.striped_batches(numbered(spark, 7), 3)) == {0: [0, 3, 6], 1: [1, 4], 2: [2, 5]}


@pytest.mark.parametrize(
    ("skip", "expected"),
    [
        ([1, 0, 2], {0: [3, 6], 1: [1, 4]}),
        ([1, 0], {0: [3, 6], 1: [1, 4]}),
        ([], {0: [0, 3, 6], 1: [1, 4], 2: [2, 5]}),
    ],
)
def test_resume(spark, skip, expected):
    resumed = op.resume_skip(op.striped_batches(numbered(spark, 7), 3), skip)
    assert stripes(resumed) == expected
    assert {r.offset for r in resumed.filter("batch = 0").collect()} == set(range(len(expected[0])))


def test_progress_stops_at_the_first_failure(spark, rows):
    outcomes = spark.createDataFrame(
        [(0, 0, False), (0, 1, True), (0, 2, False), (0, 3, True), (1, 0, False), (1, 1, False), (2, 0, True)],
        "batch INT, offset BIGINT, failed BOOLEAN",
    )
    assert rows(op.batch_progress(outcomes), "batch", "total", "success_count", "failed") == [
        (0, 4, 1, True),
        (1, 2, 2, False),
        (2, 1, 0, True),
    ]


@pytest.mark.parametrize(("total", "done"), [(7, 7), (250, 130), (1000, 999), (3, 0)])
def test_checkpoints_match_the_definition(spark, rows, total, done):
    progress = spark.createDataFrame([(0, total, done)], "batch INT, total BIGINT, success_count BIGINT")
    marks = [math.floor(i * 0.01 * total) for i in range(1, 101)]
    expected = [(n, math.floor(n / total * 100)) for n in range(1, done + 1) if n in marks]
    assert rows(op.progress_checkpoints(progress), "reached", "percent") == expected


@pytest.mark.parametrize(
    ("failed", "total", "message"),
    [
        (11, 11, "11 / 11 pipeline runs failed to index. See logs for more details."),
        (1, 1, "1 / 1 pipeline runs failed to index. See logs for more details."),
        (3, 5, "3 / 5 pipeline runs failed to index. See logs for more details."),
        (0, 2, None),
    ],
)
def test_failure_message(spark, failed, total, message):
    results = [("error" if i % 2 else "response", "Unhandled" if i % 2 == 0 else None) for i in range(failed)]
    results += [("response", None)] * (total - failed)
    [row] = op.result_summary(spark.createDataFrame(results, "kind STRING, function_error STRING")).collect()
    assert (row.failed, row.succeeded, row.message) == (failed, total - failed, message)


def test_job_spec_file(spark, tmp_path):
    spec = {"job_params": [{"background_ids": [1, 2], "pipeline_run_ids": [5]}, {"background_ids": [3], "pipeline_run_ids": [6, 7]}], "concurrency": 20}
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(spec, indent=2))
    read = files.read_job_spec(spark, str(path))
    [row] = read.collect()
    assert (row.concurrency, row.skip) == (20, None)
    pairs = op.numbered_pairs(files.spec_records(read)).orderBy("position").collect()
    assert [(r.pipeline_run_id, r.background_id) for r in pairs] == [(5, 1), (5, 2), (6, 3), (7, 3)]
