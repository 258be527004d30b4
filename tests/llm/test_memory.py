"""Python memory of a task's function on full batches, as NumPy tells tracemalloc."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxaflow.llm import bpe, common, quality, secrets, shingle_join


def texts() -> pa.RecordBatch:
    draw = np.random.default_rng(1)
    rows = [" ".join(f"w{w}" for w in draw.integers(0, 9999, 800)) for _ in range(1500)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})


def statistics() -> pa.RecordBatch:
    rows = 10_000
    stats = pa.FixedSizeListArray.from_arrays(pa.array(np.random.default_rng(1).normal(size=rows * len(quality.STATISTICS))), len(quality.STATISTICS))
    folds = pa.array(np.arange(rows, dtype=np.int32) % quality.FOLDS)
    return pa.RecordBatch.from_arrays([stats, pa.array(np.arange(rows) % 2, pa.float64()), folds], names=["stats", "label", "fold"])


WIDTH = len(quality.STATISTICS)


@pytest.mark.parametrize(
    ("function", "batch", "most"),
    [
        (shingle_join.frequent(5), texts(), 60),
        (shingle_join.describe(5, 80, np.empty(0, np.uint64)), texts(), 40),
        (shingle_join.hash_sets(5), texts(), 40),
        (quality.products(np.zeros(WIDTH), np.ones(WIDTH)), statistics(), 20),
        (quality.raw_cells(np.zeros(WIDTH), np.ones(WIDTH), 1.0, np.ones(quality.FEATURES + 1)), statistics(), 20),
    ],
)
def test_a_task_holds_little_at_a_time(function, batch, most):
    tracemalloc.start()
    try:
        for _ in function(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < most << 20
    finally:
        tracemalloc.stop()


def most_held(function, batch: pa.RecordBatch) -> float:
    """MB that NumPy and Python hold at most while the function goes over the batch."""
    tracemalloc.start()
    try:
        for _ in function(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_counting_shingles_holds_a_run_twice():
    """The shingles of a run, in their sets and in one array, and little besides."""
    batch = texts()
    shingles = sum(map(len, shingle_join.shingle_sets(shingle_join.raw_texts(batch), 5)))
    assert most_held(shingle_join.frequent(5), batch) < 2 * 8 * shingles / (1 << 20) + 12


def test_counted_shingles_are_those_of_three_sets_or_more():
    rows = ["a b c d", "a b c d e", "x a b c", "a b c d", "b c d e", "x y", "x a b c d e"]
    found = pa.Table.from_batches(shingle_join.frequent(3)(iter([pa.RecordBatch.from_pydict({"text": rows})])))
    sets = {tuple(s) for s in shingle_join.shingle_sets([r.encode() for r in rows], 3)}
    counts = {v: n for v in {v for s in sets for v in s} if (n := sum(v in s for s in sets)) >= 3}
    assert dict(zip(found.column("shingle").to_numpy().view(np.uint64).tolist(), found.column("n").to_pylist(), strict=True)) == counts
    assert sorted(counts.values()) == [3, 4, 4]
    for few in ([], ["a b c"], ["a b c", "b c d"]):
        assert not sum(b.num_rows for b in shingle_join.frequent(3)(iter([pa.RecordBatch.from_pydict({"text": pa.array(few, pa.string())})])))


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")).limit(1), F.lit(True)),
        lambda docs: quality.score(docs, quality.Model(np.zeros(WIDTH), np.ones(WIDTH), 1.0, np.zeros(quality.FEATURES + 1), np.zeros(1), np.full(1, 0.5))),
        lambda docs: shingle_join.near_duplicates(docs.limit(2)),
        secrets.find_secrets,
        bpe.encode,
    ],
)
def test_a_worker_gets_few_texts_at_a_time(spark, operator):
    """Operators on texts bound a batch by its bytes, unless the session has a bound of its own."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text")).coalesce(1)

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

    before = spark.conf.get(common.BATCH_BYTES, None)
    try:
        spark.conf.unset(common.BATCH_BYTES)
        operator(docs)
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 11e6 and max(found) < 1.2 * common.SLICE_BYTES
        spark.conf.set(common.BATCH_BYTES, "5m")
        operator(docs.limit(3))
        assert spark.conf.get(common.BATCH_BYTES) == "5m"
    finally:
        spark.conf.unset(common.BATCH_BYTES) if before is None else spark.conf.set(common.BATCH_BYTES, before)
