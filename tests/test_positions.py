from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taxaflow.operators.lookups import spread_join
from taxaflow.operators.positions import with_positions


def test_positions_with_a_hot_group(spark):
    """One group holds most rows; positions equal the brute-force rank."""
    rng = random.Random(7)
    ids = rng.sample(range(1_000_000), 6000)
    data = [(1 if i < 4000 else rng.choice([2, 3, None]), k) for i, k in enumerate(ids)]
    df = spark.createDataFrame(data, "g INT, k BIGINT").repartition(7)
    got = {(r.g, r.k): r.position for r in with_positions(df, ["k"], ["g"]).collect()}
    assert len(got) == len(data)
    for group in (1, 2, 3, None):
        ordered = sorted(k for g, k in data if g == group)
        assert [got[group, k] for k in ordered] == list(range(len(ordered)))


def test_positions_over_everything(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k")).repartition(5)
    got = sorted((r.position, r.k) for r in with_positions(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_positions_of_text_keys(spark):
    df = spark.createDataFrame([("s", f"f{i % 10}{i}") for i in range(200)], "s STRING, key STRING")
    got = with_positions(df, ["key"], ["s"], "n").orderBy("n").collect()
    assert [r.key for r in got] == sorted(r.key for r in got)


def test_positions_of_nothing(spark):
    assert with_positions(spark.createDataFrame([], "g INT, k INT"), ["k"], ["g"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_spread_join_is_a_join(spark, rows, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("k"))
    groups = facts.filter("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"))
    got = spread_join(facts, groups, ["k"], ["id"], how, copies=5)
    assert rows(got, *sorted(got.columns)) == rows(facts.join(groups, "k", how), *sorted(got.columns))


def test_spread_join_uses_many_partitions_for_a_hot_key(spark):
    facts = spark.range(4000).select("id", F.lit(1).alias("k"))
    groups = facts.groupBy("k").agg(F.count("*").alias("n"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        joined = spread_join(facts.repartition(4), groups, ["k"], ["id"], copies=16)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2500
    finally:
        for key in changed:
            spark.conf.unset(key)
