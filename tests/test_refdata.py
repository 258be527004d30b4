from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxaflow.operators import refdata as op

ARTIFACTS = ["nt_compressed.fa", "nr_compressed.fa", "versioned-taxid-lineages.csv.gz"]


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key STRING")


def test_undated_sibling_is_never_chosen(spark, rows):
    listing = keys(
        spark,
        *[f"ncbi-indexes-dev/2026-07-09/index-generation-2/{a}" for a in ARTIFACTS],
        *[f"ncbi-indexes-dev/smoketest-graviton/be3e4378c/download/{a}" for a in ARTIFACTS],
        "ncbi-indexes-dev/2026-07-10-b/index-generation-2/nt_compressed.fa",
        "other/ncbi-indexes-dev/2027-01-01/nt_compressed.fa",
    )
    assert rows(op.latest_artifact(listing), "env", "kind", "key") == [
        ("dev", "lineages", f"ncbi-indexes-dev/2026-07-09/index-generation-2/{ARTIFACTS[2]}"),
        ("dev", "nr", f"ncbi-indexes-dev/2026-07-09/index-generation-2/{ARTIFACTS[1]}"),
        ("dev", "nt", "ncbi-indexes-dev/2026-07-10-b/index-generation-2/nt_compressed.fa"),
    ]


def test_release_order_is_textual(spark, rows):
    urls = [("w", f"https://x/tags/w-v{v}") for v in ("8.9.0", "8.10.0", "8.2.1")]
    assert rows(op.latest_release(spark.createDataFrame(urls, "workflow STRING, url STRING"))) == [("w", "8.9.0")]


def test_missing_artifacts(spark):
    versions = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "version STRING")
    present = [f"index-generation-v1/{f}" for f in op.STAGE_FILES] + [f"index-generation-v2/{f}" for f in op.STAGE_FILES[1:]]
    tags = spark.createDataFrame([("v1",)], "tag STRING")
    got = {r.version: (r.missing, r.rejected) for r in op.missing_artifacts(versions, keys(spark, *present), tags).collect()}
    assert got["v1"] == ([], False)
    assert got["v2"] == (["index-generation-v2/assemble.wdl", "index-generation:v2"], True)
    assert len(got["v3"][0]) == 10


def outputs(spark, *rows_):
    return spark.createDataFrame(list(rows_), "run_id BIGINT, stage STRING, name STRING, value STRING")


def test_handoff_uses_the_latest_output(spark):
    produced = outputs(
        spark,
        (1, "Download", "ig.nt", "raw"),
        (1, "Download", "ig.nr", ""),
        (1, "Download", "ig.taxdump", None),
        (1, "Compress", "ig.nt", "small"),
        (2, "Download", "ig.nt", "raw2"),
    )
    got = {(r.run_id, r.stage, r.input): r.value for r in op.stage_handoff(produced).collect()}
    assert got[1, "Compress", "download_out_nt"] == "raw"
    assert got[1, "Index", "compress_out_nt"] == "small"
    assert got[1, "Compress", "download_out_nr"] is None
    assert got[1, "Compress", "download_out_taxdump"] is None
    assert (2, "Index", "compress_out_nt") not in got
    assert len(got) == 21


def test_handoff_map_names():
    expected = {f"download_out_{n}": n for n in op.HANDOFF_NAMES}
    assert list(op.handoff_map()) == ["Compress", "Index"] and op.handoff_map()["Compress"] == expected


def test_lanes_read_each_other(spark):
    produced = outputs(
        spark, (1, "DownloadTaxonomy", "x.accession2taxid_pdb", "pdb"), (1, "DownloadNR", "x.nr", "raw"), (1, "CompressNR", "x.nr", "small")
    )
    got = {(r.stage, r.input): r.value for r in op.stage_handoff(produced, op.LANE_PHASES, op.LANE_INPUTS).collect()}
    assert got["CompressNR", "download_out_accession2taxid_pdb"] == "pdb"
    assert got["CompressNR", "download_out_nr"] == "raw"
    assert got["IndexNR", "compress_out_nr"] == "small"
    assert got["CompressNT", "download_out_nt"] is None


def test_run_inputs_feed_inputs_without_a_source(spark):
    produced = outputs(spark, (1, "First", "w.a", "A"))
    given = spark.createDataFrame([(1, "fastqs_0", "reads")], "run_id BIGINT, name STRING, value STRING")
    got = op.stage_handoff(produced, {"First": 0, "Second": 1}, {"Second": {"fastqs_0": None, "fastqs_1": None, "in_a": "a"}}, given)
    assert {r.input: r.value for r in got.collect()} == {"fastqs_0": "reads", "fastqs_1": None, "in_a": "A"}


@pytest.mark.parametrize(
    ("version", "age", "status"),
    [
        ("2024-01-01", 400, "OK"),
        ("2023-12-31", 401, "STALE"),
        ("2024-01-01x", None, "UNPARSEABLE"),
        ("2024-13-01", None, "UNPARSEABLE"),
        ("-", None, "UNPARSEABLE"),
        (None, None, "UNPARSEABLE"),
    ],
)
def test_staleness(spark, version, age, status):
    pointers = spark.createDataFrame([("dev", version)], "env STRING, version STRING")
    [row] = op.index_staleness(pointers, F.expr("DATE'2025-02-04'")).collect()
    assert (row.age_days, row.status) == (age, status)


def test_retention(spark, rows):
    dated = [f"2024-0{m}-01" for m in range(1, 8)]
    listing = keys(
        spark, *[f"ncbi-indexes-dev/{d}/x" for d in dated], *[f"ncbi-indexes-dev/{d}/y" for d in dated], "ncbi-indexes-dev/2024-09-01-b/x", "ncbi-indexes-qa/2020-01-01/x"
    )
    pointers = spark.createDataFrame([("dev", "2024-02-01", "-")], "env STRING, current STRING, previous STRING")
    plan = op.retention_plan(op.dated_versions(listing), pointers)
    kept = rows(plan.filter("action = 'KEEP'"), "env", "version")
    assert kept == [("dev", f"2024-0{m}-01") for m in (2, 5, 6, 7)] + [("qa", "2020-01-01")]
    assert plan.count() == 8


def test_promotion_fails_closed(spark):
    scores = spark.createDataFrame(
        [("a", 2, 0.98, 0.99), ("a", 2, 1.0, 1.0), ("b", 2, 0.979, 1.0), ("b", 2, 1.0, 1.0), ("c", 2, None, 1.0)],
        "version STRING, major INT, nt_score DOUBLE, nr_score DOUBLE",
    )
    candidates = spark.createDataFrame(
        [("e", v, m, "now") for v, m in (("a", 2), ("a", 3), ("b", 2), ("c", 2), ("d", 2), ("now", 2))],
        "env STRING, version STRING, major INT, current STRING",
    )
    got = {(r.version, r.major): r.decision for r in op.promotion_gate(candidates, scores).collect()}
    assert got == {
        ("a", 2): "PROMOTE", ("a", 3): "REFUSE", ("b", 2): "REFUSE", ("c", 2): "REFUSE", ("d", 2): "REFUSE",
        ("now", 2): "ALREADY_CURRENT",
    }
    bypass = {r.version: r.decision for r in op.promotion_gate(candidates, scores, allow_unverified=True).collect()}
    assert bypass["d"] == "PROMOTE" and bypass["now"] == "ALREADY_CURRENT"


def test_restricted_files(spark, rows):
    names = ["a/fastp1.fastq", "a/fastp.fastq", "a/sample.hostfiltered.bam", "a/sample.hostfiltered.bam.bai", "validated_0.fastq.gz", "dedup1.fastq"]
    objects = spark.createDataFrame([(e, n) for e in ("dev", "prod") for n in names], "env STRING, key STRING")
    assert rows(op.restricted_files(objects), "env", "key") == [
        ("dev", "a/fastp1.fastq"), ("dev", "a/sample.hostfiltered.bam"), ("dev", "validated_0.fastq.gz")
    ]


@pytest.mark.parametrize(
    ("bucket", "current", "key", "age", "action"),
    [
        ("references", True, "ncbi-indexes-dev/x", 180, "archive"),
        ("references", True, "ncbi-indexes-dev/x", 179, "none"),
        ("references", True, "host/x", 999, "none"),
        ("references", False, "ncbi-indexes-dev/x", 999, "none"),
        ("workflows", False, "x", 30, "archive"),
        ("workflows", False, "x", 60, "expire"),
        ("workflows", True, "x", 999, "none"),
        ("benchmark", False, "x", 60, "archive"),
        ("benchmark", False, "x", 90, "expire"),
        ("logs", True, "x", 365, "expire"),
        ("logs", False, "x", 30, "expire"),
        ("logs", True, "x", 30, "none"),
    ],
)
def test_lifecycle(spark, bucket, current, key, age, action):
    since = dt.datetime(2024, 6, 1) - dt.timedelta(days=age)
    objects = spark.createDataFrame([(bucket, key, current, since)], "bucket STRING, key STRING, is_current BOOLEAN, since TIMESTAMP_NTZ")
    assert op.lifecycle_actions(objects, F.expr("DATE'2024-06-01'")).first().action == action
