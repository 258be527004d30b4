from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from taxaflow import schemas
from taxaflow.operators import scoring as op
from taxaflow.sources import sinks

def now():
    return F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")



def count_row(run=1, tax_id=10, count_type="NT", level=1, count=10, rpm=12.0, bpm=20.0):
    return (run, tax_id, count_type, level, 5, 6, 2, 0, count, 99.0, 100.0, -10.0, rpm, bpm, f"taxon {tax_id}")


def tables(spark, counts, runs=(), configs=(), lineages=(), summaries=()):
    return (
        spark.createDataFrame(list(counts), schemas.TAXON_COUNTS),
        spark.createDataFrame(list(runs), schemas.PIPELINE_RUNS),
        spark.createDataFrame(list(configs), schemas.ALIGNMENT_CONFIGS),
        spark.createDataFrame(list(lineages), schemas.TAXON_LINEAGES),
        spark.createDataFrame(list(summaries), schemas.TAXON_SUMMARIES),
    )


ILLUMINA, NANOPORE = ("Illumina", 100), ("Nanopore", 100)


@pytest.mark.parametrize(
    ("run", "count", "summary", "expected"),
    [
        (ILLUMINA, {"rpm": 12.0}, (2.0, 5.0, None, None), 2.0),
        (NANOPORE, {"bpm": 20.0}, (2.0, 5.0, None, None), 3.6),
        (None, {"bpm": 20.0}, (2.0, 5.0, None, None), 3.6),
        (ILLUMINA, {"rpm": 10000.0}, (0.0, 1.0, None, None), 99.0),
        (ILLUMINA, {"rpm": 0.0}, (10000.0, 1.0, None, None), -99.0),
        (ILLUMINA, {"rpm": 5.0}, (5.0, 0.0, None, None), 100.0),
        (ILLUMINA, {"rpm": 5.0}, None, 100.0),
        (ILLUMINA, {"count": 10}, (2.0, 5.0, 0.05, 0.025), 2.0),
        (NANOPORE, {"count": 10}, (2.0, 5.0, 4.0, 3.0), 2.0),
        (("Illumina", 0), {"count": 10}, (2.0, 5.0, 0.05, 0.025), 100.0),
        (("Illumina", None), {"count": 10}, (2.0, 5.0, 0.05, 0.025), 100.0),
        (ILLUMINA, {"rpm": None}, (2.0, 5.0, None, None), 100.0),
        (ILLUMINA, {"rpm": 5.0}, (None, None, None, None), 100.0),
    ],
)
def test_zscore_branches(spark, run, count, summary, expected):
    runs = [] if run is None else [(1, run[1], run[0], 7)]
    summaries = [] if summary is None else [(3, 10, 1, "NT", *summary)]
    args = tables(spark, [count_row(**count)], runs, [(7, 3)], [], summaries)
    [row] = op.scored_taxon_counts(*args, now=now(), background_id=3).collect()
    assert row.zscore == pytest.approx(expected)
    assert row.background_id == 3


def test_other_background_does_not_score(spark):
    args = tables(spark, [count_row()], [(1, 0, "Illumina", 7)], [(7, 3)], [], [(4, 10, 1, "NT", 2.0, 5.0, None, None)])
    [row] = op.scored_taxon_counts(*args, now=now(), background_id=3).collect()
    assert (row.mean, row.zscore) == (None, 100.0)


@pytest.mark.parametrize(
    ("tax_id", "expected"),
    [(-200000573, 573), (-100000573, 573), (-100000000, -100000000), (-200, -200), (0, 0), (9606, 9606), (-100000001, 1)],
)
def test_lineage_join_id(spark, tax_id, expected):
    df = spark.createDataFrame([(tax_id,)], "tax_id BIGINT")
    assert df.select(op.lineage_join_id(F.col("tax_id"))).first()[0] == expected


def test_lineage_ranges_are_inclusive_and_repeat_rows(spark):
    lineages = [(573, "a", "A", 3, 5), (573, "b", "B", 1, 3), (573, "c", "C", 4, 5), (574, "d", "D", 1, 5)]
    args = tables(spark, [count_row(tax_id=-200000573)], [(1, 0, "Illumina", 7)], [(7, 3)], lineages)
    scored = op.scored_taxon_counts(*args, now=now(), background_id=1)
    assert sorted(r.genus_name for r in scored.collect()) == ["a", "b"]


def test_run_without_config_has_no_lineage(spark):
    args = tables(spark, [count_row(tax_id=573)], [(1, 0, "Illumina", 8)], [(7, 3)], [(573, "a", "A", 1, 5)])
    [row] = op.scored_taxon_counts(*args, now=now(), background_id=1).collect()
    assert row.genus_name is None
    assert op.run_config(args[1], args[2]).count() == 0


def test_requests_score_exactly_the_requested_pairs(spark, rows):
    args = tables(
        spark,
        [count_row(run=1), count_row(run=2), count_row(run=3)],
        [(r, 0, "Illumina", 7) for r in (1, 2, 3)],
        [(7, 3)],
        [],
        [(1, 10, 1, "NT", 2.0, 5.0, None, None), (2, 10, 1, "NT", 7.0, 5.0, None, None)],
    )
    requests = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "pipeline_run_id BIGINT, background_id BIGINT")
    scored = op.scored_taxon_counts(*args, now=now(), requests=requests)
    assert rows(scored, "pipeline_run_id", "background_id", "zscore") == [(1, 1, 2.0), (1, 2, 1.0), (2, 2, 1.0)]
    with pytest.raises(ValueError):
        op.scored_taxon_counts(*args, now=now())


def test_order_by_taxon_on_request(spark):
    args = tables(spark, [count_row(tax_id=t) for t in (30, -5, 7)])
    ordered = op.scored_taxon_counts(*args, now=now(), background_id=1, ordered=True)
    assert [r.tax_id for r in ordered.collect()] == [-5, 7, 30]


def contig_frame(spark, *contigs):
    return spark.createDataFrame(list(contigs), schemas.CONTIGS)


def test_contig_counts(spark, rows):
    contigs = contig_frame(
        spark,
        (1, 10, None, 10, 10, 0, 5, '{"a":1}'),
        (1, 10, 11, None, 9, None, None, '{"a":1}'),
        (1, 10, 10, 10, 10, 10, 10, None),
        (1, 10, 10, 10, 10, 10, 10, ""),
        (1, 10, 10, 10, 10, 10, 10, "{}"),
    )
    counted = op.contig_counts(op.contig_filter(contigs))
    assert rows(counted, "pipeline_run_id", "tax_id", "count_type", "contigs") == [
        (1, 5, "merged_NT_NR", 1),
        (1, 9, "NT", 1),
        (1, 10, "NT", 3),
        (1, 10, "merged_NT_NR", 1),
        (1, 11, "NR", 1),
    ]


def test_documents(spark):
    counts = [
        count_row(count_type="NT", level=2),
        count_row(count_type="NR", level=1),
        count_row(count_type="NT", level=1),
        count_row(tax_id=0),
        count_row(tax_id=11),
    ]
    args = tables(spark, counts, [(1, 0, "Illumina", 7)], [(7, 3)])
    scored = op.scored_taxon_counts(*args, now=now(), background_id=1)
    documents = op.taxon_documents(scored, contig_frame(spark, (1, 10, 0, 0, 0, 0, 0, '{"a":1}')))
    by_id = {r.doc_id: r for r in documents.collect()}
    assert sorted(by_id) == ["0_1_1_1", "10_1_1_1", "11_1_1_1"]
    metrics = by_id["10_1_1_1"].metric_list
    assert [(m.count_type, m.contigs) for m in metrics] == [("NR", 0), ("NT", 1), ("NT", 1)]
    assert metrics[0].asDict().keys() == set(op.METRIC_FIELDS)


def test_bulk_lines_keep_nulls(spark):
    args = tables(spark, [count_row()], [(1, 0, "Illumina", 7)], [(7, 3)])
    documents = op.taxon_documents(op.scored_taxon_counts(*args, now=now(), background_id=1), contig_frame(spark))
    [line] = sinks.bulk_lines(documents).collect()
    assert line.action == '{"index": {"_index": "scored_taxon_counts", "_id":"10_1_1_1" }} '
    body = json.loads(line.body)
    assert body["common_name"] is None and body["metric_list"][0]["mean"] is None
    assert list(body) == sinks.DOCUMENT_FIELDS


def test_bulk_export_batches(spark, tmp_path):
    args = tables(spark, [count_row(tax_id=t) for t in range(1, 8)])
    documents = op.taxon_documents(op.scored_taxon_counts(*args, now=now(), background_id=1), contig_frame(spark))
    sinks.bulk_export(documents.coalesce(1), str(tmp_path / "bulk"), batch_size=3)
    files = list((tmp_path / "bulk").glob("*.txt"))
    assert sorted(len(f.read_text().splitlines()) for f in files) == [2, 6, 6]


def test_request_validation(spark):
    events = [
        ('{"pipeline_run_id": 1, "background_id": 2}', True),
        ('{"pipeline_run_id": 1.5, "background_id": 2, "es_batchsize": 10, "es_host": "h"}', True),
        ('{"pipeline_run_id": "1", "background_id": 2}', False),
        ('{"background_id": 2}', False),
        ('{"pipeline_run_id": 1, "background_id": null}', False),
        ('{"pipeline_run_id": 1, "background_id": 2, "es_batchsize": "9"}', False),
        ('{"pipeline_run_id": 1, "background_id": 2, "es_host": 3}', False),
        ("[1, 2]", False),
        ("not json", False),
    ]
    checked = op.request_validation(spark.createDataFrame(events, "event STRING, want BOOLEAN")).collect()
    assert [r.is_valid for r in checked] == [r.want for r in checked]
    first, second = checked[:2]
    assert (first.es_batchsize, first.scored_taxon_counts_index_name, first.pipeline_runs_index_name) == (
        1000,
        "scored_taxon_counts",
        "pipeline_runs",
    )
    assert (second.es_batchsize, second.es_host) == (10, "h")


def test_zscores_stay_in_range(spark):
    import __spark_entry__ as entry

    scores = entry.entry(spark)
    outside = scores.filter("NOT (zscore BETWEEN -99 AND 99 OR zscore = 100)")
    assert outside.count() == 0


def test_scored_plan_pushes_columns_and_avoids_loops(spark):
    import __spark_entry__ as entry

    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "l_shipdate" not in plan


def test_requested_documents_move_counts_for_contigs_and_taxa_only(spark):
    """The documents of the scored rows, and no exchange by pair between the join by taxon and the grouping."""
    from taxaflow.plans import scoring_inputs as src
    from taxaflow.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    pairs = src.pipeline_runs(t).selectExpr("id AS pipeline_run_id", "explode(array(1L, 2L)) AS background_id")
    inputs = (src.taxon_counts(t), src.pipeline_runs(t), src.alignment_configs(t), src.taxon_lineages(t), src.taxon_summaries(t))
    want = op.taxon_documents(op.scored_taxon_counts(*inputs, now=now(), requests=pairs), src.contigs(t), pairs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = op.requested_documents(*inputs, src.contigs(t), pairs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert [line for line in plan.split("\n") if "Exchange" in line and "background_id" in line] == []
        found = {r.doc_id: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {r.doc_id: r for r in want.select(*got.columns).collect()}


def test_bulk_files_can_be_compressed(spark, tmp_path):
    args = tables(spark, [count_row(tax_id=t) for t in range(1, 8)])
    documents = op.taxon_documents(op.scored_taxon_counts(*args, now=now(), background_id=1), contig_frame(spark))
    sinks.bulk_export(documents.coalesce(1), str(tmp_path / "bulk"), batch_size=3, compression="gzip")
    assert len(list((tmp_path / "bulk").glob("*.txt.gz"))) == 3
    assert spark.read.text(str(tmp_path / "bulk")).count() == 14


def test_document_ids_need_counts_and_pairs_only(spark, rows):
    """The ids of the documents, an unknown level among them, without a look-up that carries rows."""
    counts = [count_row(level=2), count_row(level=1, count_type="NR"), count_row(tax_id=0, level=None), count_row(tax_id=0), count_row(run=2), count_row(run=3)]
    args = tables(spark, counts, [(1, 0, "Illumina", 7)], [(7, 3)], [(10, "a", "A", 1, 5)])
    requests = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (9, 1)], "pipeline_run_id BIGINT, background_id BIGINT")
    got = op.document_ids(args[0], requests)
    assert rows(got) == rows(op.requested_documents(*args, contig_frame(spark), requests), "doc_id")
    assert rows(got) == [("0_1_1",), ("0_1_2",), ("10_1_1_1",), ("10_1_1_2",), ("10_1_2_2",)]


def scoring_tables(spark):
    from taxaflow.plans import scoring_inputs as src
    from taxaflow.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    return src.taxon_counts(t), src.pipeline_runs(t), src.alignment_configs(t), src.taxon_lineages(t), src.taxon_summaries(t)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Join" in line]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_one_background_by_taxon_moves_counts_once(spark, rows, threshold):
    """The rows of the joins one by one, without a join by count type and level."""
    inputs = scoring_tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        want = op.scored_taxon_counts(*inputs, now=now(), background_id=2)
        got = op.scored_taxon_counts(*inputs, now=now(), background_id=2, by_taxon=True)
        assert not [line for line in joins(got) if "count_type" in line]
        assert got.columns == want.columns and rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_run_configs_come_after_the_move_by_taxon(spark):
    """Counts move with their run's id only: the join that adds config and backgrounds is above the join by taxon."""
    inputs = scoring_tables(spark)
    pairs = inputs[1].selectExpr("id AS pipeline_run_id", "1L AS background_id")
    found = joins(op.scored_taxon_counts(*inputs, now=now(), requests=pairs))
    taxon = next(i for i, line in enumerate(found) if "_taxid" in line)
    assert [line for line in found[:taxon] if "pipeline_run_id" in line and "Inner" in line]
    assert not [line for line in found[taxon:] if "pipeline_run_id" in line and "BroadcastHashJoin" in line and "Inner" in line and "alignment" not in line]


def test_a_model_is_summed_once_for_both_backgrounds(spark):
    summaries = scoring_tables(spark)[4]
    plan = summaries._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "HashAggregate" in line and "background_id" in line.split("functions=")[0]]


def test_bulk_files_are_read_back_in_few_tasks(spark, rows, tmp_path):
    """Many small files share tasks; a document is parsed once, whatever its texts hold."""
    from taxaflow.plans.io_queries import read_bulk

    args = tables(spark, [count_row(tax_id=t) for t in range(1, 201)] + [count_row(tax_id=7, count_type="NR")])
    odd = F.when(F.col("tax_id") == 7, '\n{"index"\n"metric_list": [1], "count_type":').otherwise("plain")
    documents = op.taxon_documents(op.scored_taxon_counts(*args, now=now(), background_id=1), contig_frame(spark)).withColumn("name", odd)
    documents = documents.withColumn("metric_list", F.when(F.col("tax_id") != 8, F.col("metric_list"))).localCheckpoint()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for size in (1, 1000):
            path = str(tmp_path / f"bulk-{size}")
            sinks.bulk_export(documents, path, batch_size=size, compression="gzip")
            got = read_bulk(spark, path)
            assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
            assert rows(got, "doc_id", "action") == rows(sinks.bulk_lines(documents), "doc_id", "action")
            assert rows(got.filter("metrics IS NULL OR metrics > 1"), "doc_id", "metrics") == [("7_1_1_1", 2), ("8_1_1_1", None)]
            assert "json_array_length" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
