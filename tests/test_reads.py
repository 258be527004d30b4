from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from taxaflow.operators import reads as op
from taxaflow.sources import reads as files


def bases(length, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(length))


def fasta(spark, tmp_path, *records, end="\n"):
    path = tmp_path / "reads.fa"
    path.write_text("\n".join(f">{h}\n{s}" for h, s in records) + end)
    return files.read_fasta(spark, str(path))


def fastq_text(*sequences):
    return "".join(f"@R{i} 1:N:0\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(sequences))


def test_dedup_without_duplicates(spark, tmp_path):
    records = [("MOCK_READ_ONE\t00", bases(150, 1)), ("MOCK_READ_TWO\t00", bases(53, 2)), ("MOCK_READ_THREE\t00", bases(150, 3))]
    reads = fasta(spark, tmp_path, *records, end="")
    kept = op.dedup_reads(reads).orderBy("pos").collect()
    assert [r.header for r in kept] == ["MOCK_READ_ONE 00", "MOCK_READ_TWO 00", "MOCK_READ_THREE 00"]
    assert [r.sequence for r in kept] == [s for _, s in records]
    lines = [r.line for r in op.duplicate_clusters(reads).orderBy("pos").collect()]
    assert lines == ["1\tMOCK_READ_ONE", "1\tMOCK_READ_TWO", "1\tMOCK_READ_THREE"]


def test_dedup_with_duplicates(spark, tmp_path, rows):
    one, two = bases(150, 1), bases(150, 2)
    reads = fasta(spark, tmp_path, ("MOCK_READ_ONE\t00", one), ("MOCK_READ_ONE_DUP\t00", one), ("MOCK_READ_TWO\t00", two))
    assert [r.header for r in op.dedup_reads(reads).orderBy("pos").collect()] == ["MOCK_READ_ONE 00", "MOCK_READ_TWO 00"]
    assert [r.line for r in op.duplicate_clusters(reads).orderBy("pos").collect()] == ["2\tMOCK_READ_ONE", "1\tMOCK_READ_TWO"]
    assert rows(op.cluster_members(reads), "read_id", "representative") == [
        ("MOCK_READ_ONE", "MOCK_READ_ONE"),
        ("MOCK_READ_ONE_DUP", "MOCK_READ_ONE"),
        ("MOCK_READ_TWO", "MOCK_READ_TWO"),
    ]


def test_hot_sequence_keeps_its_first_read(spark):
    """Most reads of one file are equal; every file is deduplicated on its own."""
    reads = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("file"),
        F.col("id").alias("pos"),
        F.concat(F.lit("r"), F.col("id"), F.lit(" x")).alias("header"),
        F.when(F.col("id") % 10 < 8, "AAAA").otherwise(F.col("id").cast("string")).alias("sequence"),
    )
    kept = {(r.file, r.sequence): (r.pos, r.cluster_size) for r in op.dedup_reads(reads.repartition(6)).collect()}
    assert kept["a", "AAAA"] == (1, 3900) and kept["b", "AAAA"] == (0, 100)
    assert len(kept) == 1002
    members = op.cluster_members(reads.repartition(6))
    assert members.count() == 5000 and members.select("file", "pos").distinct().count() == 5000
    assert members.filter("representative = 'r1'").count() == 3900
    assert members.filter("representative = 'r0' AND file = 'b'").count() == 100


def fastq_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_cut_by_split_borders(spark, tmp_path, rows, monkeypatch):
    """Many small splits: records that cross borders come whole, and no whole record is shuffled."""
    rng = random.Random(11)
    sequences = [bases(rng.randint(1, 90), i) for i in range(400)]
    (tmp_path / "a.fastq").write_text(fastq_text(*sequences))
    (tmp_path / "b.fastq").write_text(fastq_text(*sequences[:7]))
    changed = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        want = [(f, i, s) for f, n in (("a.fastq", 400), ("b.fastq", 7)) for i, s in enumerate(sequences[:n])]
        for bound in (files.BROADCAST_SPLITS, 0):
            monkeypatch.setattr(files, "BROADCAST_SPLITS", bound)
            records = files.read_fastq(spark, str(tmp_path))
            assert rows(records, F.substring_index("file", "/", -1), "pos", "sequence") == want
            assert records.filter("header <> concat('@', read_id, ' 1:N:0') OR plus <> '+' OR length(quality) <> length(sequence)").count() == 0
    finally:
        for key in changed:
            spark.conf.unset(key)


def test_no_exchange_above_whole_lines(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(fastq_text(*[bases(40, i) for i in range(50)]))
    plan = fastq_plan(files.read_fastq(spark, str(tmp_path)))
    whole = plan[plan.index("MapInArrow") : plan.index("SortAggregate") if "SortAggregate" in plan else plan.index("HashAggregate", plan.index("MapInArrow"))]
    assert "Exchange hashpartitioning" not in whole.split("BroadcastExchange")[0]


def test_length_summary_of_both_mates(spark, tmp_path):
    sequences = [bases(150, i) for i in range(5)] + [bases(10, 7), bases(10, 8), bases(600, 9)]
    for mate in ("one", "two"):
        (tmp_path / f"{mate}.fastq").write_text(fastq_text(*sequences))
    [summary] = op.read_length_summary(files.read_fastq(spark, str(tmp_path))).collect()
    assert summary.asDict() == {"<50": 4, "50-500": 10, "500-10000": 2, "10000+": 0}


@pytest.mark.parametrize(("length", "label"), [(49, "<50"), (50, "50-500"), (499, "50-500"), (500, "500-10000"), (9999, "500-10000"), (10000, "10000+")])
def test_length_bounds(spark, length, label):
    frame = spark.createDataFrame([("A" * length,)], "sequence STRING")
    assert {k: v for k, v in op.read_length_summary(frame).first().asDict().items() if v} == {label: 1}


def test_wrapped_fastq_is_rejected(spark, tmp_path):
    path = tmp_path / "multi.fastq"
    path.write_text("@R0\nAAAA\nCC\n+\nIIII\nII\nIII\n")
    lines = files.positioned_lines(spark, str(path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    [row] = op.fastq_validity(lines).collect()
    assert (row.valid, row.error) == (False, "InvalidFileFormatError")
    assert row.cause == "The .fastq file multi.fastq has an invalid number of lines."


def test_invalid_records(spark, rows):
    records = spark.createDataFrame(
        [(0, "@a", "AC", "+", "II"), (1, "a", "AC", "+", "II"), (2, "@a", "AC", "-", "II"), (3, "@a", "AC", "+", "I"), (4, "@a", "AC", None, None)],
        "pos BIGINT, header STRING, sequence STRING, plus STRING, quality STRING",
    )
    assert rows(op.invalid_records(records), "pos", "reason") == [(1, "header"), (2, "separator"), (3, "quality length"), (4, "separator")]


@pytest.fixture()
def small_splits(spark):
    changed = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1000"}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


def test_fastq_over_many_splits(spark, tmp_path, small_splits):
    """Records straddle splits, and quality lines start with the header mark."""
    sequences = {name: [bases(random.Random(i).randint(1, 90), i) for i in range(n)] for name, n in (("a", 400), ("b", 150))}
    for name, seqs in sequences.items():
        (tmp_path / f"{name}.fastq").write_text(fastq_text(*seqs))
    reads = files.read_fastq(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = {(r.file.split("/")[-1][0], r.pos): r for r in reads.collect()}
    assert len(got) == 550
    for name, seqs in sequences.items():
        for i, sequence in enumerate(seqs):
            row = got[name, i]
            assert (row.read_id, row.header, row.sequence, row.plus, row.quality) == (f"R{i}", f"@R{i} 1:N:0", sequence, "+", "@" * len(sequence))


def test_fasta_over_many_splits(spark, tmp_path, small_splits):
    """Wrapped sequences keep their order."""
    sequences = [bases(random.Random(i).randint(1, 300), i) for i in range(200)]
    wrapped = ["\n".join(s[j : j + 60] for j in range(0, len(s), 60)) for s in sequences]
    reads = fasta(spark, tmp_path, *[(f"R{i} x>y", s) for i, s in enumerate(wrapped)])
    got = reads.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(200))
    assert [(r.read_id, r.header, r.sequence) for r in got] == [(f"R{i}", f"R{i} x>y", s) for i, s in enumerate(sequences)]


def test_gzipped_fastq_and_windows_line_ends(spark, tmp_path):
    (tmp_path / "r.fastq.gz").write_bytes(gzip.compress(fastq_text("ACGT", "GG").replace("\n", "\r\n").encode()))
    got = files.read_fastq(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.sequence, r.quality) for r in got] == [("ACGT", "@@@@"), ("GG", "@@")]


def test_cap_fragments(spark, tmp_path):
    (tmp_path / "r.fastq").write_text(fastq_text(*["ACGT"] * 9))
    reads = files.read_fastq(spark, str(tmp_path))
    assert sorted(r.pos for r in op.cap_fragments(reads, 4).collect()) == [0, 1, 2, 3]
    assert op.cap_fragments(reads).count() == 9


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["a.fasta", "b.fa"], "fasta"),
        (["a.fasta.gz", "b.fa.gz"], "fasta"),
        (["a.fasta", "b.fastq"], "fastq"),
        (["a.fa.zip"], "fastq"),
        (["afa"], "fastq"),
    ],
)
def test_input_format(spark, rows, names, expected):
    frame = spark.createDataFrame([("s", n) for n in names], "sample STRING, key STRING")
    assert op.input_format(frame).first().format == expected
    assert rows(op.input_names(frame), "key", "input_name") == [(n, f"fastqs_{i}") for i, n in enumerate(sorted(names))]
