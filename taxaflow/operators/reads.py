"""Sequencing reads: exact deduplication, length summary, format checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.positions import with_positions
from taxaflow.session import settle

# Fixed values of read handling.
LENGTH_BOUNDS = [50, 500, 10000]
LENGTH_LABELS = ["<50", "50-500", "500-10000", "10000+"]
MAX_FRAGMENTS = 75_000_000
FORMAT_ERROR = "InvalidFileFormatError"
FASTA_FILE = r"\.(fasta|fa)(\.gz)?$"


def read_id(header: Column) -> Column:
    """Header up to its first white space."""
    return F.regexp_extract(header, r"^(\S*)", 1)


def sequence_key(sequence: Column) -> Column:
    return F.unhex(F.sha2(sequence, 256))


def _clusters(reads: DataFrame) -> DataFrame:
    """First position and size of each group of equal sequences in a file.

    Only the digest, the position and the count are shuffled, combined before the shuffle, so a
    sequence that makes up most of a file costs one row per task.
    """
    return reads.groupBy("file", sequence_key(F.col("sequence")).alias("sequence_key")).agg(
        F.min("pos").alias("pos"), F.count("*").alias("cluster_size")
    )


def dedup_reads(reads: DataFrame) -> DataFrame:
    """First read of each distinct sequence per file, in input order by ``pos``.

    A tab in the header becomes a space.
    """
    return (
        reads.join(_clusters(reads), ["file", "pos"])
        .withColumn("header", F.translate("header", "\t", " "))
        .select("file", "pos", "header", "sequence", "cluster_size")
    )


def duplicate_clusters(reads: DataFrame) -> DataFrame:
    """Size and representative of each cluster, with the line of the cluster size file."""
    first = reads.select("file", "pos", read_id(F.col("header")).alias("representative"))
    return first.join(_clusters(reads), ["file", "pos"]).select(
        "file",
        "pos",
        "sequence_key",
        "representative",
        "cluster_size",
        F.concat_ws("\t", F.col("cluster_size").cast("string"), "representative").alias("line"),
    )


def cluster_members(reads: DataFrame) -> DataFrame:
    """Every read with the representative of its cluster.

    Digests are made once. A read without duplicates represents itself and takes no part in the
    join, whose sides are both settled, so Spark can split a cluster that is hot.
    """
    narrow = settle(
        reads.select(
            "file", "pos", read_id(F.col("header")).alias("read_id"), sequence_key(F.col("sequence")).alias("sequence_key")
        )
    )
    clusters = settle(
        narrow.groupBy("file", "sequence_key").agg(F.min(F.struct("pos", "read_id")).alias("first"), F.count("*").alias("size"))
    )
    alone = clusters.filter("size = 1").select("file", "first.pos", "first.read_id", F.col("first.read_id").alias("representative"))
    shared = clusters.filter("size > 1").select("file", "sequence_key", F.col("first.read_id").alias("representative"))
    joined = narrow.join(shared, ["file", "sequence_key"])
    return alone.unionByName(joined.select("file", "pos", "read_id", "representative"))


def read_length_summary(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads per length bucket, lower bound inclusive, empty buckets 0."""
    n = F.length("sequence")
    low, mid, high = LENGTH_BOUNDS
    tests = [n < low, (n >= low) & (n < mid), (n >= mid) & (n < high), n >= high]
    return reads.groupBy(*by).agg(*[F.count_if(test).alias(label) for test, label in zip(tests, LENGTH_LABELS)])


def fastq_validity(lines: DataFrame) -> DataFrame:
    """Per file whether its lines make whole four-line records; ``lines`` has ``file``."""
    broken = F.col("lines") % 4 != 0
    return (
        lines.groupBy("file")
        .agg(F.count("*").alias("lines"))
        .select(
            "file",
            "lines",
            (~broken).alias("valid"),
            F.when(broken, FORMAT_ERROR).alias("error"),
            F.when(
                broken, F.format_string("The .fastq file %s has an invalid number of lines.", F.col("file"))
            ).alias("cause"),
        )
    )


def invalid_records(records: DataFrame) -> DataFrame:
    """Four-line records that break the format, with the first rule they break."""
    reason = (
        F.when(~F.coalesce(F.col("header").startswith("@"), F.lit(False)), "header")
        .when(~F.coalesce(F.col("plus").startswith("+"), F.lit(False)), "separator")
        .when(
            ~F.coalesce(F.length("sequence") == F.length("quality"), F.lit(False)), "quality length"
        )
    )
    return records.withColumn("reason", reason).filter("reason IS NOT NULL")


def cap_fragments(reads: DataFrame, max_fragments: int = MAX_FRAGMENTS) -> DataFrame:
    """The first fragments of each file by their dense position."""
    return reads.filter(F.col("pos") < max_fragments)


def input_format(files: DataFrame) -> DataFrame:
    """Format of each sample: fasta when all its files are; ``files`` has ``sample, key``."""
    return files.groupBy("sample").agg(
        F.count("*").alias("files"),
        F.when(F.bool_and(F.col("key").rlike(FASTA_FILE)), "fasta").otherwise("fastq").alias("format"),
    )


def input_names(files: DataFrame) -> DataFrame:
    """Files of each sample as ``fastqs_0``, ``fastqs_1``... in key order."""
    placed = with_positions(files.select("sample", "key"), ["key"], ["sample"])
    return placed.select("sample", "key", F.concat(F.lit("fastqs_"), F.col("position")).alias("input_name"))
