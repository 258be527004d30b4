"""Reads, FASTQ lines and sample files projected from documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.positions import with_positions
from taxaflow.session import new_shared_path
from taxaflow.sources.tables import Tables


def reads(t: Tables) -> DataFrame:
    """One read per document; the file is the source and the document id orders it."""
    return t.documents.select(
        F.col("source").alias("file"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("R"), F.col("doc_id"), F.lit("\t00")).alias("header"),
        F.col("text").alias("sequence"),
        "lang",
    )


def dense_reads(t: Tables) -> DataFrame:
    """Read ids with the dense position of each read in its file."""
    ids = t.documents.select(F.col("source").alias("file"), "doc_id")
    return with_positions(ids, ["doc_id"], ["file"], "pos")


def fastq_records(t: Tables) -> DataFrame:
    """Four-line records per source and language; French ones lack a quality value, Spanish ones
    have no separator."""
    return t.documents.select(
        F.concat_ws("_", "source", "lang").alias("file"),
        F.col("doc_id").alias("pos"),
        F.concat(F.when(F.col("source") == "src3", ">").otherwise("@"), F.lit("R"), F.col("doc_id")).alias("header"),
        F.translate("text", "\n\r", "").alias("sequence"),
        F.when(F.col("lang") != "es", "+").alias("plus"),
        F.expr("repeat('@', length(translate(text, '\n\r', '')) - IF(lang = 'fr', 1, 0))").alias("quality"),
    )


def fastq_lines(t: Tables) -> DataFrame:
    """Lines of those records; German sequences are wrapped over two lines."""
    records = fastq_records(t)
    lines = F.when(
        F.col("file").endswith("_de"),
        F.array("header", F.lit("A"), F.lit("C"), "plus", "quality"),
    ).otherwise(F.array("header", F.lit("AC"), "plus", "quality"))
    return records.select("file", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value"))


def sample_files(t: Tables) -> DataFrame:
    """Files of a sample: one per turn, fasta for answers, and fasta or fastq for questions."""
    return t.conversations.selectExpr(
        "concat('sample-', conv_id) AS sample",
        """concat('samples/', conv_id, '/fastqs_', turn, '_', role,
            CASE WHEN role = 'assistant' THEN '.fa' WHEN length(text) % 2 = 0 THEN '.fasta.gz' ELSE '.fastq.gz' END) AS key""",
    )


def write_fasta(t: Tables) -> str:
    """Documents as FASTA text, lines kept, in a folder of their own; returns its path."""
    path = new_shared_path(t.spark, "fasta")
    body = F.regexp_replace(F.translate("text", "\r>", ""), "\n+", "\n")
    t.documents.select(
        F.concat(F.lit(">R"), F.col("doc_id"), F.lit("\t"), F.col("lang"), F.lit("\n"), body).alias("value")
    ).write.text(path)
    return path


def write_fastq(t: Tables) -> str:
    path = new_shared_path(t.spark, "fastq")
    fastq_records(t).select(
        F.concat_ws("\n", "header", "sequence", F.coalesce("plus", F.lit("+")), "quality").alias("value")
    ).write.text(path)
    return path
