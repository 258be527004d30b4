"""FASTA and FASTQ readers that keep the order of records across file splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxaflow.operators.reads import read_id
from taxaflow.session import pin_file_splits, settle

# A split is four whole numbers; at the default split size this many cover half a petabyte in 128 MB.
BROADCAST_SPLITS = 4_000_000
FASTQ_FIELDS = ["header", "sequence", "plus", "quality"]


def _split_lines(spark: SparkSession, path: str | list[str], line_sep: str) -> DataFrame:
    """Lines with ``file, pos, value`` and the positions ``_from`` to ``_to`` (exclusive) of their split.

    The lines of a split are in order and in one partition.
    """
    pin_file_splits(spark)
    lines = (
        spark.read.option("lineSep", line_sep)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    splits = settle(lines.groupBy("file", "_start").agg(F.count("*").alias("_lines"), F.min("_seq").alias("_first")))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    split = F.xxhash64("file", "_start").alias("_split")
    offsets = splits.select(split, "_lines", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_from"))
    few = splits.count() <= BROADCAST_SPLITS
    local = F.col("_seq") - F.col("_first")
    inside = F.coalesce((local >= 0) & (local < F.col("_lines")), F.lit(False))
    placed = lines.withColumn("_split", split).join(F.broadcast(offsets) if few else offsets, "_split", "left").select(
        "file",
        F.when(inside, F.col("_from") + local)
        .otherwise(F.raise_error(F.lit("file splits changed while reading")).cast("bigint"))
        .alias("pos"),
        "value",
        "_from",
        (F.col("_from") + F.col("_lines")).alias("_to"),
    )
    return placed if few else placed.sortWithinPartitions("file", "pos")


def positioned_lines(spark: SparkSession, path: str | list[str], line_sep: str = "\n") -> DataFrame:
    """Lines as ``file, pos, value`` with the dense position of each line in its file.

    The position is the number of lines in earlier splits plus the place in the split. Both come
    from row numbers inside read tasks, so no text is shuffled. The split counts are settled first;
    a line that does not fall inside its split's count fails the job instead of being misplaced.
    """
    return _split_lines(spark, path, line_sep).select("file", "pos", "value")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA records as ``file, pos, read_id, header, sequence``; wrapped lines are joined."""
    records = positioned_lines(spark, path, "\n>")
    text = F.when(F.col("pos") == 0, F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))
    header = F.rtrim(F.substring_index("_text", "\n", 1))
    body = F.expr("substring(_text, length(substring_index(_text, '\n', 1)) + 1)")
    return records.withColumn("_text", F.translate(text, "\r", "")).select(
        "file",
        "pos",
        read_id(header).alias("read_id"),
        header.alias("header"),
        F.translate(body, "\n", "").alias("sequence"),
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four consecutive lines as one record; a batch's last lines wait for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        whole = table.num_rows - table.num_rows % 4
        held = table.slice(whole)
        if not whole:
            continue
        first = np.arange(0, whole, 4)
        pos = table.column("pos").to_numpy()[:whole].reshape(-1, 4)
        if (pos[:, 0] % 4).any() or (pos != pos[:, :1] + np.arange(4)).any():
            raise ValueError("lines of a split are out of order")
        value = table.column("value")
        yield from pa.table(
            {"file": table.column("file").take(first), "pos": pa.array(pos[:, 0] // 4)}
            | {name: value.take(first + i) for i, name in enumerate(FASTQ_FIELDS)}
        ).to_batches()
    if held is not None and held.num_rows:
        raise ValueError("a split's whole records end in the middle")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTQ records as ``file, pos, read_id, header, sequence, plus, quality``.

    Records are cut by line position, never by looking for ``@``, which quality lines may start with.
    Records inside a split are put together where they are read; only the up to six lines of a split
    whose record crosses its border are shuffled.
    """
    lines = _split_lines(spark, path, "\n").withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))
    record = F.expr("pos div 4")
    crosses = (record * 4 < F.col("_from")) | (record * 4 + 4 > F.col("_to"))
    whole = lines.filter(~crosses).select("file", "pos", "value")
    records = whole.mapInArrow(_records, "file string, pos bigint, header string, sequence string, plus string, quality string")
    parted = lines.filter(crosses).groupBy("file", record.alias("pos")).agg(
        *[F.max(F.when(F.col("pos") % 4 == i, F.col("value"))).alias(f) for i, f in enumerate(FASTQ_FIELDS)]
    )
    return records.unionByName(parted).withColumn("read_id", read_id(F.expr("substring(header, 2)")))
