"""Shared pieces of the corpus operators: folds, words, and batches of bounded size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text bytes that a task turns into numpy arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text(text: Column | str) -> Column:
    """The text with null as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as SQL expressions."""
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, whose session hands rows to Python about ``SLICE_BYTES`` at a time if it has no bound of its own.

    Spark's bound is 10,000 rows or 64 MB. A batch is held several times: in its vectors beside the heap, which
    grow by doubling, in the message to Python, and in the worker, which keeps freed memory for later ones.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of one column, so that a task's arrays stay small whatever the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def over_slices(cut, column: str = "text"):
    """A mapInArrow function that applies ``cut(batch) -> RecordBatch | None`` to every slice."""

    @functools.wraps(cut)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = cut(part)
                if made is not None and made.num_rows:
                    yield made

    return run


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
