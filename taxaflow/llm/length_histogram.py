"""Exact histogram of encoded document lengths, with suffix sums for every context limit.

Every text is encoded; tasks emit (length, documents) pairs, which are summed before the shuffle.
The histogram has a row per distinct length, however many documents there are. Suffix sums come in
two levels, blocks of lengths and lengths in a block, so no task sorts the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import over_slices, strings, whole_text
from taxaflow.llm.vocabulary import codec, tokenizer_path
from taxaflow.session import settle

BLOCK = 1024


def encoded_lengths(path: str):
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = codec(path)
        lengths, documents = np.unique([len(encoder.tokens(t)) for t in strings(batch)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(documents, pa.int64())], names=["n_tokens", "n_docs"])

    return over_slices(count)


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per encoded length: its documents, and suffix sums over all lengths from it on.

    ``docs_from`` and ``tokens_from`` count documents of at least that length and their tokens;
    ``docs_to`` those of at most that length, ``share_to`` the same as a share (the quantile that the
    length answers); ``truncated_total`` is the corpus's tokens when texts are cut at that length. A
    null or empty text has length 0. An empty table gives no rows; repeated rows count each.
    """
    texts = docs.select(whole_text("text").alias("text"))
    pairs = texts.mapInArrow(encoded_lengths(path or tokenizer_path()), "n_tokens long, n_docs long")
    histogram = pairs.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    histogram = settle(histogram)  # used twice below, and a row a length
    histogram = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = histogram.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.join(after, "block")
        .withColumn("docs_from", F.col("docs_after") + F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.col("tokens_after") + F.sum("tokens").over(inside))
        .select(
            "n_tokens",
            "n_docs",
            "docs_from",
            "tokens_from",
            (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_to"),
            (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        )
    )


def total_tokens(histogram: DataFrame) -> int:
    first = histogram.orderBy("n_tokens").limit(1).first()
    return first["tokens_from"] if first else 0


def truncated_totals(histogram: DataFrame, limits: Iterable[int]) -> dict[int, int]:
    """Tokens of the corpus when every text is cut at the limit, for each limit asked."""
    total, answers = total_tokens(histogram), {}
    for limit in limits:
        longer = histogram.where(F.col("n_tokens") > limit).orderBy("n_tokens").limit(1).first()
        answers[limit] = total - longer["tokens_from"] + limit * longer["docs_from"] if longer else total
    return answers


def quantiles(histogram: DataFrame, shares: Iterable[float]) -> dict[float, int | None]:
    """The least length that at least the given share of documents does not exceed."""
    answers = {}
    for share in shares:
        first = histogram.where(F.col("share_to") >= share).orderBy("n_tokens").limit(1).first()
        answers[share] = first["n_tokens"] if first else None
    return answers
