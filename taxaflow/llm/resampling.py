"""Importance resampling towards a target distribution, ranked by a distributed LSD radix sort.

Words are hashed into buckets. How much likelier a bucket is in the target texts than in the corpus is
an array of fixed length, and a document's weight is the mean of its words' entries. A keyed Gumbel
draw is added, so that the documents of the highest sums are a sample without replacement.

The sums are sorted by least-significant-digit counting sort. The composite key is the sum, falling,
and then the id, rising. One pass moves every row to the place

    rows of smaller digits + rows of its digit in earlier blocks + rows of its digit before it in its block

where a block is a run of places. That order is stable, so after the last digit a row's place is its
final rank. Digits that all rows share need no pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import ascii_words, whole_text
from taxaflow.session import settle

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20

DIGIT_BITS = 11
BLOCK_BITS = 16  # places of a block
CELLS_BITS = 12  # cells of the histogram that finds which sums can be drawn at all
SIGN = -(1 << 63)
ALL_ONES = (1 << 64) - 1


def word_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(word.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How many words of all texts fall into each bucket that has any."""
    words = texts.select(F.explode(ascii_words(whole_text("text"))).alias("word"))
    return words.groupBy(word_bucket(F.col("word"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket: 1000 times the log ratio of its smoothed shares in target and corpus."""
    source = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    both = source.join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    counts = {r["bucket"]: (r["s"] or 0, r["t"] or 0) for r in both.collect()}  # at most ``buckets`` rows
    total_s, total_t = (sum(c[i] for c in counts.values()) for i in (0, 1))

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log((t + 1.0) * (total_s + buckets) / ((s + 1.0) * (total_t + buckets))))

    return [gain(*counts.get(b, (0, 0))) for b in range(buckets)]


def weighed(docs: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """Per row its id, number of words, weight (the floored mean gain) and score (weight plus Gumbel draw)."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one array, whatever the rows
    n = F.size("words").cast("long")
    total = F.aggregate("words", F.lit(0).cast("bigint"), lambda done, word: done + F.get(table, word_bucket(word, len(gains))))
    rows = docs.select("doc_id", ascii_words(whole_text("text")).alias("words"))
    rows = rows.select("doc_id", n.alias("n_features"), total.alias("total"))
    rows = rows.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"))


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """``rows`` with ``place`` set by one stable counting sort on the digit; places were any increasing numbers.

    Rows are dealt by block and digit, so no task holds more rows of a digit than a block has. Only
    the counts, one for each block and digit, are summed up in order.
    """
    rows = rows.withColumn("digit", digit).withColumn("block", F.shiftright("place", BLOCK_BITS))
    counts = rows.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).collect()  # at most 2 ** DIGIT_BITS rows
    smaller, base = {}, 0
    for r in sorted(totals, key=lambda r: r["digit"]):
        smaller[r["digit"]] = base
        base += r["n"]
    bases = rows.sparkSession.createDataFrame(list(smaller.items()), "digit long, base long")
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.join(F.broadcast(bases), "digit").select("digit", "block", (F.col("base") + F.coalesce(earlier, F.lit(0))).alias("offset"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place"))
    dealt = rows.withColumn("place_in_block", within - 1)
    moved = dealt.join(offsets, ["block", "digit"])
    return moved.withColumn("place", F.col("offset") + F.col("place_in_block")).drop("digit", "block", "offset", "place_in_block")


def digit_of(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND((1 << DIGIT_BITS) - 1)


def radix_ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order of the unsigned 64-bit ``keys``, the first most significant.

    At least one pass is made, which closes the gaps between the places of the start.
    """
    unsigned = [f(F.conv(F.hex(key), 16, 10).cast("decimal(20,0)")).alias(f"{f.__name__}_{key}") for key in keys for f in (F.min, F.max)]
    bounds = rows.select(*unsigned).first()
    if bounds[0] is None:
        return rows  # no rows
    differing = {key: (int(bounds[f"min_{key}"]) ^ int(bounds[f"max_{key}"])).bit_length() for key in keys}
    digits = [digit_of(F.col(key), shift) for key in reversed(keys) for shift in range(0, differing[key], DIGIT_BITS)]
    for digit in digits or [F.lit(0).cast("long")]:
        rows = settle(counting_pass(rows, digit))
    return rows


def drawable(eligible: DataFrame, draws: int) -> int | None:
    """A score that at least ``draws`` rows reach: the floor of the histogram cell that holds the last draw."""
    ends = eligible.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends["low"] is None or not draws:
        return None
    shift = max(0, (ends["high"] - ends["low"]).bit_length() - CELLS_BITS)
    cell = F.shiftright(F.col("score") - ends["low"], shift)
    cells = eligible.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** CELLS_BITS rows
    held = 0
    for r in sorted(cells, key=lambda r: -r["cell"]):
        held += r["n"]
        if held >= draws:
            return ends["low"] + (r["cell"] << shift)
    return ends["low"]


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """Every row's ``doc_id, n_features, weight, score`` and its ``rank`` among the rows drawn, else null.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn, rounded down. A
    null or empty text has no words and weight 0. A null id counts as the empty text in the draw and
    ranks behind all others of its score. Repeated rows get equal scores and each a rank of its own.
    An empty target gives every document about the same weight; without documents there are no rows.
    Other columns of ``docs`` are left out.
    """
    rows = weighed(docs, bucket_gains(docs, target, buckets), seed).withColumn("place", F.monotonically_increasing_id())
    rows = settle(rows)
    eligible = rows.where(F.col("n_features") >= min_words)
    draws = percent * eligible.count() // 100
    least = drawable(eligible, draws)
    sorted_part = F.lit(False) if least is None else (F.col("n_features") >= min_words) & (F.col("score") >= least)
    undrawn = rows.where(~sorted_part).withColumn("rank", F.lit(None).cast("long"))
    falling = F.bitwise_not(F.col("score").bitwiseXOR(F.lit(SIGN)))
    rising = F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.lit(SIGN)), F.lit(-1).cast("long"))
    ranked = radix_ranked(rows.where(sorted_part).withColumns({"falling": falling, "rising": rising}), ["falling", "rising"])
    ranked = ranked.withColumn("rank", F.when(F.col("place") < draws, F.col("place") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return undrawn.select(*columns).unionByName(ranked.select(*columns))
