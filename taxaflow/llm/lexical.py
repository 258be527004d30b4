"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the whole number ``m``, so documents of equal m are
one stratum, in which a term's impact depends on tf alone. The index has a row for every block of a
stratum: its documents and, term by term, its postings with the highest tf first. Impacts are worked
out once for every tf of a block. The highest tf of each term bounds what an item can score in a block.
Every item first visits the block of its highest bound; its k-th score there is a threshold, and of the
other blocks it visits those whose bound reaches it.

Only terms that the items ask for are indexed. Items come in groups of bounded numbers of terms, and a
task holds one group's terms and one block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import LOWER, UPPER, over_slices, strings
from taxaflow.operators.lookups import spread_join
from taxaflow.session import new_shared_path

K = 20
FREQUENCY, SATURATION, BASE, SLOPE = 1_000_000_000, 12, 75, 25
BLOCK_POSTINGS = 1 << 18
GROUP_TERMS = 200_000  # distinct terms of the items searched at once

# Separators and A-Z of the fixed pattern [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, byte by byte.
FOLDED = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


class Items(NamedTuple):
    """One group of items: ids, and per item the numbers of its terms and how often it holds each."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: list[bytes]


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLDED).split()


def item_groups(benchmark: DataFrame, group_terms: int) -> Iterator[list]:
    """The different items, dealt into groups whose terms are bounded by ``group_terms``."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // (2 * group_terms)) or 1  # a term takes two bytes at least, its separator included
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    for group in range(groups):
        yield dealt.where(F.col("group") == group).select("item_id", "text").collect()


def numbered(rows: list) -> Items:
    counts = [Counter(terms_of(r["text"])) for r in rows]
    vocabulary = sorted(set().union(*counts))
    number = {term: i for i, term in enumerate(vocabulary)}
    terms = [np.array([number[t] for t in c], np.int64) for c in counts]
    return Items([r["item_id"] for r in rows], terms, [np.array(list(c.values()), np.int64) for c in counts], vocabulary)


def count_terms(vocabulary: list[bytes]):
    """Function that gives each text's number of terms, and the postings of the vocabulary's terms."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, terms, tfs = [], [], []
        for text in strings(batch):
            found = terms_of(text)
            held = sorted((number[t], n) for t, n in Counter(found).items() if t in number)
            sizes.append(len(found))
            terms.append([t for t, _ in held])
            tfs.append([n for _, n in held])
        kept = [c for c in batch.schema.names if c != "text"]
        made = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "n", "terms", "tfs"])

    return over_slices(cut)


def stratum_block(key: tuple, table: pa.Table) -> pa.Table:
    """Index row of one block: documents, and postings by term, the highest tf first."""
    terms = table.column("terms").combine_chunks()
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    flat, tfs = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
    order = np.lexsort((docs, -tfs, flat))
    flat, docs, tfs = flat[order], docs[order], tfs[order]
    held, starts = np.unique(flat, return_index=True)
    row = {
        "m": [key[0].as_py()],
        "part": [key[1].as_py()],
        "docs": [table.column("doc_id").to_pylist()],
        "terms": [held],
        "starts": [starts.astype(np.int32)],
        "highest": [tfs[starts]],
        "postings": [zstandard.ZstdCompressor(level=1).compress(np.concatenate([docs, tfs]).tobytes())],
    }
    return pa.table(row, schema=INDEX)


NUMBERS = pa.list_(pa.int32())
INDEX = pa.schema(
    {"m": pa.int64(), "part": pa.int64(), "docs": pa.list_(pa.int64()), "terms": NUMBERS, "starts": NUMBERS, "highest": NUMBERS, "postings": pa.binary()}
)
INDEX_SQL = "m long, part long, docs array<long>, terms array<int>, starts array<int>, highest array<int>, postings binary"


def impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    return (FREQUENCY * tfs) // (1000 * tfs + SATURATION * m)


def once_per_tf(tfs: np.ndarray, m: int) -> np.ndarray:
    different, at = np.unique(tfs, return_inverse=True)
    return impacts(different, m)[at]


def ints(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)


def block_bounds(items: Items, weights: np.ndarray):
    """Function over index rows: what every item can score there at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m, part = batch.column("m")[row].as_py(), batch.column("part")[row].as_py()
                most = np.zeros(len(weights), np.int64)
                held = ints(batch, "terms", row)
                most[held] = weights[held] * impacts(ints(batch, "highest", row), m)
                bounds = np.array([int(n @ most[t]) for t, n in zip(items.terms, items.repeats, strict=True)], np.int64)
                asking = np.flatnonzero(bounds > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(asking), m)), pa.array(np.full(len(asking), part)), pa.array(asking.astype(np.int32)), pa.array(bounds[asking])],
                    names=["m", "part", "item", "bound"],
                )

    return run


def visit(items: Items, weights: np.ndarray, k: int):
    """Function over index rows with the items that visit them: each item's best k documents there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m = batch.column("m")[row].as_py()
                docs = batch.column("docs")[row].values
                ids = docs.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                unnamed = docs.is_null().to_numpy(zero_copy_only=False)
                terms, starts = ints(batch, "terms", row), ints(batch, "starts", row)
                places, tfs = np.frombuffer(zstandard.decompress(batch.column("postings")[row].as_py()), np.int32).reshape(2, -1)
                ends = np.append(starts[1:], len(places))
                scored = once_per_tf(tfs.astype(np.int64), m) * np.repeat(weights[terms], ends - starts)
                at_of = dict(zip(terms.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
                found = []
                for item, least in zip(ints(batch, "items", row).tolist(), ints(batch, "leasts", row).tolist(), strict=True):
                    total = np.zeros(len(ids), np.int64)
                    for term, repeats in zip(items.terms[item].tolist(), items.repeats[item].tolist(), strict=True):
                        if term in at_of:
                            start, end = at_of[term]
                            total[places[start:end]] += repeats * scored[start:end]
                    held = np.flatnonzero(total >= max(least, 1))
                    best = held[np.lexsort((ids[held], unnamed[held], -total[held]))[:k]]
                    found.append((item, best, total[best]))
                if found:
                    best = np.concatenate([b for _, b, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.array([i for i, _, _ in found], np.int32), [len(b) for _, b, _ in found])),
                            docs.take(pa.array(best)),
                            pa.array(np.concatenate([s for _, _, s in found])),
                        ],
                        names=["item", "doc_id", "score"],
                    )

    return run


def written(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder as Parquet and read from there."""
    path = new_shared_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def term_weights(postings: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """Weight of every term of the vocabulary by the documents that hold it."""
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(size, np.int64)
    for r in df.collect():  # at most the terms of one group
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return weights


def build_index(postings: DataFrame, m: Column) -> DataFrame:
    """The postings as blocks of strata: documents of equal m, dealt so that a block has about ``BLOCK_POSTINGS`` at most."""
    rows = postings.where("size(terms) > 0").withColumn("m", m)
    sizes = written(rows.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS).alias("parts")), "stratum-sizes")
    rows = spread_join(rows, sizes, ["m"], ["row"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return rows.select("doc_id", "m", "part", "terms", "tfs").groupBy("m", "part").applyInArrow(stratum_block, INDEX_SQL)


def best_per_item(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_group(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """Best k documents of each item of one group, as ``item, rank, doc_id, score``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    counted = texts.mapInArrow(count_terms(items.vocabulary), "doc_id long, row long, n long, terms array<int>, tfs array<int>")
    postings = written(counted, "postings")
    sums = postings.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not sums["docs"]:
        return spark.createDataFrame([], "item int, rank int, doc_id long, score long")
    weights = term_weights(postings, sums["docs"], len(items.vocabulary))
    m = F.lit(BASE) + F.expr(f"({SLOPE}L * n * {sums['docs']}L) div {sums['terms']}L")
    index = written(build_index(postings, m), "strata")
    bounds = written(index.select("m", "part", "terms", "highest").mapInArrow(block_bounds(items, weights), "m long, part long, item int, bound long"), "bounds")

    def visits(pairs: DataFrame) -> DataFrame:
        asked = pairs.groupBy("m", "part").agg(F.collect_list(F.struct("item", "least")).alias("asked"))
        asked = asked.select("m", "part", F.col("asked.item").alias("items"), F.col("asked.least").alias("leasts"))
        rows = index.join(asked, ["m", "part"]).select("m", "docs", "terms", "starts", "postings", "items", "leasts")
        return rows.mapInArrow(visit(items, weights, k), "item int, doc_id long, score long")

    first = bounds.groupBy("item").agg(F.max(F.struct("bound", "m", "part")).alias("b")).select("item", F.col("b.m").alias("m"), F.col("b.part").alias("part"))
    seen = written(visits(first.withColumn("least", F.lit(0).cast("long"))), "first-visits")
    least = seen.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = bounds.join(first, ["item", "m", "part"], "left_anti").join(least, "item", "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).where("bound >= least")
    return best_per_item(seen.unionByName(visits(rest)), k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The k highest-scoring documents of every item as ``item_id, rank, doc_id, score``.

    Every row of ``docs`` is a document of its own, repeated rows too; ties go to the smaller id, a null
    id last. A null or empty text has no terms, counts nowhere and is never found. Items equal in id
    and text are one; an item without terms, or whose terms no document holds, has no rows. An empty
    table on either side gives none. ``k`` is the feature; all other documents are scored or bounded
    below the k-th. Other columns are left out.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = None
    for rows in item_groups(benchmark, group_terms):
        items = numbered(rows)
        if not items.vocabulary:
            continue
        names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
        group = search_group(docs, items, k).join(F.broadcast(names), "item")  # one group's items
        found = group if found is None else found.unionByName(group)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")
