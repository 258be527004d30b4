"""Exact top-k inner products by MaxScore over vector shards.

A dimension is a query term and a vector's component its posting. In a shard every term has a lowest
and a highest possible contribution; what lies above the lowest is the term's impact. Terms are split
where the impact bounds of the smaller ones, summed, cannot lift a vector over the threshold: the
others are essential and are traversed for all vectors, the rest is probed, largest bound first, only
for vectors that can still compete. Shards stay where they are and are moved once; the queries, which
are few beside them, are repeated to every shard. A task keeps the threshold that each query reached in
its earlier shards, and the shards' best rows are merged by score and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_CELLS = 1 << 21  # components of a shard, 16 MB
QUERY_ROWS = 1024
SEED_ROWS = 256
PROBE_TERMS = 8


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as ``floor(scale * x)``; null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition as one block: its number, ids, and a row-major matrix."""
    from pyspark import TaskContext

    ids, vectors = [], []
    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        vectors += batch.column("vector").to_pylist()
    if not ids:
        return
    width = max(map(len, vectors))
    matrix = np.zeros((len(ids), width), np.int64)  # a shorter vector counts as ending in zeros
    for row, vector in enumerate(vectors):
        matrix[row, : len(vector)] = vector
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([width], pa.int32()), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())],
        names=["block", "width", "ids", "matrix"],
    )


def blocks(rows: DataFrame, number: int) -> DataFrame:
    """Rows in so many numbered blocks of about equal size."""
    return rows.repartition(number).mapInArrow(pack, "block int, width int, ids binary, matrix binary")


def best_of(query: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int, least: int):
    """Places and scores of the k best columns of ``terms`` (dimension x vector) that reach ``least``, ties to the smaller id."""
    reach = np.sort(np.stack([query * low, query * high]), axis=0)
    base, impact = int(reach[0].sum()), reach[1] - reach[0]
    order = np.argsort(impact, kind="stable")  # smallest bound first
    below = np.cumsum(impact[order])

    others = np.flatnonzero(ids != own)
    seed, rest = others[:SEED_ROWS], others[SEED_ROWS:]
    places, scores = seed, query @ terms[:, seed]
    if len(rest) and len(seed) >= k:
        threshold = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        split = int(np.searchsorted(below, threshold - base, side="left"))  # terms before it cannot reach the threshold alone
        essential, probed = order[split:], order[:split][::-1]
        partial = np.zeros(terms.shape[1], np.int64)
        for term in essential:
            partial += query[term] * terms[term]
        partial = partial[rest]
        for at in range(0, len(probed), PROBE_TERMS):
            left = probed[at:]
            bound = partial + int(reach[1][left].sum())
            alive = bound >= threshold
            rest, partial = rest[alive], partial[alive]
            step = probed[at : at + PROBE_TERMS]
            partial = partial + query[step] @ terms[np.ix_(step, rest)]
        alive = partial >= threshold
        places, scores = np.concatenate([seed, rest[alive]]), np.concatenate([scores, partial[alive]])
    elif len(rest):
        places, scores = others, query @ terms[:, others]
    places, scores = places[scores >= least], scores[scores >= least]
    chosen = np.lexsort((ids[places], -scores))[:k]
    return places[chosen], scores[chosen]


def check_range(shard: np.ndarray, asked: np.ndarray) -> None:
    """Fail where a score might not fit 64 bits, rather than give a wrong one."""
    most = [int(max(-m.min(initial=0), m.max(initial=0))) for m in (shard, asked)]
    if most[0] * most[1] * shard.shape[1] >= 1 << 63:
        raise OverflowError("components are too large for 64-bit scores")


def search_pairs(k: int):
    """Function over pairs of a query block and a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, np.ndarray] = {}  # by query block, each query's k-th score in the shards before
        for batch in batches:
            for pair in batch.to_pylist():
                width = max(pair["width"], pair["q_width"])
                ids, queries = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
                shard, asked = np.zeros((len(ids), width), np.int64), np.zeros((len(queries), width), np.int64)
                shard[:, : pair["width"]] = np.frombuffer(pair["matrix"], np.int64).reshape(len(ids), -1)
                asked[:, : pair["q_width"]] = np.frombuffer(pair["q_matrix"], np.int64).reshape(len(queries), -1)
                check_range(shard, asked)
                terms = np.ascontiguousarray(shard.T)
                low, high = shard.min(axis=0), shard.max(axis=0)
                least = reached.setdefault(pair["q_block"], np.full(len(queries), np.iinfo(np.int64).min))
                found = [best_of(q, terms, low, high, ids, int(own), k, int(bar)) for q, own, bar in zip(asked, queries, least, strict=True)]
                least[:] = [max(bar, scores[-1]) if len(scores) == k else bar for bar, (_, scores) in zip(least, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(queries, [len(p) for p, _ in found]), pa.int64()),
                        pa.array(np.concatenate([ids[p] for p, _ in found]), pa.int64()),
                        pa.array(np.concatenate([s for _, s in found]), pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best rows of every query row by integer inner product, ties to the smaller ``vec_id``.

    Rows with a null id, or whose vector is null or holds a null or non-finite component, take no
    part. Every row but those of the query's own id is a candidate, repeated rows each on their own;
    a query id that repeats is asked once, with its least vector. Vectors of unequal length count as
    ending in zeros. Components so large that a score might not fit 64 bits fail the search. ``k`` is
    the feature; nothing else is cut.
    """
    rows = embeddings.select("vec_id", scaled(F.col("embedding"), scale).alias("vector"), is_query.alias("asked"))
    rows = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL")
    asked = rows.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width"), F.count_if("asked").alias("asked")).first()
    n_shards = max(1, -(-sizes["rows"] * (sizes["width"] or 0) // SHARD_CELLS))
    shards = blocks(rows.select("vec_id", "vector"), n_shards)
    queries = blocks(asked, max(1, -(-sizes["asked"] // QUERY_ROWS)))
    queries = queries.select(F.col("block").alias("q_block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    repeated = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    found = shards.join(repeated, "block").mapInArrow(search_pairs(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
