"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document becomes a few statistics of its whole text. Random Fourier features of the standardised
statistics approximate a Gaussian kernel. Each task sums its products of features; Spark adds the
sums cell by cell, so the driver sees only matrices of fixed size. The sums are kept by fold of the
training rows and for a few kernel widths: width and ridge are those of the least squared error on the
folds left out, which follows from the same sums. Scores of labelled training documents are counted on a
fixed grid and calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import over_slices, small_batches, strings, whole_text
from taxaflow.session import settle

FEATURES = 160
WIDTHS = (0.5, 1.0, 2.0, 4.0)  # of the Gaussian kernel, in standard deviations of a statistic and per root of their number
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)  # both tried on folds of the training rows
FOLDS = 4
SEED = 20
BLOCK = 1000  # rows whose features a task holds at a time
GRID = 1000  # calibration cells per unit of raw score

STATISTICS = [
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "stops", "symbols", "bars", "marks", "distinct_words",
    "repeats", "top_word", "distinct_lines", "log_line", "word_symbols", "lone_symbols", "non_ascii",
]

LETTERS = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
CAPITALS = np.array([65 <= b <= 90 for b in range(256)])
DIGITS = np.array([48 <= b <= 57 for b in range(256)])
STOPS = np.array([b in b".,;:\"'()-?" for b in range(256)])
BLANKS = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
SYMBOLS = ~(LETTERS | DIGITS | STOPS | BLANKS)


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, in the order of ``STATISTICS``; all zero when it is empty."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    bytes_of = np.bincount(data, minlength=256)
    n_bytes, n_words = len(data), len(words)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in text.split("\n") if line.strip()]
    symbols = SYMBOLS[data]
    ends = np.flatnonzero(symbols & np.append(BLANKS[data[1:]], True))
    starts = np.concatenate([[True], BLANKS[data[:-1]]])
    return [
        math.log1p(n_bytes),
        math.log1p(n_words),
        len(text) / n_words,
        bytes_of[LETTERS].sum() / n_bytes,
        bytes_of[CAPITALS].sum() / n_bytes,
        bytes_of[DIGITS].sum() / n_bytes,
        bytes_of[STOPS].sum() / n_bytes,
        bytes_of[SYMBOLS].sum() / n_bytes,
        bytes_of[ord("|")] / n_words,
        bytes_of[ord("!")] / n_words,
        len(counts) / n_words,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words,
        max(counts.values()) / n_words,
        len(set(lines)) / len(lines),
        math.log1p(n_bytes / len(lines)),
        len(ends) / n_words,
        int(starts[ends].sum()) / n_words,
        int((data > 127).sum()) / n_bytes,
    ]


class Model(NamedTuple):
    """Scaling of the statistics, kernel width, ridge weights and calibration steps."""

    mean: np.ndarray
    spread: np.ndarray
    width: float
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray


def frequencies(width: int = len(STATISTICS), features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.normal(0, 1 / math.sqrt(width), (width, features)), draw.uniform(0, 2 * math.pi, features)


def fourier(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray, width: float) -> np.ndarray:
    """Fourier features of the scaled statistics for a kernel width, with a constant last."""
    directions, phases = frequencies()
    scaled = np.clip((rows - mean) / spread, -8, 8)
    waves = math.sqrt(2 / FEATURES) * np.cos(scaled @ directions / width + phases)
    return np.hstack([waves, np.ones((len(rows), 1))])


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows a few at a time: their features are many times the size of the batch."""
    for batch in batches:
        yield from (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK))


def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = pa.array([statistics(t) for t in strings(batch)], pa.list_(pa.float64()))
    kept = [c for c in batch.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), rows], names=[*kept, "stats"])


def products(mean: np.ndarray, spread: np.ndarray):
    """Function that sums the products of a partition's features and labels, a row per fold, width and matrix cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = FEATURES + 2
        total, rows = np.zeros((FOLDS, len(WIDTHS), side, side)), 0
        for batch in blocks(batches):
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False).reshape(-1, 1)
            for w, width in enumerate(WIDTHS):
                both = np.hstack([fourier(stacked(batch), mean, spread, width), label])
                for fold in np.unique(folds):
                    part = both[folds == fold]
                    total[fold, w] += part.T @ part
            rows += len(folds)
        if rows:
            upper = np.triu_indices(side)
            cells = upper[0] * side + upper[1]
            for fold in range(FOLDS):
                for w in range(len(WIDTHS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cells), fold * len(WIDTHS) + w, np.int32)), pa.array(cells, pa.int32()), pa.array(total[fold, w][upper], pa.float64())],
                        names=["part", "cell", "value"],
                    )

    return run


def solved(matrix: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the summed products of features and label; the constant is not penalised."""
    rows = matrix[-2, -2]  # the constant's square, summed
    penalty = ridge * rows / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(matrix[:-1, :-1] + penalty, matrix[:-1, -1])


def squared_error(matrix: np.ndarray, weights: np.ndarray) -> float:
    """Sum of squared errors of the weights on the rows whose products were summed."""
    return float(weights @ matrix[:-1, :-1] @ weights - 2 * weights @ matrix[:-1, -1] + matrix[-1, -1])


def chosen(parts: np.ndarray) -> tuple[int, float]:
    """Place of the width, and the ridge, of least squared error on folds left out; ``parts`` by fold and width."""
    errors = {}
    for w in range(len(WIDTHS)):
        whole = parts[:, w].sum(axis=0)
        for ridge in RIDGES:
            errors[w, ridge] = sum(squared_error(part, solved(whole - part, ridge)) for part in parts[:, w] if (whole - part)[-2, -2] > 0)
    return min(errors, key=errors.get)


def raw_cells(mean: np.ndarray, spread: np.ndarray, width: float, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw = fourier(stacked(batch), mean, spread, width) @ weights
            cells = np.round(np.clip(raw, -1, 2) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch.column("label")], names=["cell", "label"])

    return run


def pooled(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Nondecreasing means by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, cells
    for value, count in zip(values, counts, strict=True):
        blocks.append([value, count, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            last, before = blocks.pop(), blocks[-1]
            weight = before[1] + last[1]
            before[0] = (before[0] * before[1] + last[0] * last[1]) / weight
            before[1], before[2] = weight, before[2] + last[2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> Model:
    """Model learned from the documents that ``train`` marks and ``labels`` covers.

    Labels of one document that differ, or null labels: the largest non-null one counts. All labelled
    training rows are used, and nothing else is learned from or tried on. Rows of equal statistics are in
    one fold. Without any row, the model scores 0.5 everywhere.
    """
    width = len(STATISTICS)
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    texts = small_batches(docs).where(train).select("doc_id", whole_text("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    stats = texts.mapInArrow(over_slices(describe), f"doc_id {kind}, stats array<double>")
    rows = settle(stats.join(marks, "doc_id").select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")))
    moments = rows.select(*(f(F.col("stats")[i]).alias(f"{f.__name__}_{i}") for f in (F.avg, F.stddev_pop) for i in range(width)), F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        return Model(np.zeros(width), np.ones(width), 1.0, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array([moments[f"avg_{i}"] for i in range(width)])
    spread = np.array([moments[f"stddev_pop_{i}"] for i in range(width)])
    spread = np.where(spread > 1e-9, spread, 1.0)
    summed = rows.mapInArrow(products(mean, spread), "part int, cell int, value double").groupBy("part", "cell").agg(F.sum("value").alias("value"))
    parts = np.zeros((FOLDS * len(WIDTHS), (FEATURES + 2) ** 2))
    found = summed.toArrow()  # FOLDS x widths x cells rows, whatever the input
    parts[found.column("part").to_numpy(), found.column("cell").to_numpy()] = found.column("value").to_numpy()
    parts = parts.reshape(FOLDS, len(WIDTHS), FEATURES + 2, FEATURES + 2)
    parts = np.triu(parts) + np.triu(parts, 1).swapaxes(-1, -2)
    best, ridge = chosen(parts)
    weights = solved(parts[:, best].sum(axis=0), ridge)
    raw = rows.mapInArrow(raw_cells(mean, spread, WIDTHS[best], weights), "cell int, label double")
    grid = raw.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("label")).orderBy("cell").collect()
    counts = np.array([r["n"] for r in grid], float)
    levels = pooled(np.array([r["label"] for r in grid]), counts)
    return Model(mean, spread, WIDTHS[best], weights, np.array([r["cell"] / GRID for r in grid]), levels)


def apply_model(model: Model):
    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t) for t in strings(batch)]).reshape(-1, len(STATISTICS))
        raw = fourier(rows, model.mean, model.spread, model.width) @ model.weights
        scores = np.clip(np.interp(raw, model.steps, model.levels), 0, 1)
        names = [c for c in batch.schema.names]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
            names=[*names, "score", "predicted"],
        )

    return over_slices(judge)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, which has a ``text`` column, with ``score`` (0 to 1) and ``predicted`` (0 or 1) behind its columns.

    A null or empty text is scored by its zero statistics. Repeated rows get equal scores. Columns
    named ``score`` or ``predicted`` must be dropped or renamed first.
    """
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return small_batches(docs).mapInArrow(apply_model(model), f"{kinds}, score double, predicted int")
