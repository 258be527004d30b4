"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the ranking of the most frequent 1- to 3-grams over letters, with one blank for any run
of other characters. A text takes the language whose profile its own ranking is least out of place
with. Profiles are learned from a sample of the different training texts whose size per language is
an argument; every text is judged whole.
"""

from __future__ import annotations

import functools
import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import over_slices, strings, whole_text
from taxaflow.session import settle

PROFILE_GRAMS = 400
TRAIN_ROWS = 4000  # most training texts per language
UNKNOWN = "und"
BLANK = 32
LEAST_HASH, MOST_HASH = -(1 << 63), (1 << 63) - 1


class Profiles(NamedTuple):
    """Languages in order, the sorted n-grams of all profiles, and each language's rank of them."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def ngrams(text: str) -> np.ndarray:
    """1- to 3-grams of the lower-cased letters as integers; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes = np.where(is_letter, codes, BLANK)
    codes = np.concatenate([[BLANK], codes, [BLANK]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    pairs = codes[:-1] << 21 | codes[1:]
    triples = pairs[:-1] << 21 | codes[2:]
    return np.concatenate([codes[codes != BLANK], pairs, triples])


def ranking(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties by n-gram."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    by_language: dict[str, list[np.ndarray]] = {}
    for text, language in zip(strings(batch), batch.column("lang").to_pylist(), strict=True):
        by_language.setdefault(language, []).append(ngrams(text))
    names, grams, counts = [], [], []
    for language, lists in by_language.items():
        found, times = np.unique(np.concatenate(lists), return_counts=True)
        names += [language] * len(found)
        grams.append(found)
        counts.append(times)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(np.concatenate(grams), pa.int64()), pa.array(np.concatenate(counts), pa.int64())],
        names=["lang", "gram", "n"],
    )


def hash_cuts(hashes: DataFrame, found: dict[str, int], rows: int) -> dict[str, int]:
    """Per language of ``found``, the hash of its ``rows``-th text by hash, or the largest one.

    ``hashes`` has the different (lang, hash) and ``found`` their number. Hashes are ranked only
    up to where about twice ``rows`` are expected, further up while that is too few.
    """
    cuts = dict.fromkeys(found, MOST_HASH)
    asked = {lang: 2 * rows + 64 for lang, n in found.items() if n > rows}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    while asked:
        tried = F.create_map(*(F.lit(x) for lang, n in asked.items() for x in (lang, min(MOST_HASH, LEAST_HASH + (n << 64) // found[lang]))))
        ranked = hashes.where(F.col("hash") <= F.element_at(tried, F.col("lang"))).withColumn("rank", rank)
        for r in ranked.where(F.col("rank") == rows).collect():
            cuts[r["lang"]] = r["hash"]
            del asked[r["lang"]]
        asked = {lang: 4 * n for lang, n in asked.items()}
    return cuts


def learn_profiles(docs: DataFrame, train: Column, *, rows: int = TRAIN_ROWS, size: int = PROFILE_GRAMS) -> Profiles:
    """Profiles of the languages of the rows that ``train`` marks.

    Copies of a text count once per language. A language with more than ``rows`` different texts is
    learned from those with the ``rows`` least hashes. The result holds ``size`` n-grams per language.
    """
    rows_of = docs.select(train.alias("train"), "lang", whole_text("text").alias("text")).where("train AND lang IS NOT NULL")
    rows_of = rows_of.select("lang", "text", F.xxhash64("text").alias("hash"))
    hashes = settle(rows_of.select("lang", "hash").distinct())
    found = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), size)
    cuts = F.create_map(*(F.lit(x) for item in hash_cuts(hashes, found, rows).items() for x in item))
    sample = rows_of.where(F.col("hash") <= F.element_at(cuts, F.col("lang"))).select("lang", "text").distinct()
    counts = sample.mapInArrow(over_slices(count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    languages = sorted(found)
    grams = np.array(sorted({r["gram"] for r in top}), np.int64)
    ranks = np.full((len(languages), len(grams)), -1, np.int64)
    for r in top:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"] - 1
    return Profiles(languages, grams, ranks, size)


def distances(profiles: Profiles, own: np.ndarray) -> np.ndarray:
    """Out-of-place distance to every profile, as a share of the largest possible."""
    if not len(profiles.grams):
        return np.ones(len(profiles.languages))
    at = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    ranks = np.where(profiles.grams[at] == own, profiles.ranks[:, at], -1)
    apart = np.where(ranks < 0, profiles.size, np.abs(ranks - np.arange(len(own))))
    return apart.sum(axis=1) / (profiles.size * len(own))


def predict(profiles: Profiles):
    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for text in strings(batch):
            own = ranking(text, profiles.size)
            if not len(own) or not profiles.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            far = distances(profiles, own)
            order = np.argsort(far, kind="stable")
            best, second = far[order[0]], far[order[1]] if len(far) > 1 else 1.0
            names.append(profiles.languages[order[0]])
            scores.append(float(second / (best + second)) if best + second else 0.5)
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"],
        )

    return over_slices(judge)


def identify(docs: DataFrame, profiles: Profiles, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: the ``keep`` columns, the predicted language and a score.

    The score is the runner-up's share of both distances: 0.5 when they tie, 1 for a perfect match.
    A null text or one without a letter is ``und`` with score 0, as is everything when no language
    was learned. Ties go to the language that sorts first. Other columns are left out.
    """
    keep = keep if keep is not None else {"doc_id": F.col("doc_id")}
    frame = docs.select(*(c.alias(name) for name, c in keep.items()), whole_text("text").alias("text"))
    kept = ", ".join(f"{name} {kind}" for name, kind in frame.dtypes if name != "text")
    return frame.mapInArrow(predict(profiles), f"{kept}, lang_pred string, score double")
