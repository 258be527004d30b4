"""Resampling and lexical search against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import lexical, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of many lengths, with copies, ties, nulls, repeated ids and other alphabets, and items."""
    draw = random.Random(3)
    terms = [f"w{i}" for i in range(60)] + ["é", "日本", "Über", "x"]
    texts = [" ".join(draw.choices(terms, k=draw.choice([0, 1, 5, 19, 20, 21, 40, 200]))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[7]) for i in range(60)] + [(5, texts[9]), (None, texts[3]), (None, None), (2000, None), (2001, " \n"), (-7, texts[8]), (-7, texts[8])]
    items = [(i, " ".join(draw.choices(terms[:40], k=k))) for i, k in enumerate([1, 3, 3, 8, 30])]
    items += [(90, None), (91, "nowhere found"), (None, "w1 w1 É é Über"), (3, "W2,w2"), (0, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return docs, spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_buckets_are_the_unsigned_crc32_of_the_bytes(spark):
    words = ["a", "é", "日本語", "w" * 5000]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", resampling.word_bucket(F.col("w")).alias("b")).collect()
    assert {r["w"]: r["b"] for r in got} == {w: zlib.crc32(w.encode()) % 10000 for w in words}


def resampled(rows, items, percent=10, least=20):
    s = Counter(zlib.crc32(w.encode()) % 10000 for _, t in rows for w in words_of(t))
    t = Counter(zlib.crc32(w.encode()) % 10000 for _, x in items for w in words_of(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        buckets = [zlib.crc32(w.encode()) % 10000 for w in words_of(text)]
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000)))) for b in buckets]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fitting = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(fitting) * percent // 100
    places = {id(r): i + 1 for i, r in enumerate(fitting[:drawn])}
    return sorted((str(r[0]), *r[1:], places.get(id(r), 0)) for r in out)


def got_rows(frame):
    return sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in frame.collect())


@pytest.mark.parametrize(("bits", "block", "cells", "percent"), [(11, 16, 12, 10), (16, 2, 3, 60)])
def test_resampling_against_plain_python(corpus, monkeypatch, bits, block, cells, percent):
    docs, items, rows, texts = corpus
    monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
    monkeypatch.setattr(resampling, "BLOCK_BITS", block)
    monkeypatch.setattr(resampling, "CELLS_BITS", cells)
    assert got_rows(resampling.resample(docs, items, percent=percent)) == resampled(rows, texts, percent)


def test_radix_order_of_whole_longs(spark):
    draw = random.Random(1)
    values = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [-(1 << 63), (1 << 63) - 1, 0, 0, -1]
    rows = spark.createDataFrame([(v, draw.randrange(3)) for v in values], "v long, a long").repartition(5)
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("u", F.col("v").bitwiseXOR(F.lit(resampling.SIGN)))
    ranked = resampling.radix_ranked(resampling.settle(rows), ["a", "u"]).orderBy("place").collect()
    assert [r["place"] for r in ranked] == list(range(len(values)))
    assert [(r["a"], r["v"]) for r in ranked] == sorted((r["a"], r["v"]) for r in ranked)


def test_resampling_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([(1, "the quick fox"), (None, None)], "item_id long, text string")
    assert resampling.resample(edge_docs, target).count() == edge_docs.count()
    assert resampling.resample(no_docs, target).count() == 0
    flat = resampling.resample(edge_docs, target.limit(0), percent=100).collect()
    assert len(flat) == edge_docs.count()
    assert sorted(r["rank"] for r in flat if r["rank"]) == [1, 2]  # the long text, twice


def searched(rows, items, k=20):
    def terms_of(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    held = [(d, Counter(terms_of(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item_id, text in {(i, t or "") for i, t in items}:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms_of(text) if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(str(item_id), i + 1, str(s[3]), -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found_rows(frame):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in frame.collect())


@pytest.mark.parametrize(("postings", "terms"), [(1 << 18, 200_000), (40, 70)])
def test_search_against_plain_python(corpus, monkeypatch, postings, terms):
    """One block a stratum and one group, and many of both."""
    docs, items, rows, texts = corpus
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    got = lexical.search(docs, items, group_terms=terms)
    assert found_rows(got) == searched(rows, texts)
    assert len([r for r in found_rows(got) if r[0] == "None"]) == 20


def test_strata_share_m_and_bound_their_items(spark):
    """One index row a stratum; the shortest documents of the highest tf have the highest bound."""
    rows = [(i, "rare rare rare other" if i < 30 else f"rare {'filler ' * (i % 50 + 40)}") for i in range(400)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), [(1, "rare")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert found_rows(lexical.search(docs, benchmark)) == searched(rows, items)
    postings = docs.selectExpr("doc_id", "monotonically_increasing_id() row", "text").mapInArrow(
        lexical.count_terms([b"rare"]), "doc_id long, row long, n long, terms array<int>, tfs array<int>"
    )
    index = lexical.build_index(postings, F.expr("75 + n")).collect()
    assert len(index) == 51 and all(r["highest"] in ([3], [1]) for r in index)
    group = lexical.Items([1], [lexical.np.array([0])], [lexical.np.array([1])], [b"rare"])
    frame = spark.createDataFrame(index, lexical.INDEX_SQL)
    bounds = frame.select("m", "part", "terms", "highest").mapInArrow(lexical.block_bounds(group, lexical.np.array([7])), "m long, part long, item int, bound long")
    assert [r["m"] for r in bounds.orderBy(F.desc("bound")).limit(1).collect()] == [79]


def test_search_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown text"), (2, None), (3, "")], "item_id string, text string")
    got = lexical.search(edge_docs, items)
    assert {r["item_id"] for r in got.collect()} == {"1"}
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(edge_docs, items.limit(0)).count() == 0
    assert lexical.search(edge_docs, items.where("item_id = '2'")).count() == 0
