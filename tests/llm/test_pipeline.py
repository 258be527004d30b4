"""The pipeline against plain Python on a small table."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taxaflow.llm import secrets
from taxaflow.llm.vocabulary import rank_encoding, tokenizer_path
from taxaflow.session import settle
from tests.llm.test_joins import brute_components, brute_leaks

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = corpus_pipeline.read(spark, DIRECTORY, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, DIRECTORY))
        made.append(docs)
    return made


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = corpus_pipeline.read(spark, DIRECTORY, "documents").dtypes
    assert [s.dtypes for s in stages[:-1]] == [columns] * 4


def test_quality_stage_rejects_by_label(spark, stages):
    labels = corpus_pipeline.read(spark, DIRECTORY, "labels")
    kept = stages[0].select("doc_id").distinct()
    bad, good = labels.where("quality = 0"), labels.where("quality = 1")
    assert bad.join(kept, "doc_id").count() <= 0.2 * bad.count()
    assert good.join(kept, "doc_id").count() >= 0.95 * good.count()


def test_later_stages_against_brute_force(spark, stages):
    quality, once, clean, redacted, tokens = stages
    before = texts(quality)
    found = brute_components(list(before.items()), 5, 80)
    assert texts(once) == {i: before[i] for i in before if found[i][1] == i}
    items = [tuple(r) for r in corpus_pipeline.read(spark, DIRECTORY, "benchmark").select("item_id", "text").collect()]
    assert texts(clean) == {i: t for i, t in texts(once).items() if not brute_leaks(t, items)[1]}
    encoding = rank_encoding(tokenizer_path("byte_bpe_50k.tiktoken"))
    want = {}
    for i, text in texts(clean).items():
        spans = secrets.base_spans(text)
        spans += secrets.random_spans(text, spans, encoding, secrets.CHARS_PER_TOKEN)
        hidden = list(text)
        for _, start, end in spans:
            hidden[start:end] = ["\0"] * (end - start)
        want[i] = re.sub("\0+", corpus_pipeline.REDACTED, "".join(hidden))
    assert texts(redacted) == want
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in want.items()}
    assert {r["doc_id"]: (bytes(r["ids"]), r["ids_sha256"]) for r in tokens.collect()} == {i: (x, hashlib.sha256(x).hexdigest()) for i, x in ids.items()}


def test_one_of_each_with_repeated_and_null_ids(spark):
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(60)) for name in ("one", "two", "three", "four"))
    rows = [(5, one), (5, two), (5, two), (9, two + " end"), (None, three), (None, three), (None, three + " end"), (None, four), (8, four), (None, one), (None, ""), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, key long")
    got = corpus_pipeline.keep_one_of_each(spark, docs, DIRECTORY)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(5, one), (5, two), (None, three), (8, four), (None, ""), (7, "")]))


def test_items_without_an_id_drop_documents(spark, tmp_path):
    spark.createDataFrame([(None, "b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c b"), (None, "b c")], "doc_id long, text string")
    assert texts(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))) == {2: "c b"}


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, DIRECTORY).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].select("doc_id", "ids_sha256").collect()))


def test_edges_pass_every_stage(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        own = [c for c in docs.columns if c not in ("score", "found")]
        for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_one_of_each, corpus_pipeline.drop_leaks, corpus_pipeline.redact_secrets):
            assert set(own) <= set(stage(spark, docs, DIRECTORY).columns)
            assert stage(spark, docs, DIRECTORY).count() <= docs.count()
        assert corpus_pipeline.tokenize(spark, docs, DIRECTORY).count() == docs.count()
    once = corpus_pipeline.keep_one_of_each(spark, edge_docs, DIRECTORY)
    assert sorted(str(r[0]) for r in once.select("doc_id").collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    assert once.where(F.col("doc_id") == 8).count() == 1
