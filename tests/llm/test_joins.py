"""Leaks, near duplicates, top-k search and URL rules against brute force."""

from __future__ import annotations

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxaflow.llm import decontaminate, max_score, queries, shingle_join, url_rules
from taxaflow.llm.components import components
from taxaflow.llm.queries import RULES
from taxaflow.session import settle
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_leaks(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, line in items:
        asked = WORD.findall((line or "").translate(LOWER))
        k = min(10, len(asked))
        for s in range(len(asked) - k + 1 if asked else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == asked[s : s + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_leaks_against_brute_force(spark, edge_docs):
    draw = random.Random(2)

    def line(n):
        return " ".join(draw.choices(["a", "b", "c", "The", "é9", "x,y", "z"], k=n))

    items = [(i, line(draw.choice([0, 1, 2, 9, 10, 11, 25]))) for i in range(14)] + [(1, "repeated id"), (77, None), (None, "no id here")]
    filled = [x for x in items if x[1]]
    rows = [(i, line(40) + " " + draw.choice(filled)[1].upper() + " " + line(5) if i % 3 else line(30)) for i in range(30)]
    rows += [(None, "a b c"), (5, None), (3, rows[3][1])] + [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    benchmark = spark.createDataFrame(items + items[:3], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_leaks(docs, benchmark).collect())
    want = [(str(i), *brute_leaks(t, items)) for i, t in rows]
    assert got == sorted((i, n, hit, [x for x in found if x != "None"]) for i, n, hit, found in want)


def test_items_without_an_id_are_hits(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "c d"), (3, "x y")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "b c"), (None, "d e"), (7, "c d")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["near_items"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {1: (4, ["7"], ["7"]), 2: (2, ["7"], ["7"]), 3: (0, [], [])}


def test_query_counts_items_without_an_id(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e"), (2, "c d"), (3, "x y")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, "b c"), (7, "c d")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    frame = queries.op2_decontaminate(spark, str(tmp_path))
    assert compare(frame, con, queries.OP2_SQL) is None
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in frame.collect()} == {1: (3, 1, True), 2: (2, 1, True), 3: (0, 0, False)}


def test_a_text_of_one_repeated_word(spark):
    """20,000 equal words against items of that word: every window of every place, in time linear in the text."""
    rows = [(1, "la " * 20_000), (2, "la la"), (3, "do " + "la " * 9 + "do"), (4, "do " + "la " * 12 + "do")]
    items = [(1, "la " * 12), (2, "do " + "la " * 9), (3, "la di")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    started = time.monotonic()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {1: (20_000, 20_000, ["1"]), 2: (2, 0, []), 3: (11, 10, ["2"]), 4: (14, 13, ["1", "2"])}
    assert time.monotonic() - started < 120


def test_near_matches(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "zero one two three four six five seven eight nine ten end"), (2, item), (3, "ten nine one two"), (4, "one two three four five extra six seven eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["near_items"]) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {1: (0, ["5"]), 2: (11, ["5"]), 3: (0, []), 4: (0, ["5"])}


def test_leaks_of_empty_tables(edge_docs, no_docs, spark):
    benchmark = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    clean = decontaminate.find_leaks(edge_docs, benchmark.limit(0))
    assert clean.where("n_hit = 0 AND size(items) = 0").count() == edge_docs.count()


def test_terms_join_by_shuffle_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "b c"), (2, "q")], "item_id long, text string")
    assert {(r["doc_id"], r["n_hit"]) for r in decontaminate.find_leaks(docs, benchmark).collect()} == {(1, 2), (2, 2)}


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[p : p + k]) for p in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, common):
    """Clusters of edited copies, exact copies, passages that many share, short texts."""
    draw = random.Random(seed)
    words = [f"v{i}" for i in range(4000)]
    passage = draw.choices(words, k=30)
    rows = []
    for _ in range(12):
        base = draw.choices(words, k=draw.choice([3, 4, 6, 40, 120]))
        for _ in range(draw.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            if draw.random() < 0.3:
                copy = copy[: len(copy) - draw.randrange(min(8, len(copy)))]
            if common and draw.random() < 0.5:
                copy = copy + passage
            rows.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(rows + ["", " ", "Lone", "lone", None])]


@pytest.mark.parametrize(("seed", "common", "k", "percent"), [(1, False, 4, 85), (2, True, 4, 85), (3, True, 5, 80), (4, True, 2, 60)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, common, k, percent):
    monkeypatch.setattr(shingle_join, "COMMON_SHINGLES", 40)
    rows = near_copies(seed, common)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n", F.lit("x")).withColumn("unit", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.near_duplicates(docs, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_near_duplicate_edges(edge_docs, no_docs, monkeypatch):
    got = [tuple(r) for r in shingle_join.near_duplicates(edge_docs).collect()]
    assert len(got) == edge_docs.count()
    assert {(1, 12, 1), (2, 12, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (9, 1, 9)} <= set(got)
    assert sum(r[0] == 8 and r[2] == 8 for r in got) == 2
    assert shingle_join.near_duplicates(no_docs).count() == 0
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", 0)
    assert sorted(map(str, shingle_join.near_duplicates(edge_docs).collect())) == sorted(str(r) for r in shingle_join.near_duplicates(edge_docs).collect())


def test_small_tables_of_near_duplicates_take_few_tasks(spark):
    """Tables between the steps are read in few tasks where they are small, however many partitions wrote them."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    docs = settle(spark.createDataFrame(near_copies(2, True), "doc_id long, text string"))
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("near duplicates", "tasks are counted")
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        shingle_join.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    finally:
        context._jsc.clearJobGroup()
        for key, value in before.items():
            spark.conf.set(key, value)
    stages = {stage for job in tracker.getJobIdsForGroup("near duplicates") for stage in tracker.getJobInfo(job).stageIds}
    assert sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info) < 2400


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_top_k_against_brute_force(spark, monkeypatch):
    for name, value in (("SHARD_CELLS", 50 * 9), ("QUERY_ROWS", 3), ("SEED_ROWS", 12), ("PROBE_TERMS", 3)):
        monkeypatch.setattr(max_score, name, value)
    draw = random.Random(6)
    rows = [(i, [draw.choice([-1.0, 0.25, 0.5, 1.5]) * draw.randint(0, 3) for _ in range(9)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [-2.0, 3.0]), (None, [1.0]), (7, rows[7][1]), (20, rows[20][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))
    got = sorted(tuple(r) for r in max_score.top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect())
    usable = [(i, [int(x * 1024 // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 1e300 for x in v)]
    want = []
    for i, v in dict(u for u in usable if u[0] % 20 == 0).items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in usable if j != i)[:7]
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored)]
    assert got == sorted(want)


def test_a_task_keeps_the_thresholds_of_its_earlier_shards():
    """The same shard again gives only what still reaches a query's k-th score, and its best rows stay."""
    draw = np.random.default_rng(5)
    matrix, ids = draw.integers(-50, 50, (600, 6)), np.arange(600)

    def pair(rows, names):
        return {"block": 0, "width": 6, "ids": names.tobytes(), "matrix": rows.tobytes(), "q_block": 0, "q_width": 6, "q_ids": ids[:3].tobytes(), "q_matrix": matrix[:3].tobytes()}

    low = draw.integers(-2, 2, (600, 6))
    batch = pa.RecordBatch.from_pylist([pair(matrix, ids), pair(low, ids + 1000)])
    first, second = max_score.search_pairs(4)(iter([batch]))
    assert first.num_rows == 12 and second.num_rows == 0
    scores = matrix[:3] @ matrix.T
    for query in range(3):
        best = sorted((-int(s), i) for i, s in enumerate(scores[query]) if i != query)[:4]
        assert [(-r["score"], r["vec_id"]) for r in first.to_pylist() if r["query_id"] == query] == best


def test_shards_are_moved_once(spark):
    """Only the queries are repeated; the join has one row for every shard and query block."""
    frame = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), x -> CAST((id * x) % 17 AS DOUBLE)) AS embedding")
    plan = max_score.top_k(frame, F.col("vec_id") % 100 == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_scores_beyond_64_bits_fail(spark):
    frame = spark.createDataFrame([(0, [1e13]), (1, [1e13])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        max_score.top_k(frame, F.col("vec_id") == 0).collect()


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in max_score.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 2048), (0, 2, 2, 1024 * 2048)]
    assert max_score.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert max_score.top_k(frame, F.col("vec_id") == 9).count() == 0


def plain_verdict(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


def test_url_rules_against_brute_force(spark):
    draw = random.Random(1)
    hosts = ["com", "Example.COM", "www.example.com", "m.www.example.com", "xexample.com", "net", "a.net", "net.a", "", "a..com", "com.", "b.example.com:80"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "://") for h in hosts for p in ("", "/", "/en/1", "/en", "/es/?q=/fr/", "?x=://net/es/", "#/en/", "/fr/a://b", "/EN/")]
    urls += [None, "", "no scheme", "com/en/", "http:/x", "http://"] + urls[:5]
    draw.shuffle(urls)
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, "http://a.net/es/")]
    more = [url_rules.Rule("block", "", "/"), url_rules.Rule("allow", "example.com", "/"), url_rules.Rule("block", "a.net", "/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("x"))
    for rules in (RULES, RULES + more, []):
        got = sorted(map(str, (tuple(r) for r in url_rules.judge_urls(pages.repartition(5), rules).collect())))
        assert got == sorted(str((i, *plain_verdict(u, rules))) for i, u in rows)
    assert url_rules.judge_urls(pages.limit(0), RULES).count() == 0
