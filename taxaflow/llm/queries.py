"""Registered queries of the corpus operators, and SQL with the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import (
    bpe,
    decontaminate,
    languages,
    length_histogram,
    lexical,
    licenses,
    max_score,
    personal_data,
    quality,
    resampling,
    secrets,
    shingle_join,
    url_rules,
)
from taxaflow.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The rules of the task: verdict, host, path.
RULES = [
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
]


def query(oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


@query()
def op1_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encode(table(spark, directory, "documents"), with_ids=False)


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
sized AS (SELECT q, item_id, words, least(10, len(words)) AS k FROM b WHERE len(words) > 0),
places AS (SELECT q, item_id, k, s, words[s:s + k - 1] AS words FROM sized, unnest(range(1, len(words) - k + 2)) AS t(s)),
windows AS (SELECT DISTINCT item_id, k, array_to_string(words, ' ') AS gram FROM places),
grams AS (
  SELECT r, s, k, array_to_string(words[s:s + k - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT k FROM windows), unnest(range(1, len(words) - k + 2)) AS t(s)),
found AS (SELECT r, item_id, s, g.k FROM grams g JOIN windows w ON g.gram = w.gram AND g.k = w.k),
hit AS (SELECT r, count(DISTINCT s + i) AS n FROM found, unnest(range(0, k)) AS t(i) GROUP BY r),
items AS (
  SELECT r, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r),
tokens AS (SELECT r, i - 1 AS pos, words[i] AS w FROM d, unnest(range(1, len(words) + 1)) AS t(i)),
counts AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
rated AS (
  SELECT q, item_id, s, k, i - 1 AS off, p.words[i] AS w, row_number() OVER (PARTITION BY q, s ORDER BY n, i) AS place, count(n) OVER (PARTITION BY q, s) AS held
  FROM places p, unnest(range(1, k + 1)) AS t(i) LEFT JOIN counts ON counts.w = p.words[i]),
anchors AS MATERIALIZED (
  SELECT r, q, s, pos - off AS pos, place, least(2, k) AS second FROM rated JOIN tokens USING (w) WHERE held = k AND place <= least(2, k)),
tries AS MATERIALIZED (
  SELECT DISTINCT f.r, f.q, f.s, f.pos
  FROM anchors f JOIN (SELECT r, q, s, pos + d AS pos FROM anchors, unnest(range(-2, 3)) AS t(d) WHERE place = second) g USING (r, q, s, pos) WHERE f.place = 1),
close AS (
  SELECT DISTINCT r, CAST(p.item_id AS VARCHAR) AS item_id
  FROM tries JOIN places p USING (q, s) JOIN d USING (r)
  WHERE list_has_all(d.words[greatest(pos - 2, 0) + 1:greatest(pos - 2, 0) + k + 4], p.words)),
nearby AS (SELECT r, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM close GROUP BY r)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
       coalesce(nearby.n, 0) AS n_near, sha256(coalesce(nearby.ids, '')) AS near_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN nearby USING (r)
"""


@query(OP2_SQL)
def op2_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return leaks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


@query()
def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = quality.fit(docs, table(spark, directory, "labels"), fold("doc_id", 3) != 1)
    texts = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return quality.score(texts, model).drop("text")


@query()
def op4_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    profiles = languages.learn_profiles(docs, fold("doc_id", 4) != 2)
    return languages.identify(docs, profiles, {"doc_id": F.col("doc_id"), "held_out": fold("doc_id", 4) == 2})


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


@query(OP5_SQL)
def op5_top_k(spark: SparkSession, directory: str) -> DataFrame:
    return max_score.top_k(table(spark, directory, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_secrets(spark: SparkSession, directory: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, directory, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda s: s["kind"] != "random")

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
    )


@query()
def op7_token_lengths(spark: SparkSession, directory: str) -> DataFrame:
    return length_histogram.length_histogram(table(spark, directory, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
pairs AS (SELECT doc_id, i AS pos, words[i + 1] AS a, words[i + 2] AS b FROM d, unnest(range(0, len(words) - 1)) AS t(i)),
templates(template, label, exact, line) AS (VALUES
  (0, 'cc-by', true, 'cc by'),
  (1, 'gpl', true, 'general public license'),
  (2, 'reserved', true, 'all rights reserved'),
  (3, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'),
  (4, 'apache-2.0', false, 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license'),
  (5, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (6, 'gpl', false, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  (7, 'mpl-2.0', false, 'this source code form is subject to the terms of the mozilla public license v 2 0'),
  (8, 'cc-by', false, 'this work is licensed under a creative commons attribution 4 0 international license')),
split AS (SELECT template, label, exact, string_split(line, ' ') AS words FROM templates),
places AS (SELECT template, label, exact, len(words) - 1 AS size, i AS place, words[i + 1] AS a, words[i + 2] AS b FROM split, unnest(range(0, len(words) - 1)) AS t(i)),
votes AS (SELECT DISTINCT doc_id, template, label, exact, size, pos - place AS diagonal, place FROM pairs p JOIN places t ON p.a = t.a AND p.b = t.b),
phrases AS (SELECT doc_id, label, exact, diagonal AS start, 1.0 AS cover FROM votes WHERE exact GROUP BY doc_id, template, label, exact, size, diagonal HAVING count(*) = size),
likely AS (SELECT doc_id, template FROM votes WHERE NOT exact GROUP BY doc_id, template, size HAVING count(DISTINCT place) >= 0.6 * size),
firsts AS (
  SELECT doc_id, template, label, size, diagonal - back AS band, place, min(diagonal + place) AS pos
  FROM votes JOIN likely USING (doc_id, template), unnest(range(0, 9)) AS t(back) GROUP BY ALL),
ordered AS (
  SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY doc_id, template, band ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS rising
  FROM firsts),
notices AS (
  SELECT doc_id, label, false AS exact, NULL::BIGINT AS start, max(cover) AS cover
  FROM (SELECT doc_id, template, label, band, count(*) FILTER (WHERE rising) / CAST(size AS DOUBLE) AS cover FROM ordered GROUP BY doc_id, template, label, band, size)
  WHERE cover >= 0.6 GROUP BY doc_id, template, label),
kept AS (SELECT * FROM phrases UNION ALL SELECT * FROM notices),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word, max(start) FILTER (WHERE exact) AS last_word,
         array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (WHERE exact), []))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (doc_id)
"""


@query(OP8_SQL)
def op8_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, directory, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 3], ' ')) AS shingle
  FROM d, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
twos AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM twos JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, sizes.n
"""


@query(OP9_SQL)
def op9_shingle_join(spark: SparkSession, directory: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, directory, "documents"), k=4, percent=85)


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ranked AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""


@query(OP10_SQL)
def op10_url_rules(spark: SparkSession, directory: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, directory, "pages"), RULES)


@query()
def op11_personal_data(spark: SparkSession, directory: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, directory, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(personal_data.BASE))

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in personal_data.BASE),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
crc(i, v) AS (
  SELECT b, list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b)
  FROM range(0, 256) AS t(b)),
sums AS (SELECT list(v ORDER BY i) AS steps FROM crc),
terms AS (
  SELECT DISTINCT w FROM (
    SELECT unnest(words) AS w FROM d
    UNION ALL
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark)),
hashed AS (
  SELECT w, CAST(xor(4294967295, list_reduce(range(0, octet_length(encode(w))), lambda c, k: xor(steps[xor(c & 255, CAST('0x' || substr(hex(w), 2 * k + 1, 2) AS BIGINT)) + 1], c >> 8), 4294967295)) % 10000 AS INTEGER) AS bucket
  FROM terms, sums),
source AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(words) AS w FROM d) JOIN hashed USING (w) GROUP BY bucket),
target AS (
  SELECT bucket, count(*) AS t
  FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS big_s, (SELECT coalesce(sum(t), 0) FROM target) AS big_t),
gains AS (
  SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1.0::DOUBLE) * (big_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(0, 10000) AS r(b) LEFT JOIN source ON source.bucket = b LEFT JOIN target ON target.bucket = b, totals),
means AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT r, unnest(words) AS w FROM d) JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
weights AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN means ON d.r = means.r),
scores AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weights),
ranked AS (
  SELECT *, n_features >= 20 AS fits, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


@query(OP12_SQL)
def op12_resampling(spark: SparkSession, directory: str) -> DataFrame:
    return resampling.resample(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
asked AS (SELECT q, w, count(*) AS repeats FROM (SELECT q, unnest(words) AS w FROM i) GROUP BY ALL),
sums AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
held AS (
  SELECT r, w, count(*) AS tf
  FROM (SELECT r, unnest(words) AS w FROM d) WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
weights AS (
  SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM held, sums GROUP BY w, n_docs),
sizes AS (SELECT r, doc_id, 75 + (25 * len(words) * n_docs) // n_terms AS m FROM d, sums WHERE len(words) > 0),
scores AS (
  SELECT q, r, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (w) JOIN weights USING (w) JOIN sizes USING (r) GROUP BY q, r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores JOIN sizes USING (r) JOIN i USING (q) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""


@query(OP13_SQL)
def op13_lexical(spark: SparkSession, directory: str) -> DataFrame:
    return lexical.search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
