"""Licence scans by diagonal voting over rolling word pairs.

Every rolling word pair of a document is hashed and joined to the places of the same pair in the
templates. A match votes for its diagonal, document place minus template place. Votes are summed per
document, template and diagonal. A base phrase stands where one diagonal has all its pairs. For a notice
neighbouring diagonals are merged, since an added or missing word shifts the rest of it by one: every
band of diagonals no wider than ``DRIFT`` is one span. A span counts if it verifies: the template's
pairs, compared word by word in the join, that follow each other in the document in the template's
order cover enough of it. Columns and SQL functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm.common import ascii_words, whole_text
from taxaflow.session import settle

COVER = 0.6  # least share of a notice's word pairs
DRIFT = 8  # words that may be added to or missing from a notice within one span


class Template(NamedTuple):
    label: str
    words: str
    exact: bool  # a base phrase: every word, in place


# The phrases searched for, and opening sentences of public licence notices.
PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", False),
]
TEMPLATES = PHRASES + NOTICES


def template_pairs(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per word pair of a template: its hash, both words, and its place."""
    rows = F.array(
        *(
            F.struct(F.lit(t).alias("template"), F.lit(place).alias("place"), F.lit(a).alias("t_first"), F.lit(b).alias("t_second"))
            for t, template in enumerate(templates)
            for place, (a, b) in enumerate(zip(template.words.split(), template.words.split()[1:], strict=False))
        )
    )
    pairs = spark.range(1).select(F.inline(rows))
    return pairs.withColumn("t_hash", F.xxhash64("t_first", "t_second"))


def document_pairs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rolling word pair: the keys, its place, both words, and their hash."""
    words = docs.select(*keys, ascii_words(whole_text("text")).alias("words"))
    count = F.greatest(F.size("words") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice("words", F.lit(1), count).alias("first"), F.slice("words", F.lit(2), count).alias("second"))
    rows = words.select(*keys, F.posexplode(zipped).alias("pos", "pair"))
    rows = rows.select(*keys, "pos", F.col("pair")["first"].alias("first"), F.col("pair")["second"].alias("second"))
    return rows.withColumn("hash", F.xxhash64("first", "second"))


def diagonals(docs: DataFrame, keys: list[str], templates: list[Template]) -> DataFrame:
    """Verified votes per document, template and diagonal: the template places that voted."""
    table = F.broadcast(template_pairs(docs.sparkSession, templates))  # a row per pair of the fixed list above
    same = (F.col("hash") == F.col("t_hash")) & (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second"))
    votes = document_pairs(docs, keys).join(table, same).withColumn("diagonal", F.col("pos") - F.col("place"))
    return votes.groupBy(*keys, "template", "diagonal").agg(F.collect_set("place").alias("places"))


def of_template(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)


def phrases(found: DataFrame, keys: list[str], templates: list[Template]) -> DataFrame:
    """Places where a base phrase stands: all its pairs on one diagonal."""
    whole = found.where(of_template([t.exact for t in templates]) & (F.size("places") == of_template(sizes(templates))))
    return whole.select(*keys, "template", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"), F.lit(True).alias("exact"))


def notices(found: DataFrame, keys: list[str], templates: list[Template]) -> DataFrame:
    """Notices that verify, with the best share of their pairs that one span has in order."""
    size = of_template(sizes(templates))
    votes = found.where(~of_template([t.exact for t in templates]))
    held = votes.groupBy(*keys, "template").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("held"))
    likely = held.where(F.size("held") >= size * COVER).select(*(F.col(c).alias(f"l_{c}") for c in (*keys, "template")))
    same = F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("text_hash") == F.col("l_text_hash")) & (F.col("template") == F.col("l_template"))
    places = votes.join(likely, same, "left_semi").select(*keys, "template", "diagonal", F.explode("places").alias("place"))
    bands = places.withColumn("band", F.explode(F.sequence(F.col("diagonal") - DRIFT, F.col("diagonal"))))
    firsts = bands.groupBy(*keys, "template", "band", "place").agg(F.min(F.col("diagonal") + F.col("place")).alias("pos"))
    spans = firsts.groupBy(*keys, "template", "band").agg(F.sort_array(F.collect_list(F.struct("place", "pos"))).alias("pairs"))  # a pair for each place of the template
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("reached"))
    rising = F.aggregate(
        "pairs",
        start,
        lambda done, pair: F.struct(
            (done["n"] + (pair["pos"] > done["reached"]).cast("int")).alias("n"), F.greatest(done["reached"], pair["pos"]).alias("reached")
        ),
        lambda done: done["n"],
    )
    best = spans.withColumn("cover", rising / size).where(F.col("cover") >= COVER).groupBy(*keys, "template").agg(F.max("cover").alias("cover"))
    return best.select(*keys, "template", F.lit(None).cast("int").alias("start"), "cover", F.lit(False).alias("exact"))


def sizes(templates: list[Template]) -> list[int]:
    return [len(t.words.split()) - 1 for t in templates]


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, their labels, all labels, and a score.

    ``n_base`` counts the places of exact phrases, ``first_word`` and ``last_word`` are the smallest
    and largest of them (null without any). ``score`` is the best share of a template found in order in
    one span, 1 for an exact phrase. A null or empty text has no words. Rows that repeat an id and text get the same
    result each; other columns of ``docs`` are left out.
    """
    templates = templates or TEMPLATES
    keyed = docs.select("doc_id", whole_text("text").alias("text"))
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    keys = ["doc_id", "text_hash"]
    counted = keyed.select(*keys, F.size(ascii_words(F.col("text"))).cast("long").alias("n_words"))
    votes = settle(diagonals(keyed, keys, templates))
    found = phrases(votes, keys, templates).unionByName(notices(votes, keys, templates))
    found = found.withColumn("label", of_template([t.label for t in templates]))
    found = found.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    both = counted.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")
