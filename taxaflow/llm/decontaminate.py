"""Benchmark decontamination over a positional inverted index.

Training tokens are stored as postings: a term, its document and its places there. Only lists that
test windows start from are stored, those of every window's two rarest terms. Lists are intersected
after their places are moved by the term's offset in its item, so that one shift of an item in a
document is one value. Shifts are grouped into cells a little wider than the slop, so that a group holds
no more than an item's places whatever the text repeats; a window is tried where both its lists have the
same shift, or nearly the same for proximity matches, and then compared word by word. Only texts with
something to try are read for that. Columns and SQL functions only.

Test terms, items and the ids of such texts are broadcast while they are few, and joined by a shuffle
beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import ascii_words, whole_text
from taxaflow.session import settle

WINDOW = 10
SLOP = 2
BROADCAST_ROWS = 200_000
SPAN_BITS = 4  # of a span's length in its packed form; a window has at most WINDOW words
SPAN = 1 << SPAN_BITS


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def test_items(benchmark: DataFrame) -> DataFrame:
    """Items with words: id, words, and the length of their windows."""
    items = benchmark.select("item_id", ascii_words(whole_text("text")).alias("item_words")).where("size(item_words) > 0")
    items = items.dropDuplicates().withColumn("item", F.xxhash64("item_id", "item_words"))
    return items.withColumn("length", F.least(F.size("item_words"), F.lit(WINDOW)))


def term_counts(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """How often every test term occurs in the training texts."""
    terms = items.select(F.explode("item_words").alias("test_term")).distinct()
    return tokens.join(small(terms), F.col("term") == F.col("test_term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def test_windows(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with the item places of their two rarest terms."""
    starts = F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("length"))).alias("start")
    windows = items.select("item", "item_words", "length", starts)
    words = windows.select("item", "length", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("length"))).alias("offset", "term"))
    rated = words.join(counts, "term").select("item", "length", "start", F.struct("n", "offset", "term").alias("rated"))
    chosen = rated.groupBy("item", "length", "start").agg(F.sort_array(F.collect_list("rated")).alias("rated"))
    chosen = chosen.where(F.size("rated") == F.col("length"))
    first, second = F.col("rated")[0], F.element_at("rated", F.least(F.lit(2), F.size("rated")))
    return chosen.select(
        "item",
        "start",
        F.array(*(F.struct((F.col("start") + r["offset"]).alias("place"), r["term"].alias("term")) for r in (first, second))).alias("lists"),
    )


def build_index(tokens: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Postings of the terms asked for: term, document, and its places there in order."""
    asked = small(terms.select(F.col("term").alias("asked")).distinct())
    return tokens.join(asked, F.col("term") == F.col("asked")).groupBy("term", *keys).agg(F.sort_array(F.collect_set("pos")).alias("places"))


def intersect(index: DataFrame, items: DataFrame, windows: DataFrame, keys: list[str], slop: int) -> DataFrame:
    """Places to try: per document, its items with every window where the two rarest lists agree within the slop."""
    uses = windows.select("item", F.explode("lists").alias("list")).select("item", F.col("list.place").alias("place"), F.col("list.term").alias("term")).distinct()
    moved = index.join(small(uses), "term").select(*keys, "item", "place", F.explode("places").alias("pos"))
    shifts = moved.select(*keys, "item", F.struct("place", (F.col("pos") - F.col("place")).alias("shift")).alias("at"))
    cell = F.floor(F.col("at.shift") / (slop + 1))  # shifts no further apart than the slop meet in the cell of one of them
    cells = shifts.withColumn("cell", F.explode(F.array(cell, cell + 1))).groupBy(*keys, "item", "cell").agg(F.collect_set("at").alias("shifts"))
    per_item = windows.groupBy("item").agg(F.collect_list(F.struct("start", F.col("lists")[0]["place"].alias("a"), F.col("lists")[1]["place"].alias("b"))).alias("windows"))

    def tries(window: Column) -> Column:
        def agrees(one: Column) -> Column:
            return F.exists("shifts", lambda two: (two["place"] == window["b"]) & (F.abs(two["shift"] - one["shift"]) <= slop))

        at = F.filter("shifts", lambda one: (one["place"] == window["a"]) & agrees(one))
        return F.transform(at, lambda one: F.struct(window["start"].alias("start"), (one["shift"] + window["start"]).alias("pos")))

    found = cells.join(small(per_item), "item").select(*keys, "item", F.explode(F.flatten(F.transform("windows", tries))).alias("try")).distinct()
    tried = found.groupBy(*keys, "item").agg(F.collect_list("try").alias("tries"))
    asked = small(items.select("item", "item_id", "item_words", "length"))
    return tried.join(asked, "item").groupBy(*keys).agg(F.collect_list(F.struct("item_id", "item_words", "length", "tries")).alias("candidates"))


def exact_spans(candidate: Column) -> Column:
    """Document places of the candidate's windows that stand there word by word, each as ``SPAN * start + length``."""
    hit = F.filter(
        candidate["tries"],
        lambda t: (t["pos"] >= 0)
        & (F.slice("words", F.greatest(t["pos"], F.lit(0)) + 1, candidate["length"]) == F.slice(candidate["item_words"], t["start"] + 1, candidate["length"])),
    )
    return F.transform(hit, lambda t: t["pos"].cast("bigint") * SPAN + candidate["length"])


def near(candidate: Column, slop: int) -> Column:
    """Whether all words of one of the candidate's windows stand within its length and ``slop`` words either side."""
    return F.exists(
        candidate["tries"],
        lambda t: F.forall(
            F.slice(candidate["item_words"], t["start"] + 1, candidate["length"]),
            lambda word: F.array_contains(F.slice("words", F.greatest(t["pos"] - slop, F.lit(0)) + 1, candidate["length"] + 2 * slop), word),
        ),
    )


def covered(spans: Column) -> Column:
    """Words in the union of spans in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("end"))

    def step(done: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0).cast("bigint"), span["to"] - F.greatest(done["end"], span["from"]))
        return F.struct((done["words"] + new).alias("words"), F.greatest(done["end"], span["to"]).alias("end"))

    return F.aggregate(spans, start, step, lambda done: done["words"])


def ids_of(hits: Column) -> Column:
    """The different ids of the hits in order, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(hits, lambda h: h["item_id"]))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per document: words, hit words, items with an occurring window, and near items.

    Columns ``doc_id``, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (sorted as strings),
    ``near_items`` and ``spans`` (from, to). A null or empty text has no words and no hits. Rows that
    repeat an id and text get the same result each. An empty benchmark leaves every document clean.
    Items with a null id give hits and spans, but no entry in ``items`` and ``near_items``.
    """
    keys = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", whole_text("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    tokens = texts.select(*keys, F.posexplode(ascii_words(F.col("text"))).alias("pos", "term"))
    items = settle(test_items(benchmark))
    counts = settle(term_counts(tokens.select("term"), items))
    windows = settle(test_windows(items, counts))
    lists = windows.select(F.explode("lists").alias("list")).select(F.col("list.term").alias("term"))
    index = settle(build_index(tokens, lists, keys))
    tried = settle(intersect(index, items, windows, keys, slop))
    named = small(tried.select(F.col("doc_id").alias("tried_id"), F.col("text_hash").alias("tried_hash")))
    same = F.col("doc_id").eqNullSafe(F.col("tried_id")) & (F.col("text_hash") == F.col("tried_hash"))
    read = texts.join(named, same, "left_semi").dropDuplicates(keys)
    tried = tried.withColumnsRenamed({"doc_id": "tried_id", "text_hash": "tried_hash"})
    read = read.join(tried, same).select(*keys, "candidates", ascii_words(F.col("text")).alias("words"))
    hits = F.transform("candidates", lambda c: F.struct(c["item_id"].cast("string").alias("item_id"), exact_spans(c).alias("spans"), near(c, slop).alias("near")))
    read = read.select(*keys, hits.alias("hits"))
    packed = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["spans"]))))
    begin = F.transform(packed, lambda s: F.struct(F.shiftright(s, SPAN_BITS).alias("from"), (F.shiftright(s, SPAN_BITS) + s.bitwiseAND(SPAN - 1)).alias("to")))
    found = read.select(
        F.col("doc_id").alias("tried_id"),
        F.col("text_hash").alias("tried_hash"),
        begin.alias("spans"),
        ids_of(F.filter("hits", lambda h: F.size(h["spans"]) > 0)).alias("items"),
        ids_of(F.filter("hits", lambda h: h["near"])).alias("near_items"),
    )
    found = found.withColumn("n_hit", covered(F.col("spans")))
    rows = texts.select(*keys, F.size(ascii_words(F.col("text"))).cast("long").alias("n_words")).join(found, same, "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *keys,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"),
    )
