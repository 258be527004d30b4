"""Near duplicates by a grouped prefix join on word shingles.

A document's set is its distinct k-word shingles. Sets are ordered by one order for the whole
corpus, common shingles last, and two sets that are similar enough share a shingle of their prefixes.
Documents of equal sets are one unit; units of equal prefix and size are one group. A group leaves a
shingle's list if its shared prefix shingles are too few for every size in the list. Groups that share
a prefix shingle early enough are paired, and pairs whose prefixes share too little to reach the
threshold are dropped; what is left is expanded to units and verified on the whole sets.

Large clusters of near copies would give all pairs of their members, so pairs are made in two steps.
First every group is compared with a few leaders of the lists it is in, those it shares most prefix
shingles with, and every unit with the first of its group. Leaders have few shingles of their own, so
they are the likeliest links of a cluster. Then pairs are made only between groups
not yet connected, where one side is not the list's main component. Both steps verify links; what
the second leaves out are pairs inside a component, which cannot change the components.

Narrow tables between the steps are staged; whole sets and prefixes are checkpoints, which Spark can remove once unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import slices, small_batches, whole_text
from taxaflow.llm.components import components
from taxaflow.session import new_shared_path, settle, staged

COMMON_SHINGLES = 262_144  # shingles known as common; others count as rare, which affects speed only
COMMON_REPEATS = 3  # repeats in one task's run that make a shingle a candidate for that
RUN_SHINGLES = 2_000_000
PART_BYTES = 1 << 19  # text, or hashes of one side, that a task turns into arrays at a time; these take up to fifty times that
BROADCAST_ROWS = 500_000  # ids and digests, 24 bytes each
LEADERS = 12  # of a list of groups, each the one with most shared prefix shingles in its share of them; also the most for a group

_draw = np.random.default_rng(9)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE = _draw.integers(1, 2**64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _draw.integers(1, 2**64, 64, np.uint64) | np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    data = FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    solid = ~BLANK[data]
    edges = np.diff(solid.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    places = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    return mixed(np.add.reduceat(BYTE[data[solid]] * powers[places], at)), counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Distinct shingles of each text as sorted hashes; the whole sequence of a text of fewer words."""
    words, counts = word_hashes(texts)
    width = len(words) - k + 1
    joined = np.zeros(max(0, width), np.uint64)
    for place in range(k if width > 0 else 0):
        joined += words[place : place + width] * PLACE[place]
    joined, sets, at = mixed(joined), [], 0
    for count in counts.tolist():
        if count >= k:
            sets.append(np.unique(joined[at : at + count - k + 1]))
        else:
            short = words[at : at + count]
            sets.append(mixed((short * PLACE[:count]).sum(keepdims=True) + PLACE[63:] * np.uint64(count)) if count else short)
        at += count
    return sets


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def frequent(k: int):
    """Function that emits the shingles which repeat among the different sets of a run of documents."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        different = {hashlib.blake2b(s, digest_size=16).digest(): s for s in sets}
        shingles = np.concatenate(list(different.values()))
        sets.clear()
        different.clear()
        shingles.sort()
        more = COMMON_REPEATS - 1  # one that stands so many places further on as well
        often = np.unique(shingles[more:][shingles[more:] == shingles[:-more]])
        counts = np.searchsorted(shingles, often, "right") - np.searchsorted(shingles, often)
        return pa.RecordBatch.from_arrays([signed(often), pa.array(counts, pa.int64())], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                sets = shingle_sets(raw_texts(part), k)
                held += sets
                size += sum(map(len, sets))
                if size >= RUN_SHINGLES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def describe(k: int, percent: int, common: np.ndarray):
    """Function from documents to their set's size, digest, prefix and group; ``common`` is in order."""
    by_value = np.argsort(common)
    sorted_common = common[by_value]

    def places(shingles: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(sorted_common, shingles), len(common) - 1)
        return np.where(sorted_common[at] == shingles, by_value[at] + 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                sizes, digests, groups, prefixes = [], [], [], []
                for shingles in shingle_sets(raw_texts(part), k):
                    n = len(shingles)
                    order = np.lexsort((shingles, places(shingles)))[: prefix_length(n, percent) if n else 0]
                    prefix = shingles[order].view(np.int64)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    groups.append(int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                    prefixes.append(prefix)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "grp", "prefix"],
                )

    return run


def hash_sets(k: int):
    """Function from documents to their sets' digests and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                raw = [s.tobytes() for s in shingle_sets(raw_texts(part), k)]
                digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["unit", "digest", "hashes"])

    return run


def compare(percent: int):
    """Function that keeps the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a_hashes", PART_BYTES):
                kept = []
                for a, b in zip(part.column("a_hashes").to_pylist(), part.column("b_hashes").to_pylist(), strict=True):
                    left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    kept.append(100 * both >= percent * (len(left) + len(right) - both))
                mask = pa.array(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    return run


def fitting(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def overlap(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of sets of these sizes that are similar enough."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-6)


def early(place: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether the place in a set of size n is one of those where it must meet a partner of size m.

    Of the places beyond, there are fewer than the least intersection.
    """
    return place <= n - overlap(n, m, percent)


def enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets that share so many prefix shingles can be similar enough.

    The set whose prefix ends first shares nothing with the other before that but what both prefixes
    have, so beyond it only its own rest can be shared.
    """
    rest = F.greatest(F.ceil(n * percent / 100), F.ceil(m * percent / 100)) - 1
    return shared + rest >= overlap(n, m, percent)


def hopeful(known: Column, n: Column, low: Column, high: Column, percent: int) -> Column:
    """Whether a set with so many shared prefix shingles can be similar enough to any of these sizes.

    The shared prefix shingles that a partner of size m asks for are more than
    ``(n + m) * p / (100 + p) - max(n, m) * p / 100``, which is least at one end of the sizes.
    """

    def asked(m: Column) -> Column:
        return (n + m) * percent / (100 + percent) - F.greatest(n, m) * percent / 100

    smallest, largest = F.greatest(low, n * percent / 100), F.least(high, n * 100 / percent)
    return known > F.least(asked(smallest), asked(largest)) - 1e-6


def verified(pairs: DataFrame, texts: DataFrame, units: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of units whose whole sets are similar enough, as a staged table of links."""
    pairs = staged(pairs)
    ids = pairs.select(F.col("a").alias("unit")).union(pairs.select(F.col("b").alias("unit"))).distinct()
    sets = gather(texts, staged(units.join(ids, "unit", "left_semi").select("unit", "digest")), k)
    left = sets.select(F.col("unit").alias("a"), F.col("hashes").alias("a_hashes"))
    right = sets.select(F.col("unit").alias("b"), F.col("hashes").alias("b_hashes"))
    links = pairs.join(left, "a").join(right, "b").mapInArrow(compare(percent), "a long, b long")
    return staged(links.distinct())


def promising(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of groups whose prefixes share enough; the wanted groups are broadcast while they are few."""
    pairs = staged(pairs)
    ids = staged(pairs.select(F.col("g").alias("grp")).union(pairs.select(F.col("h").alias("grp"))).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    prefixes = settle(rows.join(ids, "grp", "left_semi").groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    left = prefixes.select(F.col("grp").alias("g"), F.struct("n", "prefix").alias("x"))
    right = prefixes.select(F.col("grp").alias("h"), F.struct("n", "prefix").alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    shared = F.size(F.array_intersect("x.prefix", "y.prefix"))
    return pairs.join(left, "g").join(right, "h").where(fitting(n, m, percent) & enough(shared, n, m, percent)).select("g", "h")


def gather(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Whole shingle sets of the wanted units; their ids are broadcast while they are few."""
    few = wanted.count() <= BROADCAST_ROWS
    asked = F.broadcast(wanted) if few else wanted
    found = texts.join(asked.select(F.col("unit").alias("doc_id")), "doc_id", "left_semi")
    found = found.mapInArrow(hash_sets(k), "unit long, digest binary, hashes binary")
    return settle(found.join(asked, ["unit", "digest"]).select("unit", "hashes"))


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """The most common shingles, most common last; a fixed number at most."""
    counts = texts.select("text").mapInArrow(frequent(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    return rows.column("shingle").to_numpy()[::-1].view(np.uint64)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which is smaller there than a checkpoint."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: the size of its shingle set and its component.

    Two documents link when ``100 * intersection >= percent * union``. ``component_id`` is the least
    id reachable by links, the document's own included. A document without words, or with a null
    text, has size 0 and links with nothing. Rows that repeat an id and text give equal rows; a null
    id is its own component, null, unless its set equals another's. Other columns are left out.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    common = common_shingles(texts, k)
    rows = written(texts.mapInArrow(describe(k, percent, common), "doc_id long, n long, digest binary, grp long, prefix array<long>"), "sets")
    units = staged(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("unit"), F.first("n").alias("n"), F.first("grp").alias("grp")).where("unit IS NOT NULL"))

    postings = rows.where("n > 0").select(F.posexplode("prefix").alias("place", "shingle"), "grp", "n")
    shared = postings.groupBy("shingle").agg(F.min("grp").alias("least"), F.max("grp").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = staged(shared.where("least <> most").select("shingle", "low", "high"))
    postings = postings.join(shared, "shingle").groupBy("shingle", "grp", "n", "place", "low", "high").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    postings = written(postings, "postings")
    known = staged(postings.groupBy("grp").agg(F.count(F.lit(1)).alias("known")))
    hope = hopeful(F.col("known"), F.col("n"), F.col("low"), F.col("high"), percent)
    smallest = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    postings = postings.join(known, "grp").where(hope & early(F.col("place"), F.col("n"), smallest, percent)).drop("low", "high")
    postings = written(postings, "postings")

    many = units.groupBy("grp").agg(F.min("unit").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("units"))
    many = staged(many)

    # A few leaders for every group, the first unit for every other unit of a group.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    banded = postings.withColumn("band", band)
    drawn = [F.max(F.when(F.pmod(F.xxhash64("grp"), F.lit(LEADERS)) == turn, F.struct("known", "grp")))["grp"] for turn in range(LEADERS)]
    lead = F.array_compact(F.array(*drawn))
    leaders = staged(banded.groupBy("shingle", "band").agg(lead.alias("leaders"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups"))
    votes = banded.join(leaders, ["shingle", "band"]).select("grp", F.explode("leaders").alias("leader")).where("grp <> leader")
    votes = votes.groupBy("grp", "leader").agg(F.count(F.lit(1)).alias("votes"))
    led = votes.groupBy("grp").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "leader")), False), 1, LEADERS).alias("best"))
    led = led.select("grp", F.explode("best.leader").alias("leader")).select(F.least("grp", "leader").alias("g"), F.greatest("grp", "leader").alias("h"))
    firsts = many.select("grp", "first")
    led = promising(led.distinct(), rows, percent).join(firsts.select(F.col("grp").alias("g"), F.col("first").alias("a")), "g")
    led = led.join(firsts.select(F.col("grp").alias("h"), F.col("first").alias("b")), "h").select("a", "b")
    inside = units.join(many.where("units > 1"), "grp").where("unit <> first").select(F.col("unit").alias("a"), F.col("first").alias("b"))
    links = verified(led.union(inside), texts, units, k, percent)
    joined = components(links)

    # Pairs between what is not connected yet.
    placed = units.join(joined, units["unit"] == joined["node"], "left").select("unit", "n", "grp", F.coalesce("component", "unit").alias("component"))
    placed = staged(placed)
    groups = placed.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    groups = staged(groups.select("grp", F.when(F.col("low") == F.col("high"), F.struct("low", F.lit(None).cast("long").alias("split"))).otherwise(F.struct("low", F.col("grp").alias("split"))).alias("side")))
    sided = staged(postings.join(groups, "grp"))
    per_side = sided.groupBy("shingle", "side").agg(F.count(F.lit(1)).alias("groups"))
    main = per_side.groupBy("shingle").agg(F.max(F.struct("groups", "side")).alias("main"), F.count(F.lit(1)).alias("sides")).where("sides > 1")
    main = staged(main.select("shingle", F.col("main.side").alias("main")))
    sided = staged(sided.join(main, "shingle"))
    kept = [F.col(c) for c in ("n", "place", "known", "side")]
    minor = sided.where(~F.col("side").eqNullSafe(F.col("main"))).select("shingle", F.col("grp").alias("g"), F.struct(*kept).alias("x"))
    other = sided.select("shingle", F.col("grp").alias("h"), F.struct(*kept).alias("y"), F.col("side").eqNullSafe(F.col("main")).alias("in_main"))
    n, m = F.col("x.n"), F.col("y.n")
    apart = ~F.col("x.side").eqNullSafe(F.col("y.side")) & (F.col("in_main") | (F.col("g") < F.col("h"))) & fitting(n, m, percent)
    apart = apart & early(F.col("x.place"), n, m, percent) & early(F.col("y.place"), m, n, percent)
    apart = apart & enough(F.least("x.known", "y.known"), n, m, percent)
    pairs = minor.join(other, "shingle").where(apart).select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    pairs = staged(promising(pairs, rows, percent))
    left = placed.select(F.col("grp").alias("g"), F.col("unit").alias("a"), F.col("component").alias("a_component"))
    right = placed.select(F.col("grp").alias("h"), F.col("unit").alias("b"), F.col("component").alias("b_component"))
    across = pairs.join(left, "g").join(right, "h").where("a_component <> b_component").select("a", "b")
    within = groups.where("side.split IS NOT NULL").select(F.col("grp").alias("g"))
    within = within.join(left, "g").join(right, F.col("g") == F.col("h")).where("a_component <> b_component AND a < b").select("a", "b")
    more = verified(across.union(within), texts, units, k, percent)
    joined = components(links.union(more))

    by_set = units.join(joined, units["unit"] == joined["node"], "left").select("digest", F.coalesce("component", "unit").alias("component_id"))
    by_set = staged(by_set)
    linked = rows.where("n > 0").select("doc_id", "n", "digest").join(by_set, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(empty)

