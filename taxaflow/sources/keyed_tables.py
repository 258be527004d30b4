"""Keyed Parquet tables whose versions are immutable and whose full buckets split.

A table is a folder:

    data/<write>/bucket_group=g<bits>/*.parquet  rows of the buckets that start with the bits, each with its bucket and write
    _versions/<number>.json                      one version: its schema, and the folder and rows of every bucket

A write puts the rows of the touched buckets into a folder of its own, complete, and then creates the
next version file, which must not exist yet. That file is the only thing that makes the write visible,
so a reader has the old table or the new one, a write that breaks off changes nothing, and of two
writers one fails and can repeat. Folders that no kept version names go with ``expire_versions``.

Small buckets of one write share a folder of about ``GROUP_BUCKETS``, so files grow more slowly
than the buckets. A bucket that a later write replaces stays in such a folder, unread, until the folder goes.

Buckets cover the hash range as a prefix code. A touched bucket that would hold more than
``bucket_rows`` rows is split by as many further bits as that takes, so what one run's write moves
depends on that size and not on the table's.

An append of new keys leaves the rows of a bucket where they are and adds a folder to it. A bucket that has
``MOST_FOLDERS`` of them is rewritten into one by the next append, and split if it is full.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taxaflow.session import briefly_staged, settle, shuffles_dropped

RUN_KEY = ("pipeline_run_id",)
BUCKET_ROWS = 4_000_000
GROUP_ROWS, GROUP_BUCKETS = 1_000_000, 16  # a shared folder holds about as many at most, whichever is reached first
UNDEALT_ROWS, UNDEALT_FOLDERS = 500_000, 32  # a write of folders that hold more each, and of no more folders, is not dealt by them
PUSHED_BUCKETS = 100  # as many are named in a filter that reaches the files
MOST_FOLDERS = 16  # of a bucket that is only appended to
BROADCAST_KEYS = 100_000  # keys of an append, about a path long each, or rows that an upsert leaves
PLACE = ["_bucket", "_write"]
VERSIONS = "_versions"  # readers of plain Parquet skip folders that start with an underscore
HASH_BITS = 64


class CommitConflict(OSError):
    """Another writer created the version first; nothing of this write is visible, and it can be repeated."""


class Bucket(NamedTuple):
    folder: str | None  # relative to the table; None without rows
    rows: int
    older: Sequence[str] = ()  # folders of earlier writes that were appended to

    @property
    def folders(self) -> list[str]:
        return [self.folder, *self.older] if self.folder else []


class Version(NamedTuple):
    number: int
    schema: StructType
    buckets: dict[str, Bucket]
    applied: dict[str, int]  # last batch of every stream that writes here


# ---- versions -------------------------------------------------------------------------------


def file_system(spark: SparkSession, path: str):
    """Constructor of paths, and the file system that holds ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder, folder(path).getFileSystem(spark._jsc.hadoopConfiguration())


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = file_system(spark, path)
    place = folder(f"{path}/{VERSIONS}")
    if not files.exists(place):
        return []
    names = (status.getPath().getName() for status in files.listStatus(place))
    return sorted(int(name[:-5]) for name in names if name.endswith(".json"))


def read_version(spark: SparkSession, path: str, number: int) -> Version | None:
    """The version, or None if its file is not complete: its writer broke off, or is still at it."""
    folder, files = file_system(spark, path)
    stream = files.open(folder(f"{path}/{VERSIONS}/{number:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        held = json.loads(text)
    except ValueError:
        return None
    return Version(number, StructType.fromJson(held["schema"]), {bits: Bucket(*b) for bits, b in held["buckets"].items()}, held["applied"])


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The newest complete version, or None before the first."""
    for number in reversed(version_numbers(spark, path)):
        version = read_version(spark, path, number)
        if version is not None:
            return version
    return None


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Create the version's file, which makes it the current one."""
    folder, files = file_system(spark, path)
    text = json.dumps({"schema": json.loads(version.schema.json()), "buckets": version.buckets, "applied": version.applied})
    try:
        out = files.create(folder(f"{path}/{VERSIONS}/{version.number:012d}.json"), False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise CommitConflict(f"version {version.number} of {path} was written by another job") from error
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


# ---- reads ----------------------------------------------------------------------------------


def read_buckets(spark: SparkSession, path: str, version: Version, bits: Iterable[str]) -> DataFrame:
    chosen = {b: version.buckets[b].folders for b in bits if version.buckets[b].folder}
    if not chosen:
        return spark.createDataFrame([], version.schema)
    folders = [f"{path}/{folder}" for folder in sorted({f for held in chosen.values() for f in held})]
    placed = StructType([*version.schema.fields, *(StructField(c, StringType()) for c in PLACE)])
    rows = spark.read.schema(placed).parquet(*folders)
    if len(chosen) <= PUSHED_BUCKETS:
        rows = rows.where(F.col("_bucket").isin(list(chosen)))
    live = spark.createDataFrame([(b, folder.split("/")[1]) for b, held in chosen.items() for folder in held], ", ".join(f"{c} STRING" for c in PLACE))
    return rows.join(F.broadcast(live), PLACE, "left_semi").select(*version.schema.names)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's current version; later writes do not change the frame."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return read_buckets(spark, path, version, version.buckets)


# ---- writes ---------------------------------------------------------------------------------


def bucket_of(bits: Iterable[str], by: Sequence[str]) -> Column:
    """The one of the prefixes that the row's key hash starts with; what starts with no shorter one has the longest."""
    of_length: dict[int, list[str]] = {}
    for b in bits:
        of_length.setdefault(len(b), []).append(b)
    hashed = f"lpad(bin(xxhash64({', '.join(f'`{c}`' for c in by)})), {HASH_BITS}, '0')"
    *shorter, longest = sorted(of_length)
    cases = [f"WHEN left({hashed}, {n}) IN ({', '.join(repr(b) for b in of_length[n])}) THEN left({hashed}, {n})" for n in shorter]
    return F.expr(f"CASE {' '.join(cases)} ELSE left({hashed}, {longest}) END" if cases else f"left({hashed}, {longest})")


def split_bits(bits: str, rows: int, bucket_rows: int) -> list[str]:
    """The bucket itself, or what it splits into so that about ``bucket_rows`` rows fall into each."""
    more = min(max(0, -(-rows // bucket_rows) - 1).bit_length(), HASH_BITS - len(bits))
    return [bits + f"{i:0{more}b}" for i in range(1 << more)] if more else [bits]


def write_buckets(
    spark: SparkSession, path: str, rows: DataFrame, made: list[str], by: Sequence[str], expected: int, bucket_rows: int, deal: bool = True
) -> dict[str, Bucket]:
    """Write the rows of the buckets ``made`` into a folder of their own; what each bucket has there.

    Rebalancing sizes the write tasks: small buckets share one, a large bucket gets several. Rows of which every
    task has few buckets anyway need not be dealt, and few large folders are not worth moving all rows once more:
    each task then writes a file to each of them.
    """
    group_bits = len(split_bits("", expected, max(bucket_rows, min(GROUP_ROWS, GROUP_BUCKETS * bucket_rows)))[0])
    name = uuid.uuid4().hex
    write = f"data/{name}"
    named = rows.withColumns({"_bucket": bucket_of(made, by), "_write": F.lit(name)})
    named = named.withColumn("bucket_group", F.concat(F.lit("g"), F.substring("_bucket", 1, group_bits)))
    large = 1 << group_bits <= UNDEALT_FOLDERS and expected >= UNDEALT_ROWS << group_bits
    dealt = named.hint("rebalance", F.col("bucket_group")) if deal and not large else named
    ordered = dealt.sortWithinPartitions("bucket_group", "_bucket")
    with shuffles_dropped(spark):
        ordered.write.option("compression", "zstd").partitionBy("bucket_group").parquet(f"{path}/{write}")
    counts = spark.read.schema(named.schema).parquet(f"{path}/{write}").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(made, Bucket(None, 0)) | {r["_bucket"]: Bucket(f"{write}/bucket_group=g{r['_bucket'][:group_bits]}", r["n"]) for r in counts}


def publish_next(spark: SparkSession, path: str, version: Version | None, schema: StructType, buckets: dict[str, Bucket], applied: dict[str, int]) -> None:
    """Publish the buckets as the version after ``version``, which must still be the current one."""
    number = max(version_numbers(spark, path), default=0) + 1
    newest = current_version(spark, path)
    if (newest.number if newest else 0) != (version.number if version else 0):
        raise CommitConflict(f"{path} was written by another job")
    publish(spark, path, Version(number, schema, buckets, applied))


def rewrite(
    spark: SparkSession,
    path: str,
    touching: DataFrame,
    by: Sequence[str],
    change: Callable[[DataFrame | None], DataFrame],
    *,
    adds: bool,
    bucket_rows: int = BUCKET_ROWS,
    batch: tuple[str, int] | None = None,
) -> None:
    """Replace the rows of the buckets that ``touching`` falls into by ``change`` of them, as one new version.

    ``batch`` names a stream and its batch: the version notes it, and a batch that was applied before
    is skipped.
    """
    version = current_version(spark, path)
    applied = version.applied if version else {}
    if batch and applied.get(batch[0], -1) >= batch[1]:
        return
    held = version.buckets if version else {"": Bucket(None, 0)}
    arriving = touching.groupBy(bucket_of(held, by).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
    if not arriving and version:
        return
    expected = {r["bits"]: held[r["bits"]].rows + (r["n"] if adds else 0) for r in arriving}
    touched = {bits: split_bits(bits, n, bucket_rows) for bits, n in expected.items()} or {"": [""]}
    made = [b for bits in touched.values() for b in bits]
    rows = change(read_buckets(spark, path, version, touched) if version else None)
    buckets = {bits: bucket for bits, bucket in held.items() if bits not in touched}
    buckets |= write_buckets(spark, path, rows, made, by, sum(expected.values()), bucket_rows)
    publish_next(spark, path, version, rows.schema, buckets, {**applied, **dict([batch] if batch else [])})


def append_new_keys(spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> None:
    """Add the rows whose key ``by`` the table does not hold yet, as one new version; the table is made if it is absent.

    Rows that the table holds stay where they are; of them only the keys are read, in the buckets of the new
    ones. Keys are not null and few beside their rows, which lie together in ``rows``, as those of a file do.
    ``rows`` is read twice, first for the keys only.
    """
    version = current_version(spark, path)
    held = version.buckets if version else {"": Bucket(None, 0)}
    keys = settle(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    bits = bucket_of(held, by).alias("bits")
    if version:
        asked = [r["bits"] for r in keys.select(bits).distinct().collect()]  # a row a bucket
        keys = settle(keys.join(read_buckets(spark, path, version, asked).select(*by).distinct(), list(by), "left_anti"))
    arriving = {r["bits"]: r["n"] for r in keys.groupBy(bits).agg(F.sum("n").alias("n")).collect()}  # a row a bucket
    if not arriving and version:
        return
    few = keys.count() <= BROADCAST_KEYS
    new = rows.join(F.broadcast(keys) if few else keys, list(by), "left_semi").select(*rows.columns)
    merged = [b for b in arriving if len(held[b].folders) >= MOST_FOLDERS]
    expected = {b: n + (held[b].rows if b in merged else 0) for b, n in arriving.items()}
    touched = {b: split_bits(b, n, bucket_rows) if b in merged or not held[b].folder else [b] for b, n in expected.items()} or {"": [""]}
    if merged:
        new = read_buckets(spark, path, version, merged).unionByName(new)
    made = [b for bits in touched.values() for b in bits]
    found = write_buckets(spark, path, new, made, by, sum(expected.values()), bucket_rows, deal=bool(merged) or not few)
    for b in arriving.keys() - merged:
        if held[b].folder:
            found[b] = Bucket(found[b].folder, held[b].rows + found[b].rows, held[b].folders) if found[b].folder else held[b]
    buckets = {b: bucket for b, bucket in held.items() if b not in touched}
    publish_next(spark, path, version, new.schema, buckets | found, version.applied if version else {})


def upsert_documents(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` replacing those of the same key.

    Rows whose key is absent from ``new`` stay, so a taxon that disappeared keeps its old document.
    ``new`` has each key once.
    """
    kept = existing.join(new.select(*keys), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(new)


def upsert_staged(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``upsert_documents`` of rows that can be read again and again, found by their keys before any row is moved whole.

    An upsert that repeats or renews what is there leaves few of the rows of its buckets, and these are picked out
    where they lie. Rows that stay may have null keys.
    """
    if new.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return upsert_documents(existing, new, keys)
    left = existing.select(*keys).join(new.select(*keys), list(keys), "left_anti")
    with shuffles_dropped(existing.sparkSession):
        few = left.limit(BROADCAST_KEYS + 1).count()
    if few > BROADCAST_KEYS:
        return upsert_documents(existing, new, keys)
    if not few:
        return new.select(*existing.columns)
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_left_{k}")) for k in keys))
    kept = existing.join(F.broadcast(left.select(*(F.col(k).alias(f"_left_{k}") for k in keys))), same, "left_semi")
    return kept.unionByName(new)


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], by: Sequence[str] = RUN_KEY, bucket_rows: int = BUCKET_ROWS
) -> None:
    """Upsert into a keyed table; ``by``, a part of the keys, is what its buckets are hashed by.

    By default a run's rows share one bucket, so a run touches one bucket whatever it holds, and
    the files of all other buckets stay. Running the same upsert again gives the same rows.
    """
    with briefly_staged(new) as rows:

        def merge(old: DataFrame | None) -> DataFrame:
            return rows if old is None else upsert_staged(old, rows, keys)

        rewrite(spark, path, rows.select(*by), by, merge, adds=True, bucket_rows=bucket_rows)


def delete_rows(
    spark: SparkSession, path: str, gone: DataFrame, keep: Callable[[DataFrame], DataFrame], by: Sequence[str] = RUN_KEY, bucket_rows: int = BUCKET_ROWS
) -> None:
    """Make ``keep`` of the buckets that hold keys of ``gone`` their rows; all other buckets stay."""
    if current_version(spark, path) is None:
        raise FileNotFoundError(f"no table at {path}")
    rewrite(spark, path, gone.select(*by).distinct(), by, keep, adds=False, bucket_rows=bucket_rows)


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the buckets that only they name; how many versions went.

    The caller keeps as many versions as its longest reader may still be reading. Version files go
    last, so a removal that broke off is finished by the next one.
    """
    folder, files = file_system(spark, path)
    numbers = version_numbers(spark, path)
    versions = {n: v for n in numbers if (v := read_version(spark, path, n)) is not None}
    kept = sorted(versions)[-keep:]
    gone = [n for n in versions if n not in kept]
    named = {f for n in kept for b in versions[n].buckets.values() for f in b.folders}
    for place in sorted({f for n in gone for b in versions[n].buckets.values() for f in b.folders} - named):
        target = folder(f"{path}/{place}")
        if files.exists(target) and not files.delete(target, True):
            raise OSError(f"{target} could not be removed")
    for n in gone:
        files.delete(folder(f"{path}/{VERSIONS}/{n:012d}.json"), False)
    return len(gone)
