"""Readers of job specs, log batches, benchmark files and object listings."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from taxaflow import schemas
from taxaflow.sources.keyed_tables import append_new_keys

LISTED_ROWS = 10_000  # objects of a listing that a task hands on at a time


def read_job_spec(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Job specs; each file is one JSON document, or has one document per line."""
    return spark.read.schema(schemas.JOB_SPEC).option("multiLine", one_per_file).json(path)


def spec_records(specs: DataFrame) -> DataFrame:
    """Records of a single spec with their order."""
    return specs.select(F.posexplode("job_params").alias("record_no", "r")).select(
        F.col("record_no").cast("bigint").alias("record_no"), "r.pipeline_run_ids", "r.background_ids"
    )


@F.pandas_udf(StringType())
def gunzip_base64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for payloads in batches:
        yield payloads.map(lambda p: None if p is None else gzip.decompress(base64.b64decode(p)).decode("utf-8"))


def decode_log_batches(payloads: DataFrame, column: str = "data") -> DataFrame:
    """Inline log payloads, gzipped JSON in base64, as ``logGroup, logStream, logEvents``.

    A filter on what is parsed must not reach the scan, or every task would unpack twice, with two Python workers.
    """
    parsed = F.from_json(gunzip_base64.asNondeterministic()(column), schemas.LOG_BATCH, {"mode": "FAILFAST"})
    return payloads.select(parsed.alias("b")).select("b.*")


def read_log_batches(spark: SparkSession, path: str) -> DataFrame:
    """Log batch files, one JSON document per line; ``.gz`` files are unpacked by their name."""
    return spark.read.schema(schemas.LOG_BATCH).json(path)


def load_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark CSV with a header; a row with another number of columns fails the load."""
    return (
        spark.read.schema(schemas.BENCHMARK_ROWS).option("header", True).option("mode", "FAILFAST").csv(path)
    )


def append_benchmarks(spark: SparkSession, path: str, table: str) -> None:
    """Append benchmark CSV files to a keyed table, each file once; the table is made if it is absent.

    Every row notes its file in ``loaded_from``, by path, size and time, which is also the ledger of loaded
    files; only the buckets of the files given are read for it, and only that column. Rows are written as
    they are parsed, without a shuffle. Nothing is appended when a row of any of the new files has another
    number of columns.
    """
    file = F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string"))
    append_new_keys(spark, table, load_benchmarks(spark, path).withColumn("loaded_from", file), ["loaded_from"])


class ObjectListing(DataSource):
    """Objects below the prefixes of a store, listed by tasks: one partition for every prefix.

    Options are ``root``, a folder or a store's URI, and ``prefixes``, a JSON list of folders below it. A
    task walks its prefix folder by folder and hands the objects on in batches, so no list of all of
    them is held anywhere. A prefix that does not exist has no objects.
    """

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return schemas.OBJECTS

    def reader(self, schema) -> DataSourceReader:
        return ObjectListingReader(self.options["root"].rstrip("/"), json.loads(self.options["prefixes"]))


class ObjectListingReader(DataSourceReader):
    def __init__(self, root: str, prefixes: list[str]):
        self.root, self.prefixes = root, prefixes

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(prefix) for prefix in self.prefixes]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        folders = [f"{root}/{partition.value.strip('/')}".rstrip("/")]
        while folders:
            found = store.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True))
            folders += [f.path for f in found if f.type == fs.FileType.Directory]
            objects = [f for f in found if f.type == fs.FileType.File]
            for at in range(0, len(objects), LISTED_ROWS):
                part = objects[at : at + LISTED_ROWS]
                columns = [
                    pa.array([f.path[len(root) + 1 :] for f in part], pa.string()),
                    pa.array([f.size for f in part], pa.int64()),
                    pa.array([f.mtime.astimezone(dt.timezone.utc).replace(tzinfo=None) for f in part], pa.timestamp("us")),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "last_modified"])


def list_store(spark: SparkSession, root: str, prefixes: Sequence[str], suffix: str = "") -> DataFrame:
    """Objects below the prefixes of a store as a listing table, with a suffix; tasks do the listing.

    Prefixes are folders that do not contain each other; a prefix inside another one is left out, since
    the outer one lists it.
    """
    spark.dataSource.register(ObjectListing)
    folders = sorted({p.strip("/") for p in prefixes})
    outer = [p for p in folders if not any(p != q and (q == "" or p.startswith(q + "/")) for q in folders)]
    listing = spark.read.format("object_listing").option("root", root).option("prefixes", json.dumps(outer)).load()
    return list_objects(listing, suffix=suffix)


def list_objects(listing: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Objects of a listing table ``key, size, last_modified`` under a prefix, with a suffix.

    A store with more objects than a driver can list is read from its inventory, a table like this.
    """
    return listing.filter(F.col("key").startswith(prefix) & F.col("key").endswith(suffix)).select("key", "size", "last_modified")


def list_folder(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Files below a path as a listing table; their content is not read, their names pass the driver."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix)
        .load(path)
        .select(
            F.col("path").alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"),
        )
    )
