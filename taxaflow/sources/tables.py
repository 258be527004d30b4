"""Table scans: columnar files and relational databases."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one directory, ``<name>.parquet`` each, read lazily."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        """Read a table on first use and keep the lazy frame, so its footers are listed once."""
        if name.startswith("_"):
            raise AttributeError(name)
        frame = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Columnar scan; filters and column lists of the caller reach the files."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def jdbc_options(
    url: str,
    table: str,
    *,
    user: str | None = None,
    password: str | None = None,
    key: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    fetch_size: int = 1000,
    connect_timeout_s: int = 10,
    tls: bool = True,
) -> dict[str, str]:
    """Options of a relational scan: rows arrive ``fetch_size`` at a time from ``partitions`` readers.

    ``key``/``lower``/``upper`` only shape the ranges read in parallel; rows outside are still read.
    """
    options = {
        "url": url,
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "connectTimeout": str(connect_timeout_s * 1000),
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if tls:
        options["sslMode"] = "REQUIRED"
    if key is not None:
        if lower is None or upper is None:
            raise ValueError("a partition key needs lower and upper bounds")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def key_bounds(keys: DataFrame, key: str, partitions: int, accuracy: int = 10_000) -> list[int]:
    """Whole-number keys that cut the rows into parts of about equal size, by a quantile sketch of the column.

    ``keys`` has the key column of an index, an earlier copy or a sample of the table. A key that
    fills a part or more has a range of its own.
    """
    shares = [i / partitions for i in range(1, partitions)]
    found = keys.agg(F.percentile_approx(key, shares, accuracy).alias("cuts")).first()["cuts"] if shares else None
    hot = {k for k, n in Counter(found or []).items() if n > 1}
    return sorted({*(found or []), *hot, *(k + 1 for k in hot)})


def range_predicates(key: str, bounds: Sequence[int], hot_split: str | None = None, hot_parts: int = 1) -> list[str]:
    """Predicates that hold for every row once: the ranges between the bounds, and null keys with the first.

    With ``hot_split``, another whole-number column, a range of a single key is dealt into ``hot_parts``
    by its remainder.
    """
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(bounds, bounds[1:], strict=False)]
    ranges = [f"({key} < {bounds[0]} OR {key} IS NULL)", *inner, f"{key} >= {bounds[-1]}"]
    if hot_split is None or hot_parts < 2:
        return ranges
    dealt = [f"COALESCE(ABS({hot_split}), 0) % {hot_parts} = {i}" for i in range(hot_parts)]
    single = {f"{key} >= {low} AND {key} < {high}" for low, high in zip(bounds, bounds[1:], strict=False) if high == low + 1}
    return [p for r in ranges for p in ([f"{r} AND {d}" for d in dealt] if r in single else [r])]


def scan_jdbc(spark: SparkSession, options: dict[str, str], predicates: Sequence[str] | None = None) -> DataFrame:
    """A relational scan, in ranges of equal width by its options, or one reader for every predicate."""
    if predicates is None:
        return spark.read.format("jdbc").options(**options).load()
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=properties)
