"""Start streams into tables with a checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxaflow.session import new_shared_path, settle
from taxaflow.sources.keyed_tables import BUCKET_ROWS, rewrite, upsert_table

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepare(stream: DataFrame) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    spark = stream.sparkSession
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, STATE_STORE)


def append_to_table(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Append closed rows to a parquet table; ``once`` stops when the present input is used up."""
    _prepare(stream)
    checkpoint = checkpoint or new_shared_path(stream.sparkSession, "stream")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def upsert_to_table(
    stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str | None = None, once: bool = True, bucket_rows: int = BUCKET_ROWS
) -> StreamingQuery:
    """Keep the newest value per key in a table; a replayed batch changes nothing."""
    _prepare(stream)
    checkpoint = checkpoint or new_shared_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, _batch_id: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, keys, bucket_rows)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def add_to_table(batch: DataFrame, path: str, keys: Sequence[str], total: str, by: Sequence[str], stream: str, batch_id: int) -> None:
    """Add the ``total`` of every key in a batch to that of the table, once, however often the batch is replayed."""
    new = settle(batch)

    def change(old: DataFrame | None) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        others = [c for c in new.columns if c not in (*keys, total)]
        return both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in others), F.sum(total).alias(total)).select(*new.columns)

    rewrite(new.sparkSession, path, new.select(*by), by, change, adds=True, batch=(stream, batch_id))


def add_rows(batch: DataFrame, path: str, by: Sequence[str], stream: str, batch_id: int) -> None:
    """Append a batch to a keyed table, once, however often it is replayed."""
    new = settle(batch)

    def change(old: DataFrame | None) -> DataFrame:
        return new if old is None else old.unionByName(new)

    rewrite(new.sparkSession, path, new.select(*by), by, change, adds=True, batch=(stream, batch_id))
