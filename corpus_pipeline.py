"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame and works on all rows of the one before, which run()
writes to the shared folder as Parquet and reads again. All but the last return the columns of
``documents``; other columns of the input pass through unless they clash with a stage's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import bpe, decontaminate, quality, secrets, shingle_join
from taxaflow.session import new_shared_path

REDACTED = "[secret]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labelled documents here, does not reject."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    return quality.score(docs.select(*own), model).where("predicted = 1").select(*own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component, that with the least id.

    Rows equal in id and text are one document, of which one row stays; rows that repeat an id with
    another text are other documents. A null id comes after all others.
    """
    own = docs.columns
    keyed = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), F.struct(*own).alias("row"))
    found = shingle_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    found = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    ids = keyed.select("key", F.col("row.doc_id").alias("id")).distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key"))["key"]
    kept = ids.join(found, "key").groupBy("component").agg(least.alias("key")).select("key")
    once = keyed.join(kept, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return once.select(*(F.col("row")[c].alias(c) for c in own))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = leaks.where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
    same = docs["doc_id"].eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("hit_hash"))
    return docs.join(hit, same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and the length counted again."""
    own = [c for c in docs.columns if c != "found"]
    found = secrets.find_secrets(docs.select(*own))
    clean = F.when(F.size("found") > 0, secrets.redacted(F.col("text"), F.col("found"), REDACTED)).otherwise(F.col("text"))
    found = found.withColumn("text", clean)
    if "n_chars" in own:
        found = found.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*own)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests."""
    return bpe.encode(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", tokenize),
]

# A kernel classifier and a tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_shared_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
