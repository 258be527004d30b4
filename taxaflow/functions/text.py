"""Name, URI and binary helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_upper(name: Column) -> Column:
    """``NonHostAlignment`` to ``NON_HOST_ALIGNMENT``; a word after an acronym starts a new part."""
    parted = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.upper(F.regexp_replace(parted, r"([a-z0-9])([A-Z])", "$1_$2"))


def snake_upper_acronyms(name: Column) -> Column:
    """``DownloadNT`` to ``DOWNLOAD_NT``; a part starts only where an upper letter follows another kind."""
    return F.upper(F.regexp_replace(name, r"(?<=[^A-Z])(?=[A-Z])", "_"))


def stage_uri_key(stage: Column, direction: str) -> Column:
    """Key of a stage's input or output document, as ``NON_HOST_ALIGNMENT_INPUT_URI``."""
    return F.concat(snake_upper(stage), F.lit(f"_{direction.upper()}_URI"))


def uri_bucket(uri: Column) -> Column:
    """Bucket of an object URI, NULL for any other scheme."""
    return F.nullif(F.regexp_extract(uri, "^s3://([^/]+)/(.*)$", 1), F.lit(""))


def uri_key(uri: Column) -> Column:
    """Key of an object URI, NULL for any other scheme."""
    return F.when(uri.rlike("^s3://[^/]+/"), F.regexp_extract(uri, "^s3://([^/]+)/(.*)$", 2))


def major_version(workflow: Column) -> Column:
    """``short-read-v8.3.1`` to ``short-read-8``."""
    return F.regexp_replace(workflow, r"v(\d+)\..+", "$1")


def is_gzip(content: Column) -> Column:
    """Whether binary content starts with the gzip magic bytes."""
    return F.substring(content, 1, 2) == F.expr("X'1F8B'")
