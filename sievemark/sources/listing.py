"""Drive listings stored as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.operators.registry import ingest_listing

RAW_LISTING = ("id string, name string, mimeType string, createdTime timestamp, trashed boolean, "
               "owners array<struct<emailAddress: string>>")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listable files with their first owner; the schema is given, so nothing is inferred."""
    return ingest_listing(spark.read.schema(RAW_LISTING).json(path))
