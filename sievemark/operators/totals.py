"""Figures kept up to date by changes instead of recounted.

A batch on a stored table (``operators.stored``) hands back the rows of its buckets before and after. Counted with the signs -1
and +1 they are what the figures change by; equal rows cancel out. The signed counts are folded into a stored
table of totals per key, of which again only the touched buckets are read and written. So the cost follows the
batch, and a repeated batch, whose rows do not change, changes no figure. A key whose counts are all 0 leaves
the table, so the number of keys is the count of distinct keys in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.governance import percent
from sievemark.operators import kpis, stored
from sievemark.operators.stored import Applied, StoredTable
from sievemark.session import discard, scratch_folder, written_to

def _registry_counts() -> dict[str, Column]:
    return {"files": F.lit(1), "flagged": kpis.is_flagged().cast("int"), "processed": kpis.is_processed().cast("int")}


def _finding_counts() -> dict[str, Column]:
    return {"findings": F.lit(1)}


def _counted(rows: DataFrame, key: str, counts: dict[str, Column], sign: int) -> DataFrame:
    return rows.select(F.col(key), *[(sign * c).cast("bigint").alias(name) for name, c in counts.items()])


def _summed(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    kept = F.greatest(*[F.abs(F.col(n)) for n in names], F.lit(0)) > 0
    return rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in names]).where(kept)


def _start(rows: DataFrame, folder: str, key: str, counts: dict[str, Column], buckets: int) -> StoredTable:
    return stored.create(_summed(_counted(rows, key, counts, 1), key, list(counts)), folder, key, buckets)


def _fold(totals: StoredTable, done: Applied, counts: dict[str, Column]) -> Applied:
    if not set(counts) <= set(totals.schema.fieldNames()):
        raise ValueError("these totals count something else")
    change = _summed(_counted(done.before, totals.key, counts, -1).unionByName(
        _counted(done.after, totals.key, counts, 1)), totals.key, list(counts))
    spark, folder = done.before.sparkSession, scratch_folder(done.before.sparkSession, "change")
    change = written_to(change, folder)
    folded = stored.apply(totals, change, lambda old: _summed(
        old.select(totals.key, *counts).unionByName(change), totals.key, list(counts)))
    if not folded.after.where(" OR ".join(f"{n} < 0" for n in counts)).isEmpty():
        raise ValueError("the totals lack the rows that changed: start them from the table as it was")
    discard(spark, folder)
    return folded


def start_registry_totals(registry: DataFrame, folder: str, buckets: int) -> StoredTable:
    """Totals per owner of the whole registry: the base all later batches are folded into."""
    return _start(registry, folder, "owner", _registry_counts(), buckets)


def fold_registry(totals: StoredTable, done: Applied) -> Applied:
    """Take a batch on the stored registry into the totals per owner."""
    return _fold(totals, done, _registry_counts())


def start_finding_totals(findings: DataFrame, folder: str, key: str, buckets: int) -> StoredTable:
    """Number of findings per ``category`` or per ``file_id``."""
    return _start(findings, folder, key, _finding_counts(), buckets)


def fold_findings(totals: StoredTable, done: Applied) -> Applied:
    """Take a batch on the stored findings into the totals per category or file."""
    return _fold(totals, done, _finding_counts())


def _owned(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("owner").isNotNull() & (F.col("owner") != ""))


def registry_figures(spark: SparkSession, totals: StoredTable) -> DataFrame:
    """The registry's figures and its numbers of owners as one row, from the totals per owner."""
    rows = stored.read(spark, totals)
    named = F.col("owner").isNotNull() & (F.col("owner") != "")
    row = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_files_{n}") for c, n in (
        ("files", "registered"), ("flagged", "flagged"), ("processed", "processed"))],
        F.count_if(named).alias("owner_count"), F.count_if(named & (F.col("flagged") > 0)).alias("flagged_owner_count"))
    return row.withColumn("percentage_files_flagged", percent(F.col("total_files_flagged"), F.col("total_files_processed")))


def flagged_per_owner(spark: SparkSession, totals: StoredTable) -> DataFrame:
    return _owned(stored.read(spark, totals)).where("flagged > 0").select(
        "owner", F.col("flagged").alias("flagged_files")).orderBy(F.desc("flagged_files"), "owner")


def owners(spark: SparkSession, totals: StoredTable) -> DataFrame:
    return _owned(stored.read(spark, totals)).select("owner").orderBy("owner")


def clean_owners(spark: SparkSession, totals: StoredTable) -> DataFrame:
    return _owned(stored.read(spark, totals)).where("flagged = 0").select("owner").orderBy("owner")


def finding_figures(spark: SparkSession, per_file: StoredTable) -> DataFrame:
    """Files with findings and the number of findings, from the totals per file."""
    return stored.read(spark, per_file).agg(
        F.count("*").alias("files_flagged"), F.coalesce(F.sum("findings"), F.lit(0)).alias("total_findings"))
