"""Full and delta scans, the drive workflow, and report sinks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.fixed_values import SCAN_EXTENSIONS
from sievemark.functions.governance import file_id
from sievemark.functions.rules import explode_findings
from sievemark.functions.spans import with_form_findings
from sievemark.functions.strings import base_name, suffix
from sievemark.operators import cascade, kpis, ownership, registry
from sievemark.session import cut_lineage, written
from sievemark.sources import ranges
from sievemark.sources.files import split_errors, texts_of
from sievemark.sources.tree import list_tree

#: Text and CSV files above this size are read in ranges instead of as one row.
LARGE_BYTES = 2 * ranges.RANGE


class ScanResult(NamedTuple):
    files: DataFrame
    findings: DataFrame
    run: DataFrame
    errors: DataFrame
    verdicts: DataFrame | None = None


class Detected(NamedTuple):
    """``files``: id, path, size_bytes, last_modified, primary_name, n_findings; ``rows``: their findings by file_id."""

    files: DataFrame
    rows: DataFrame


def detect(texts: DataFrame) -> DataFrame:
    """(path, size_bytes, last_modified, text) to the same rows with id, findings, primary name.

    The text is used once and dropped; what remains is small and is written out, because three
    tables are built from it and the patterns must not run three times.
    """
    found = with_form_findings(texts.withColumn("id", file_id(F.col("path"))))
    return cut_lineage(found.withColumn(
        "primary_name", ownership.primary_name(F.col("findings"))).drop("text"))


def per_file(detected: DataFrame) -> Detected:
    """Files and findings of texts that ``detect`` went through."""
    rows = explode_findings(detected.withColumnRenamed("id", "file_id"), ["file_id"]).drop("ord")
    return Detected(detected.withColumn("n_findings", F.size("findings")).drop("findings"), rows)


def detect_large(files: DataFrame, range_bytes: int = ranges.RANGE) -> Detected:
    """The same for large text and CSV files (path, size_bytes, last_modified), read in ranges by many tasks.

    ``files`` is a written table. Findings stay rows; a file's figures are aggregates with partial sums.
    """
    own = files.withColumn("id", file_id(F.col("path")))
    found = written(ranges.findings_in_ranges(files, range_bytes).join(own.select("path", "id"), "path"), "large-findings")
    surest = F.min(F.when(F.col("category") == "name", F.struct((-F.col("confidence")).alias("doubt"), "start", "snippet")))
    figures = found.groupBy("id").agg(F.count("*").alias("n_findings"), surest["snippet"].alias("primary_name"))
    joined = own.join(figures, "id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return Detected(joined, found.withColumnRenamed("id", "file_id").drop("path"))


def apply_scan(detected: DataFrame, skipped: DataFrame, files: DataFrame, findings: DataFrame,
               users: DataFrame, run_id: str, scan_type: str, started_at: float,
               finished_at: float, failed: DataFrame | None = None,
               scorer: cascade.Scorer | None = None, verdicts: DataFrame | None = None,
               large: Detected | None = None) -> ScanResult:
    """Next versions of the files and findings tables, the run's record, and the unreadable files.

    ``large`` holds files that were read in ranges beside those of ``detected``. ``failed`` holds (path, size_bytes, error). With a ``scorer``, findings of low confidence are
    scored once per category and snippet; ``verdicts`` is the cache so far, its next version comes back.
    """
    if failed is None:
        failed = detected.limit(0).select("path", "size_bytes", F.lit("").alias("error"))
    scanned, rows = per_file(detected)
    if large is not None:
        scanned, rows = scanned.unionByName(large.files), rows.unionByName(large.rows)
    owned = ownership.resolve_ownership(scanned.drop("n_findings"), users)
    next_files = registry.mark_scanned(
        registry.upsert_files(files, owned), scanned.select("id"), finished_at)
    if scorer:
        if verdicts is None:
            verdicts = rows.limit(0).select(F.lit("").alias("key"), F.lit(0.0).alias("verdict"))
        verdicts = written(cascade.updated_cache(rows, verdicts, scorer), "verdicts")
        rows = cascade.escalate(rows, verdicts, ["file_id", "start"])
    next_findings = registry.replace_findings(
        findings, registry.stored_findings(rows, finished_at),
        scanned.select(F.col("id").alias("file_id")))

    def seen(frame: DataFrame, is_skipped: bool, is_failed: bool, n: Column) -> DataFrame:
        return frame.select(F.lit(is_skipped).alias("skipped"), F.lit(is_failed).alias("failed"),
                            "size_bytes", n.alias("n_findings"))

    every = seen(scanned, False, False, F.col("n_findings")).unionByName(
        seen(skipped, True, False, F.lit(0))).unionByName(seen(failed, False, True, F.lit(0)))
    run = kpis.scan_run(every, run_id, scan_type, started_at, finished_at)
    return ScanResult(next_files, next_findings, run, failed, verdicts)


def scan_folder(spark: SparkSession, root: str, files: DataFrame, findings: DataFrame,
                users: DataFrame, run_id: str, started_at: float, finished_at: float,
                scan_type: str = "full", scorer: cascade.Scorer | None = None,
                verdicts: DataFrame | None = None, known: DataFrame | None = None,
                history: str | None = None) -> ScanResult:
    """Scan a folder tree. A delta scan decides on metadata and opens only changed files.

    The tree is listed once, by tasks. Large text and CSV files are read in ranges. Files that cannot be read and
    folders that cannot be listed are handed back in ``errors`` and counted in the run. With the file registry in
    ``known``, the run ends with a snapshot of its figures below ``history``.
    """
    listing = list_tree(spark, root, SCAN_EXTENSIONS)
    closed = listing.where(F.col("error").isNotNull()).select("path", "size_bytes", "error")
    listing = listing.where(F.col("error").isNull()).drop("error")
    skipped = listing.limit(0)
    if scan_type == "delta":
        chosen = written(registry.delta_selection(listing, files).drop("id"), "chosen")
        skipped, listing = chosen.where("skipped"), chosen.where("NOT skipped").drop("skipped")
    ending = suffix(base_name(F.col("path")))
    is_large = ending.isin(*ranges.RANGED_EXTENSIONS) & (F.col("size_bytes") > LARGE_BYTES)
    in_ranges = listing.where(is_large)
    large = None if in_ranges.isEmpty() else detect_large(in_ranges)
    readable, failed = split_errors(texts_of(listing.where(~is_large)))
    failed = written(failed.select("path", "size_bytes", "error").unionByName(closed), "scan-errors")
    result = apply_scan(detect(readable), skipped, files, findings, users, run_id, scan_type,
                        started_at, finished_at, failed, scorer, verdicts, large)
    if known is not None and history is not None:
        snapshot_run(known, history, run_id, scan_type, finished_at)
    return result


def drive_workflow(known: DataFrame, listing: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Upsert a listing and return the next registry and the messages for unchecked files."""
    updated = registry.upsert_listing(known, listing, now)
    messages = registry.extraction_messages(registry.unchecked_files(updated, listing))
    return updated, messages


def append_snapshot(files: DataFrame, folder: str, label: str | None, captured_at: Column) -> None:
    """Add one snapshot row and its owner rows to the history below ``folder``."""
    kpis.snapshot(files, label, captured_at).write.mode("append").parquet(f"{folder}/snapshots")
    kpis.snapshot_owners(files, label, captured_at).write.mode("append").parquet(
        f"{folder}/snapshot_owners")


def snapshot_run(known: DataFrame, history: str, run_id: str, scan_type: str, finished_at: float) -> None:
    """The snapshot a scan leaves behind: the registry's figures under the run's type and id."""
    append_snapshot(known, history, f"{scan_type}:{run_id}", F.timestamp_seconds(F.lit(float(finished_at))))


def write_report(per_file: DataFrame, summary: DataFrame, folder: str) -> None:
    """Per-file results as JSON lines and the one-row summary as readable text."""
    per_file.write.mode("errorifexists").json(f"{folder}/per_file")
    lines = [F.concat(F.rpad(F.lit(c), 22, " "), F.lit(": "),
                      F.coalesce(F.col(c).cast("string"), F.lit("")))
             for c in summary.columns]
    summary.select(F.concat_ws("\n", *lines).alias("value")).write.mode(
        "errorifexists").text(f"{folder}/summary")
