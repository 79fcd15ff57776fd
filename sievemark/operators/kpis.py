"""Registry and store figures. Each function reads its table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.governance import articles, label, percent, priority, to_epoch
from sievemark.functions.ordering import with_position


def is_flagged() -> Column:
    return F.coalesce(F.col("status_flag") == "flagged", F.lit(False))


def is_processed() -> Column:
    """A missing status counts as processed; only ``not checked`` does not."""
    return ~F.col("status_flag").eqNullSafe("not checked")


def _owned(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("owner").isNotNull() & (F.col("owner") != ""))


def totals(registry: DataFrame) -> DataFrame:
    """Registered, flagged and processed files and the flagged share of the processed ones."""
    counts = registry.agg(
        F.count("*").alias("total_files_registered"),
        F.count_if(is_flagged()).alias("total_files_flagged"),
        F.count_if(is_processed()).alias("total_files_processed"))
    return counts.withColumn("percentage_files_flagged", percent(
        F.col("total_files_flagged"), F.col("total_files_processed")))


def total_files_registered(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("value"))


def total_files_flagged(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status_flag") == "flagged").agg(F.count("*").alias("value"))


def total_files_processed(registry: DataFrame) -> DataFrame:
    return registry.filter(is_processed()).agg(F.count("*").alias("value"))


def percentage_files_flagged(registry: DataFrame) -> DataFrame:
    return totals(registry).select(F.col("percentage_files_flagged").alias("value"))


def owners(registry: DataFrame) -> DataFrame:
    return _owned(registry).select("owner").distinct().orderBy("owner")


def flagged_per_owner(registry: DataFrame) -> DataFrame:
    counts = _owned(registry).filter(is_flagged()).groupBy("owner").agg(
        F.count("*").alias("flagged_files"))
    return counts.orderBy(F.desc("flagged_files"), "owner")


def clean_owners(registry: DataFrame) -> DataFrame:
    """Owners without a flagged file, in one pass instead of an anti-join."""
    counts = _owned(registry).groupBy("owner").agg(F.count_if(is_flagged()).alias("_n"))
    return counts.filter(F.col("_n") == 0).select("owner").orderBy("owner")


def owner_exists(registry: DataFrame, owner: str) -> bool:
    return not registry.filter(F.col("owner") == owner).isEmpty()


def owner_states(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked ``owner``: unknown, known without flagged files, or with flagged files."""
    known = registry.groupBy("owner").agg(F.count_if(is_flagged()).alias("_n"))
    rows = asked.select("owner").distinct().join(known, "owner", "left")
    return rows.select("owner", F.when(F.col("_n").isNull(), "unknown").when(
        F.col("_n") == 0, "empty").otherwise("flagged").alias("state"))


def owner_files(registry: DataFrame, owner: str | None = None) -> DataFrame:
    """Flagged files as the owner sees them, newest first; all owners when none is named."""
    rows = registry.filter(F.col("status_flag") == "flagged")
    rows = _owned(rows) if owner is None else rows.filter(F.col("owner") == owner)
    category = F.col("pii_category")
    return rows.select(
        "owner", F.col("file_id").alias("id"), F.col("name").alias("path"),
        F.lit("gdrive").alias("source_type"), F.lit(0).cast("bigint").alias("size_bytes"),
        to_epoch(F.col("google_created_at")).alias("last_modified"),
        F.nullif(to_epoch(F.col("last_seen_at")), F.lit(0.0)).alias("last_scanned_at"),
        F.lit(1).cast("bigint").alias("n_findings"),
        F.when(category.isNotNull() & (category != ""), F.array(category)).otherwise(
            F.array().cast("array<string>")).alias("finding_categories"),
    ).orderBy(F.desc("last_scanned_at"), "id")


def snapshot(registry: DataFrame, label_text: str | None, captured_at: Column) -> DataFrame:
    """The figures of one moment as one row, from one pass; ``snapshot_owners`` has the owners."""
    per_owner = registry.groupBy("owner").agg(
        F.count("*").alias("_all"), F.count_if(is_flagged()).alias("_flagged"),
        F.count_if(is_processed()).alias("_processed"))
    named = F.col("owner").isNotNull() & (F.col("owner") != "")
    zero = F.lit(0).cast("bigint")
    row = per_owner.agg(
        F.coalesce(F.sum("_all"), zero).alias("total_files_registered"),
        F.coalesce(F.sum("_flagged"), zero).alias("total_files_flagged"),
        F.coalesce(F.sum("_processed"), zero).alias("total_files_processed"),
        F.count_if(named).alias("owner_count"),
        F.count_if(named & (F.col("_flagged") > 0)).alias("flagged_owner_count"))
    share = percent(F.col("total_files_flagged"), F.col("total_files_processed"))
    return row.select(
        captured_at.alias("captured_at"), F.lit(label_text or "manual").alias("run_label"),
        "total_files_registered", "total_files_flagged", "total_files_processed",
        share.cast("decimal(7,2)").alias("percentage_files_flagged"),
        "owner_count", "flagged_owner_count")


def snapshot_owners(registry: DataFrame, label_text: str | None, captured_at: Column) -> DataFrame:
    """The owner lists of a snapshot, one row per owner.

    A row per owner instead of one array keeps the snapshot even when owners number in the
    millions; order by ``flagged_files`` descending and ``owner`` to read it as a list.
    """
    return _owned(registry).groupBy("owner").agg(
        F.count_if(is_flagged()).alias("flagged_files")).select(
        captured_at.alias("captured_at"), F.lit(label_text or "manual").alias("run_label"),
        "owner", "flagged_files")


def latest_snapshots(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    return snapshots.orderBy(F.desc("captured_at"), F.desc("run_label")).limit(limit)


def outcome_split(registry: DataFrame) -> DataFrame:
    """Flagged, not flagged and (if any) unprocessed files, with the processed share."""
    registered, flagged = F.col("total_files_registered"), F.col("total_files_flagged")
    processed = F.col("total_files_processed")
    zero = F.lit(0).cast("bigint")
    part = F.explode(F.array(
        F.struct(F.lit("Flagged (contains PII)").alias("outcome"), flagged.alias("files")),
        F.struct(F.lit("Not flagged").alias("outcome"),
                 F.greatest(zero, processed - flagged).alias("files")),
        F.struct(F.lit("Not yet processed").alias("outcome"),
                 F.greatest(zero, registered - processed).alias("files"))))
    rows = totals(registry).select(percent(processed, registered).alias("processed_percent"),
                                   part.alias("_part"))
    rows = rows.select("_part.outcome", "_part.files", "processed_percent")
    return rows.filter((F.col("outcome") != "Not yet processed") | (F.col("files") > 0))


def owner_exposure(registry: DataFrame) -> DataFrame:
    """Owners ranked by flagged files with their share of all flagged files.

    Ranks come from range partitions and the total from a scalar subquery, so no task holds
    the whole owner list.
    """
    counts = _owned(registry).filter(is_flagged()).groupBy("owner").agg(
        F.count("*").alias("flagged_files"))
    ranked = with_position(counts, [F.desc("flagged_files"), F.asc("owner")], "rank")
    total = ranked.agg(F.sum("flagged_files")).scalar()
    return ranked.withColumn("_total", total).select(
        "rank", "owner", "flagged_files",
        percent(F.col("flagged_files"), F.col("_total")).alias("share"))


def category_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n")).withColumn(
        "priority", priority(F.col("category"))).orderBy(F.desc("n"), "category")


def category_dimension(findings: DataFrame) -> DataFrame:
    """Every category present with label, priority and articles."""
    return findings.select("category").distinct().select(
        "category", label(F.col("category")).alias("label"),
        priority(F.col("category")).alias("priority"),
        F.array_join(articles(F.col("category")), ", ").alias("articles"))


def store_kpis(files: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Store-wide figures and the last run, from three independent one-pass aggregates."""
    scanned = F.col("last_scanned_at").isNotNull()
    per_file = findings.groupBy("file_id").agg(F.count("*").alias("_n"))
    found = per_file.agg(F.struct(
        F.count("*").alias("files"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))).scalar()
    last = latest_run(runs).select(F.struct("*")).scalar()
    row = files.agg(
        F.count_if(scanned).alias("files_scanned"),
        F.coalesce(F.sum(F.when(scanned, F.col("size_bytes"))), F.lit(0)).alias("bytes_scanned"))
    row = row.withColumns({"_found": found, "_last": last})
    return row.select(
        "files_scanned", F.col("_found.files").alias("files_flagged"), "bytes_scanned",
        F.col("_found.n").alias("total_findings"), F.col("_last.type").alias("last_scan_type"),
        F.when(F.col("_last.finished_at") != 0,
               F.col("_last.finished_at") - F.col("_last.started_at")).alias("last_scan_duration"),
        F.coalesce("_last.progress_pct", F.lit(0.0)).alias("last_scan_progress"),
        F.coalesce("_last.files_skipped", F.lit(0)).alias("last_scan_skipped"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last, as a one-row aggregate."""
    best = F.max_by(F.struct("*"), F.struct("started_at", "id"))
    return runs.agg(best.alias("_run")).filter(F.col("_run").isNotNull()).select("_run.*")


def corpus_kpis(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, flagged and not flagged files, findings and bytes of a file set."""
    per_file = findings.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("_n"))
    joined = files.join(per_file, "id", "left")
    row = joined.agg(
        F.count("*").alias("files_processed"), F.count("_n").alias("files_flagged"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_findings"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_scanned"))
    return row.withColumns({
        "files_not_flagged": F.col("files_processed") - F.col("files_flagged"),
        "percent_flagged": percent(F.col("files_flagged"), F.col("files_processed"))})


def flagged_per_responsible(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Flagged files per direct owner; a file without one counts for its steward."""
    flagged = findings.select(F.col("file_id").alias("id")).distinct()
    responsible = F.coalesce("owner_user_id", "master_of_data_user_id").alias("user_id")
    return files.join(flagged, "id", "left_semi").groupBy(responsible).agg(
        F.count("*").alias("flagged_files"))


def scan_run(results: DataFrame, run_id: str, scan_type: str, started_at: float,
             finished_at: float) -> DataFrame:
    """The record of one run over (skipped, failed, size_bytes, n_findings) rows, in one pass."""
    scanned = ~F.col("skipped") & ~F.col("failed")
    return results.agg(
        F.count_if(scanned).alias("files_scanned"),
        F.coalesce(F.sum(F.when(scanned, F.col("size_bytes"))), F.lit(0)).alias("bytes_scanned"),
        F.count_if(scanned & (F.col("n_findings") > 0)).alias("files_flagged"),
        F.count_if(F.col("skipped")).alias("files_skipped"),
        F.count_if(F.col("failed")).alias("files_failed"),
    ).select(
        F.lit(run_id).alias("id"), F.lit(scan_type).alias("type"),
        F.lit(float(started_at)).alias("started_at"),
        F.lit(float(finished_at)).alias("finished_at"),
        "files_scanned", "bytes_scanned", "files_flagged", "files_skipped", "files_failed",
        F.lit("done").alias("status"), F.lit(100.0).alias("progress_pct"))


def scan_trend(runs: DataFrame) -> DataFrame:
    """Runs oldest to newest with flagged share, latest marker and change since the run before.

    Position and predecessor come from range partitions and an equi-join on the position.
    """
    placed = with_position(runs, [F.asc("started_at"), F.asc("id")])
    before = placed.select((F.col("position") + 1).alias("position"),
                           F.col("files_flagged").alias("_flagged_before"))
    newest = placed.agg(F.max("position")).scalar()
    joined = placed.join(before, "position", "left").withColumn("_newest", newest)
    share = F.when(F.col("files_scanned") > 0, F.floor(
        F.col("files_flagged") / F.col("files_scanned") * 100 + 0.5)).otherwise(F.lit(0))
    return joined.select(
        "position", "id", "type", "started_at", "files_scanned", "files_flagged",
        (F.col("files_scanned") - F.col("files_flagged")).alias("files_not_flagged"),
        share.cast("bigint").alias("flagged_percent"),
        (F.col("position") == F.col("_newest")).alias("is_latest"),
        (F.col("files_flagged") - F.col("_flagged_before")).alias("flagged_change"))
