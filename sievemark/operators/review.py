"""Review work: decisions, progress, risk order, the review cycle, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.governance import (
    is_past_retention, label, percent, priority, priority_name, priority_rank,
)
from sievemark.functions.ordering import with_position
from sievemark.functions.strings import base_name
from sievemark.operators.ownership import responsibilities

IN_CYCLE = ("pending", "extended")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The standing decision per file from a log of (file_id, action, ts); unknown actions do not count."""
    names = {action: name for name, action in V.DECISION_ACTION.items()}
    pairs = [F.lit(x) for item in names.items() for x in item]
    chosen = F.try_element_at(F.create_map(*pairs), F.max_by("action", F.struct("ts", "action")))
    known = decisions.filter(F.col("action").isin(*names))
    return known.groupBy("file_id").agg(chosen.alias("decision"))


def with_decision(files: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    standing = latest_decisions(decisions).withColumnRenamed("file_id", key)
    return files.join(standing, key, "left").withColumn(
        "decision", F.coalesce("decision", F.lit("pending")))


def _counts() -> list[Column]:
    names = ("pending", "deleted", "cancelled", "extended")
    return [F.count("*").alias("total"),
            *[F.count_if(F.col("decision") == n).alias(n) for n in names],
            F.count_if(F.col("decision").isin("deleted", "cancelled")).alias("decided")]


def decision_counts(decided_files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files per decision, over all rows or per group, in one partial aggregate."""
    return decided_files.groupBy(*(by or [])).agg(*_counts())


def review_progress(counts: DataFrame) -> DataFrame:
    """Share decided or extended (file list) and share decided (statistics page)."""
    total = F.col("total")
    return counts.withColumns({
        "handled_percent": percent(F.col("decided") + F.col("extended"), total),
        "decided_percent": percent(F.col("decided"), total)})


def files_fully_reviewed(files: DataFrame, findings: DataFrame,
                         done: tuple[str, ...] = ("keep", "delete", "false_positive")) -> DataFrame:
    """Files whose every finding is decided (none counts as done); 100 % when there are none."""
    per_file = findings.groupBy(F.col("file_id").alias("id")).agg(
        F.every(F.col("status").isin(*done)).alias("_done"))
    joined = files.join(per_file, "id", "left")
    row = joined.agg(F.count("*").alias("files"),
                     F.count_if(F.coalesce("_done", F.lit(True))).alias("reviewed"))
    return row.withColumns({
        "left": F.col("files") - F.col("reviewed"),
        "percent": F.when(F.col("files") > 0, F.floor(
            F.col("reviewed") / F.col("files") * 100)).otherwise(F.lit(100)).cast("bigint")})


def file_risk(findings: DataFrame, open_only: bool = False) -> DataFrame:
    """Worst priority and finding count per file; optionally only open findings set the risk."""
    rank = priority_rank(priority(F.col("category")))
    if open_only:
        rank = F.when(F.col("status") == "open", rank).otherwise(2)
    return findings.groupBy("file_id").agg(
        F.min(rank).alias("risk_rank"), F.count("*").alias("n_findings")).withColumn(
        "priority", priority_name(F.col("risk_rank")))


def risk_order(files: DataFrame, findings: DataFrame, open_only: bool = False) -> DataFrame:
    """Flagged files, riskiest first, then most findings, then oldest."""
    risk = file_risk(findings, open_only).withColumnRenamed("file_id", "id")
    return files.join(risk, "id").orderBy(
        "risk_rank", F.desc("n_findings"), "last_modified", "id")


def file_list(files: DataFrame, findings: DataFrame, hide_low_risk: bool = False,
              sort: str = "risk", query: str = "") -> DataFrame:
    """The reviewer's list: hide low risk, search by name, then sort by risk, recency or findings."""
    risk = file_risk(findings).withColumnRenamed("file_id", "id")
    rows = files.withColumn("name", base_name(F.col("path")))
    wanted = query.strip().lower()
    if wanted:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(wanted)))
    if hide_low_risk:
        risk = risk.filter(F.col("priority") != "low")
    orders = {
        "risk": [F.asc("risk_rank"), F.desc("n_findings"), F.asc("last_modified")],
        "recent": [F.desc("last_modified")],
    }
    return rows.join(risk, "id").orderBy(
        *orders.get(sort, [F.desc("n_findings")]), F.asc("id"))


def visible_findings(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.filter(F.col("confidence") >= threshold)


def api_findings(files: DataFrame) -> DataFrame:
    """One placeholder finding per category of an (id, path, finding_categories) row."""
    rows = files.select("id", base_name(F.col("path")).alias("name"),
                        F.posexplode_outer("finding_categories").alias("i", "category"))
    return rows.filter(F.col("i").isNotNull()).select(
        F.concat("id", F.lit("__"), "i").alias("finding_id"), "id", "name", "category",
        F.lit("").alias("snippet"), F.lit(1.0).alias("confidence"),
        F.lit("regex").alias("detector"))


def review_cycle(files: DataFrame) -> DataFrame:
    """Position, previous and next file in every person's cycle of open files, wrapping around.

    ``files`` holds user_id, id, last_modified, decision. A person may own a third of all files,
    so positions come from range partitions, the bounds of each person's stretch from a partial
    aggregate, and the neighbours from equi-joins on the (unique) position.
    """
    cycle = files.filter(F.col("decision").isin(*IN_CYCLE)).select("user_id", "id", "last_modified")
    placed = with_position(cycle, [F.asc("user_id"), F.asc("last_modified"), F.asc("id")], "_at")
    stretch = placed.groupBy("user_id").agg(
        F.min("_at").alias("_first"), F.count("*").alias("cycle_size"))
    rows = placed.join(stretch, "user_id")
    step = F.col("_at") - F.col("_first")
    rows = rows.withColumns({
        "position": step + 1,
        "_next": F.col("_first") + F.pmod(step + 1, F.col("cycle_size")),
        "_prev": F.col("_first") + F.pmod(step - 1, F.col("cycle_size"))})
    spots = placed.select(F.col("_at").alias("_spot"), F.col("id").alias("_neighbour"))
    for out, at in (("next_id", "_next"), ("previous_id", "_prev")):
        rows = rows.join(spots.withColumnsRenamed({"_spot": at, "_neighbour": out}), at, "left")
    return rows.select("user_id", "id", "position", "cycle_size", "previous_id", "next_id")


def user_stats(files: DataFrame, findings: DataFrame, decisions: DataFrame, now: float,
               years: int = V.RETENTION_YEARS) -> DataFrame:
    """Per responsible person: assigned, overdue and decided flagged files."""
    flagged = findings.select(F.col("file_id").alias("id")).distinct()
    mine = responsibilities(with_decision(files.join(flagged, "id", "left_semi"), decisions))
    overdue = F.count_if(is_past_retention(F.col("last_modified"), now, years))
    counts = mine.groupBy("user_id").agg(*_counts(), overdue.alias("past_retention"))
    return review_progress(counts)


def user_categories(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per category and responsible person, counted per file before the join."""
    per_file = findings.groupBy(F.col("file_id").alias("id"), "category").agg(
        F.count("*").alias("_n"))
    mine = responsibilities(files).select("id", "user_id")
    return mine.join(per_file, "id").groupBy("user_id", "category").agg(
        F.sum("_n").alias("n")).withColumns({
            "label": label(F.col("category")), "priority": priority(F.col("category"))})
