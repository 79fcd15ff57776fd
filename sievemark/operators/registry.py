"""File registry: upserts, status updates, decisions, delta selection, findings replacement.

Plain Parquet has no MERGE, so every operator returns the next version of a table; the caller
writes it beside the old one and switches over. Keys are unique ids, so the joins are even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.governance import file_id, finding_id
from sievemark.functions.strings import suffix

REGISTRY_COLUMNS = (
    "file_id", "name", "mime_type", "owner", "google_created_at", "is_deleted", "last_seen_at",
    "status_flag", "detection_stage", "pii_category", "user_action",
)
FILE_COLUMNS = (
    "id", "path", "source_type", "size_bytes", "last_modified", "owner_user_id",
    "master_of_data_user_id", "last_scanned_at",
)


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key, as a map-side combinable aggregate rather than a window."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def is_listable(mime: Column) -> Column:
    return mime.isin(*V.EXPORT_TYPES, *V.STORED_TYPES) | mime.startswith("video/")


def ingest_listing(raw: DataFrame) -> DataFrame:
    """Drive API rows (id, name, mimeType, createdTime, trashed, owners) to listing records."""
    first_owner = F.try_element_at("owners", F.lit(1))["emailAddress"]
    no_owner = F.coalesce(F.size("owners") <= 0, F.lit(True))
    return raw.filter(is_listable(F.col("mimeType"))).select(
        F.col("id").alias("file_id"), "name", F.col("mimeType").alias("mime_type"),
        F.col("createdTime").alias("modified_time"),
        F.when(no_owner, V.DEFAULT_OWNER).otherwise(first_owner).alias("owner"),
        F.coalesce("trashed", F.lit(False)).alias("deleted"))


def _constant_map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def with_file_type(listing: DataFrame, mime: str = "mime_type", name: str = "name") -> DataFrame:
    """Add the export type (if any) and the extension the download gets."""
    key = F.col(mime)
    exported = {k: v[0] for k, v in V.EXPORT_TYPES.items()}
    extensions = {**V.STORED_TYPES, **{k: v[1] for k, v in V.EXPORT_TYPES.items()}}
    return listing.withColumns({
        "export_type": _constant_map(exported, key),
        "extension": F.coalesce(_constant_map(extensions, key), suffix(F.col(name))),
    })


def upsert_listing(registry: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Insert new files; on known ids refresh only name, type, owner, deletion and last seen."""
    fresh = latest_by(listing, "file_id", ["modified_time"]).select(
        F.col("file_id").alias("_id"),
        F.struct("name", "mime_type", "owner", "modified_time", "deleted").alias("_new"))
    joined = registry.join(fresh, registry["file_id"] == fresh["_id"], "full_outer")
    listed, known = F.col("_id").isNotNull(), F.col("file_id").isNotNull()
    updated = {
        "file_id": F.coalesce("file_id", "_id"),
        "name": F.when(listed, F.col("_new.name")).otherwise(F.col("name")),
        "mime_type": F.when(listed, F.col("_new.mime_type")).otherwise(F.col("mime_type")),
        "owner": F.when(listed, F.col("_new.owner")).otherwise(F.col("owner")),
        "is_deleted": F.when(listed, F.col("_new.deleted")).otherwise(F.col("is_deleted")),
        "last_seen_at": F.when(listed, now).otherwise(F.col("last_seen_at")),
        "google_created_at": F.when(known, F.col("google_created_at")).otherwise(
            F.col("_new.modified_time")),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in REGISTRY_COLUMNS])


def unchecked_files(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """The listed files still to be scanned: status missing or ``not_checked``."""
    open_ids = registry.filter(
        F.col("status_flag").isNull() | (F.col("status_flag") == "not_checked")).select("file_id")
    return listing.join(open_ids, "file_id", "left_semi")


def extraction_messages(files: DataFrame) -> DataFrame:
    return files.select(
        "file_id", F.to_json(F.struct("file_id", "name", "mime_type")).alias("value"))


def apply_status(registry: DataFrame, updates: DataFrame, now: Column,
                 order: list[str]) -> DataFrame:
    """Set flag, stage and category of known ids; unknown ids are ignored.

    ``updates`` holds file_id, status_flag, detection_stage, pii_category; on duplicates the
    last row in ``order`` counts.
    """
    last = latest_by(updates, "file_id", order).select(
        F.col("file_id").alias("_id"),
        F.struct("status_flag", "detection_stage", "pii_category").alias("_new"))
    joined = registry.join(last, registry["file_id"] == last["_id"], "left")
    hit = F.col("_id").isNotNull()
    changed = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
               for c in ("status_flag", "detection_stage", "pii_category")}
    changed["last_seen_at"] = F.when(hit, now).otherwise(F.col("last_seen_at"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in REGISTRY_COLUMNS])


def known_decisions(decisions: DataFrame, action: str = "action") -> DataFrame:
    return decisions.filter(F.col(action).isin(*V.ACTION_STATUS))


def rejected_decisions(decisions: DataFrame, action: str = "action") -> DataFrame:
    """The decisions with an action outside the vocabulary."""
    return decisions.filter(~F.coalesce(F.col(action).isin(*V.ACTION_STATUS), F.lit(False)))


def apply_decisions(table: DataFrame, decisions: DataFrame, key: str, column: str,
                    action: str = "action", order: str = "ts") -> DataFrame:
    """Write the latest review action per id (``confirm_delete`` is stored as ``delete``).

    Unknown actions change nothing; ``rejected_decisions`` hands them back.
    """
    status = _constant_map(V.ACTION_STATUS, F.col(action))
    last = latest_by(
        known_decisions(decisions, action).select(F.col(key).alias("_id"), F.col(order).alias("_ts"),
                         status.alias("_status")), "_id", ["_ts"])
    joined = table.join(last, table[key] == last["_id"], "left")
    chosen = F.when(F.col("_id").isNotNull(), F.col("_status")).otherwise(F.col(column))
    return joined.select(*[chosen.alias(c) if c == column else F.col(c) for c in table.columns])


def decision_outcomes(table: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Per decided id: the stored status and whether a row changed (false for unknown ids)."""
    status = _constant_map(V.ACTION_STATUS, F.col("action"))
    last = latest_by(known_decisions(decisions).select(key, "ts", status.alias("status")), key, ["ts"])
    known = table.select(key, F.lit(True).alias("_known"))
    return last.join(known, key, "left").select(
        key, "status", F.coalesce("_known", F.lit(False)).alias("updated"))


def upsert_files(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Insert new paths; on known ids refresh size, time and responsibility only."""
    fresh = scanned.select(
        F.col("id").alias("_id"),
        F.struct("path", "source_type", "size_bytes", "last_modified", "owner_user_id",
                 "master_of_data_user_id").alias("_new"))
    joined = files.join(fresh, files["id"] == fresh["_id"], "full_outer")
    seen, known = F.col("_id").isNotNull(), F.col("id").isNotNull()
    out = {"id": F.coalesce("id", "_id"), "last_scanned_at": F.col("last_scanned_at")}
    for c in ("size_bytes", "last_modified", "owner_user_id", "master_of_data_user_id"):
        out[c] = F.when(seen, F.col(f"_new.{c}")).otherwise(F.col(c))
    for c in ("path", "source_type"):
        out[c] = F.when(known, F.col(c)).otherwise(F.col(f"_new.{c}"))
    return joined.select(*[out[c].alias(c) for c in FILE_COLUMNS])


def mark_scanned(files: DataFrame, scanned_ids: DataFrame, when: float) -> DataFrame:
    ids = scanned_ids.select(F.col("id").alias("_id")).distinct()
    joined = files.join(ids, files["id"] == ids["_id"], "left")
    stamp = F.when(F.col("_id").isNotNull(), F.lit(float(when))).otherwise(F.col("last_scanned_at"))
    return joined.select(*[stamp.alias(c) if c == "last_scanned_at" else F.col(c)
                           for c in FILE_COLUMNS])


def delta_selection(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``skipped``: the file is known, was scanned, and has not changed since."""
    known = files.select("id", F.col("last_scanned_at").alias("_scanned"))
    joined = listing.withColumn("id", file_id(F.col("path"))).join(known, "id", "left")
    scanned = F.coalesce("_scanned", F.lit(0.0))
    return joined.withColumn(
        "skipped", (scanned != 0) & (F.col("last_modified") <= scanned)).drop("_scanned")


def stored_findings(found: DataFrame, created_at: float) -> DataFrame:
    """Exploded form findings (file_id, category, start, ...) as rows of the findings table."""
    return found.select(
        finding_id(F.col("file_id"), F.col("category"), F.col("start")).alias("id"),
        "file_id", "category", "snippet", "confidence", "detector", "gdpr_articles",
        F.lit("open").alias("status"), F.lit(float(created_at)).alias("created_at"))


def replace_findings(old: DataFrame, new: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Swap the findings of the rescanned files; a finding that reappears keeps its status.

    One file may own a large share of the old findings: adaptive execution splits such a key in the
    match with the rescanned ids. Finding ids are hashes and spread by themselves.
    """
    ids = rescanned.select("file_id").distinct()
    untouched = old.join(ids, "file_id", "left_anti")
    before = old.select("id", F.col("status").alias("_status"))
    carried = new.join(before, "id", "left").withColumn(
        "status", F.coalesce("_status", F.lit("open"))).drop("_status")
    return untouched.select(*old.columns).unionByName(carried.select(*old.columns))
