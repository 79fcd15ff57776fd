"""Queries over stored tables, streams with state, and ingest from folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions import governance as gov
from sievemark.functions.rules import with_document_findings
from sievemark.operators import cascade, evaluate, ownership, registry, stored, totals
from sievemark.plans import scan
from sievemark.session import scratch_folder, written
from sievemark.sources import ranges, tree
from sievemark.sources.files import page_texts, texts_of
from sievemark.streaming import consumers, stateful
from workload.derived import relation, stream, table
from workload.queries import (
    NOW, _epoch, _epochs, _judged, _texts, _listed_files, _message, _raw_listing, _registry, _status_updates, _stored_files, query)

BUCKETS = 64


def _store(df: DataFrame, key: str, name: str) -> stored.StoredTable:
    return stored.create(df, scratch_folder(df.sparkSession, name), key, BUCKETS)


def _halves(df: DataFrame, key: str) -> list[DataFrame]:
    """Two batches without a common key; the second is delivered again."""
    side = F.crc32(F.col(key)) % 2
    return [df.filter(side == 0), df.filter(side == 1), df.filter(side == 1)]


@query
def stored_registry_upsert(spark, sf):
    """A listing taken into the stored registry in two batches, one of them delivered twice."""
    kept = _store(_registry(spark, sf), "file_id", "stored-registry")
    for batch in _halves(registry.ingest_listing(_raw_listing(spark, sf)), "file_id"):
        stored.upsert_listing(kept, batch, F.timestamp_seconds(F.lit(NOW)))
    return _epochs(stored.read(spark, kept), "google_created_at", "last_seen_at")


@query
def stored_status_update(spark, sf):
    kept = _store(_registry(spark, sf), "file_id", "stored-status")
    for batch in _halves(_status_updates(spark, sf), "file_id"):
        stored.apply_status(kept, batch, F.timestamp_seconds(F.lit(NOW)), ["seq"])
    return _epochs(stored.read(spark, kept), "google_created_at", "last_seen_at").select(
        "file_id", "status_flag", "detection_stage", "pii_category", "last_seen_at")


@query
def stored_file_decisions(spark, sf):
    kept = _store(_registry(spark, sf), "file_id", "stored-decisions")
    for batch in _halves(relation(spark, sf, "decisions"), "file_id"):
        stored.apply_decisions(kept, batch, "user_action")
    return stored.read(spark, kept).groupBy("user_action").agg(F.count("*").alias("files"))


@query
def stored_file_upsert(spark, sf):
    kept = _store(_stored_files(spark, sf), "id", "stored-files")
    listed = _listed_files(spark, sf).withColumns({
        "id": gov.file_id(F.col("path")), "size_bytes": F.col("size_bytes") + 1,
        "source_type": ownership.source_type(F.col("path")), "owner_user_id": F.lit("u1"),
        "master_of_data_user_id": F.lit(None).cast("string")})
    for batch in _halves(listed, "id"):
        stored.upsert_files(kept, batch)
    return stored.read(spark, kept)


@query
def stored_status_carryover(spark, sf):
    """Findings stored by file: the rescanned files' buckets are replaced, statuses carried over."""
    old = relation(spark, sf, "findings")
    kept = _store(old, "file_id", "stored-findings")
    rescanned = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("f"), "o_orderkey").alias("file_id"))
    again = old.filter(F.col("confidence") > 0.6).join(rescanned, "file_id", "left_semi")
    fresh = rescanned.select(
        F.concat(F.lit("x"), "file_id").alias("id"), "file_id", F.lit("email").alias("category"),
        F.lit("new").alias("snippet"), F.lit(0.98).alias("confidence"),
        F.lit("regex").alias("detector"), F.lit("Art. 5").alias("gdpr_articles"),
        F.lit("open").alias("status"), F.lit(NOW).alias("created_at"))
    new = written(again.select(*old.columns).unionByName(fresh).drop("status"), "new")  # one match serves all batches
    for batch in _halves(rescanned, "file_id"):
        stored.release(spark, stored.replace_findings(kept, new, batch))
    return stored.read(spark, kept).select("id", "file_id", "status", "created_at")


@query
def live_owner_totals(spark, sf):
    """Figures per owner, kept up to date through batches of statuses of which one comes twice."""
    kept = _store(_registry(spark, sf), "file_id", "live-registry")
    figures = totals.start_registry_totals(_registry(spark, sf), scratch_folder(spark, "live-totals"), BUCKETS)
    updates = _status_updates(spark, sf)
    for n in (0, 1, 2, 2):
        batch = updates.filter(F.crc32("file_id") % 3 == n)
        totals.fold_registry(figures, stored.apply_status(kept, batch, F.timestamp_seconds(F.lit(NOW)), ["seq"]))
    return stored.read(spark, figures)


@query
def live_finding_totals(spark, sf):
    """Findings per category and per file after a rescan in two batches, one of them delivered twice."""
    kept = _store(relation(spark, sf, "findings").dropDuplicates(["id"]), "file_id", "live-findings")  # ids name findings
    old = stored.read(spark, kept)
    per_category = totals.start_finding_totals(old, scratch_folder(spark, "live-categories"), "category", BUCKETS)
    per_file = totals.start_finding_totals(old, scratch_folder(spark, "live-files"), "file_id", BUCKETS)
    rescanned = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("f"), "o_orderkey").alias("file_id"))
    again = written(old.filter(F.col("confidence") > 0.6).join(rescanned, "file_id", "left_semi").drop("status"), "again")
    for batch in _halves(rescanned, "file_id"):
        done = stored.replace_findings(kept, again, batch)
        for figures in (per_category, per_file):
            stored.release(spark, totals.fold_findings(figures, done))
        stored.release(spark, done)
    rows = stored.read(spark, per_category).select("category", F.col("findings").alias("n"))
    figures = totals.finding_figures(spark, per_file).select(F.explode(F.array(
        F.struct(F.lit("files with findings").alias("category"), F.col("files_flagged").alias("n")),
        F.struct(F.lit("all findings").alias("category"), F.col("total_findings").alias("n")))).alias("_r"))
    return rows.unionByName(figures.select("_r.*"))


# ---- requests from one scan -----------------------------------------------------------------

def _requests(spark, sf) -> cascade.ModelRequests:
    return cascade.model_requests(_texts(spark, sf), relation(spark, sf, "entity_answers"),
                                  relation(spark, sf, "verify_answers"), buckets=8)


@query
def verify_requests_of_one_scan(spark, sf):
    return _requests(spark, sf).verify


@query
def detect_requests_of_one_scan(spark, sf):
    return _requests(spark, sf).detect


# ---- page text ------------------------------------------------------------------------------

def _entities(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


@query
def html_page_texts(spark, sf):
    """Pages made of the documents: a title, a paragraph a line, comments and scripts between, characters as entities."""
    paragraphs = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(
        F.lit("<p>"), _entities(x), F.lit("</p><!-- a > b --><script>if (a < b) c()</script>"))), "")
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Page &amp; "), "doc_id", F.lit("</title><style>p{}</style></head><body>"),
                    paragraphs, F.lit("<br></body></html>"))
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return page_texts(pages).select("page_id", F.md5("text").alias("digest"))


# ---- streams with state ---------------------------------------------------------------------

LANES = 8


def _stream(spark, sf) -> DataFrame:
    """The documents as a stream, read straight from the given table."""
    return stream(spark, sf, "documents")


@query
def stream_flush(spark, sf):
    """Status rows leave their lane at 50 rows, or when the oldest has waited for half a second."""
    out = scratch_folder(spark, "stream-flush")
    total = table(spark, sf, "documents").count()
    texts = _stream(spark, sf).select(F.col("doc_id").cast("string").alias("file_id"), F.lit(None).cast("string").alias("name"), "text")
    status = consumers.scan_messages(texts).select(
        F.col("file_id").cast("bigint").alias("doc_id"), F.to_json(F.struct("file_id", "status_flag")).alias("value"))
    flushing = stateful.start_flushing(status, F.col("doc_id") % LANES, out, f"{out}/checkpoint")
    stateful.stop_when(flushing, lambda: flushing.lastProgress is not None and stateful.flushed(spark, out, live=True).count() == total)
    flag = F.get_json_object("value", "$.status_flag") == "flagged"
    return stateful.flushed(spark, out).groupBy("lane").agg(
        F.count_distinct(F.when(F.col("cause") == "rows", F.col("flush"))).alias("full_flushes"),
        F.count_if(F.col("cause") == "rows").alias("rows_in_full_flushes"),
        F.count_if(F.col("cause") == "time").alias("rows_in_timed_flushes"), F.count_if(flag).alias("flagged"))


@query
def stream_dead_letters(spark, sf):
    """Every seventh message is cut off and never accepted; of the others every fifth is refused twice. The stream is
    stopped after the first deliveries and goes on from its checkpoint. Equal documents are one message with one outcome,
    and a message without a text is never accepted either."""
    out = scratch_folder(spark, "stream-deliveries")
    whole = _message(F.col("text"))
    value = F.when(F.col("doc_id") % 7 == 0, F.concat(whole.substr(1, 30), F.lit("…"), "doc_id")).otherwise(whole)
    sent = table(spark, sf, "documents").select("doc_id", stateful.message_id(value).alias("id"))
    total = sent.select("id").distinct().count()
    schema = "id string, attempt int, ok boolean, file_id string, status_flag string"

    def scan(rows: DataFrame) -> DataFrame:
        read = rows.withColumn("m", F.from_json("value", consumers.TEXT_MESSAGE)).select("id", "attempt", "m.file_id", "m.text")
        found = with_document_findings(read)
        usable = F.col("file_id").isNotNull() & F.col("text").isNotNull()
        refused = (F.col("file_id").cast("bigint") % 5 == 0) & (F.col("attempt") < 3)
        return found.select("id", "attempt", (usable & ~refused).alias("ok"), "file_id", F.when(
            F.size("findings") > 0, "flagged").otherwise("not_flagged").alias("status_flag"))

    def start():
        return stateful.start_deliveries(
            _stream(spark, sf).select(value.alias("value")), scan, out, f"{out}/checkpoint", attempts=4, backoff_ms=100)

    def settled() -> int:
        return (stateful.handled(spark, out, schema, live=True).where("ok").count()
                + stateful.dead_letters(spark, out, live=True).count())

    first = start()
    stateful.stop_when(first, lambda: (first.lastProgress or {}).get("batchId", 0) > 0)
    stateful.stop_when(start(), lambda: settled() >= total)
    done = stateful.handled(spark, out, schema).where("ok").select("id", F.lit("done").alias("outcome"), "attempt", "status_flag")
    dead = stateful.dead_letters(spark, out).select(
        "id", F.lit("dead").alias("outcome"), "attempt", F.lit(None).cast("string").alias("status_flag"))
    return sent.join(done.unionByName(dead), "id").drop("id")


# ---- folders and large files ----------------------------------------------------------------

@query
def tree_texts(spark, sf):
    """The documents written as a tree of text files, listed by tasks and read back."""
    root = scratch_folder(spark, "tree")
    table(spark, sf, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(root)
    listing = tree.list_tree(spark, root, [".txt"])
    texts = texts_of(listing.drop("error"))
    return texts.select(F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/", 1).alias("lang"),
                        F.regexp_extract("path", "lang=([^/]*)/source=([^/]*)/", 2).alias("source"),
                        "size_bytes", "text").groupBy("lang", "source").agg(
        F.sum("size_bytes").alias("bytes"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"))


#: Small, so that the given tables give many ranges; the default is 32 MB.
RANGE, OVERLAP = 100_000, 5_000
#: A line no rule matches across.
BREAK = "\n#####\n"


@query
def ranged_findings(spark, sf):
    """All forms in a few large files, as text and as one quoted cell a record, read in ranges by many tasks."""
    root = scratch_folder(spark, "large")
    forms = relation(spark, sf, "forms").select(F.concat("text", F.lit(BREAK)).alias("text"))
    forms.write.text(f"{root}/plain")
    forms.write.option("quote", '"').option("escape", '"').option("quoteAll", True).csv(f"{root}/table")
    found = ranges.findings_in_ranges(tree.list_tree(spark, root).drop("error"), RANGE, OVERLAP)
    kind = F.regexp_extract("path", "(plain|table)/[^/]*$", 1).alias("kind")
    return found.groupBy(kind, "category", "snippet").agg(F.count("*").alias("n"))


# ---- sinks read back ------------------------------------------------------------------------

@query
def scan_snapshot(spark, sf):
    """The snapshots two runs leave behind, read back from the history."""
    history = scratch_folder(spark, "history")
    for n, kind in enumerate(("full", "delta")):
        scan.snapshot_run(_registry(spark, sf), history, f"run{n}", kind, NOW + n)
    rows = spark.read.parquet(f"{history}/snapshots")
    return rows.withColumns({"captured_at": _epoch("captured_at"),
                             "percentage_files_flagged": F.col("percentage_files_flagged").cast("double")})


def _report(spark, sf) -> str:
    folder = scratch_folder(spark, "report")
    judged = written(_judged(spark, sf), "judged")  # rows and summary come from one scan
    scan.write_report(judged, evaluate.file_confusion(judged, "rules"), folder)
    return folder


@query
def report_rows(spark, sf):
    """The rows of a written report."""
    rows = spark.read.schema("path string, is_pii boolean, n_findings bigint, error string").json(f"{_report(spark, sf)}/per_file")
    return rows.select("path", "is_pii", "n_findings")


@query
def report_summary(spark, sf):
    """The counts of a written report's readable summary."""
    lines = spark.read.text(f"{_report(spark, sf)}/summary")
    part = F.split("value", r"\s*: ")
    return lines.select(part[0].alias("name"), part[1].alias("figure")).where(
        F.col("name").isin("files_processed", "errors", "tp", "fp", "fn", "detector"))
