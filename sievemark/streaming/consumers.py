"""The two queue consumers as streams.

Delivery is at least once. A micro-batch is written to a folder named after its batch id with
overwrite, so a repeated batch replaces itself; messages that cannot be used go to a side folder.
The registry is not rewritten per batch: status rows are a log, and ``current_registry`` applies
the last one per file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievemark.operators.cascade import primary_category, rule_findings
from sievemark.operators.registry import apply_status, latest_by

TEXT_MESSAGE = "file_id string, name string, text string"
EXTRACTION_MESSAGE = "file_id string, name string, mime_type string"
STATUS = ("file_id string, name string, status_flag string, detection_stage string, "
          "pii_category string, batch_id bigint")
Extract = Callable[[DataFrame], DataFrame]


def message_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw messages, one JSON text per line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def parse_messages(raw: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Message fields plus ``bad``: unreadable, or a required field is missing."""
    parsed = raw.select("value", F.from_json("value", schema).alias("m"))
    missing = F.lit(False)
    for field in required:
        missing = missing | F.col(f"m.{field}").isNull()
    return parsed.select("value", "m.*", missing.alias("bad"))


def scan_messages(messages: DataFrame) -> DataFrame:
    """Status rows of parsed text messages; the same projection serves batch and stream."""
    found = rule_findings(messages)
    return found.select(
        "file_id", F.coalesce("name", "file_id").alias("name"),
        F.when(F.size("findings") > 0, "flagged").otherwise("not_flagged").alias("status_flag"),
        F.lit("regex").alias("detection_stage"),
        primary_category(F.col("findings")).alias("pii_category"))


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(
        availableNow=True)


def start_scanner(messages: DataFrame, out: str, checkpoint: str,
                  interval: str | None = None) -> StreamingQuery:
    """Scan text messages into ``out/status`` and ``out/bad``.

    ``interval`` (for example ``0.5 seconds``) keeps the stream running; without it the stream
    works off what is there and stops.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch, TEXT_MESSAGE, ["file_id", "text"]).persist()  # both sides from one pass
        status = scan_messages(parsed.filter(~F.col("bad")))
        status.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite").parquet(f"{out}/status/part={batch_id}")
        parsed.filter("bad").select("value").write.mode("overwrite").text(
            f"{out}/bad/part={batch_id}")
        parsed.unpersist()

    writer = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def start_extraction(messages: DataFrame, extract: Extract, out: str, checkpoint: str,
                     interval: str | None = None) -> StreamingQuery:
    """Turn extraction messages into text messages below ``out/text``.

    ``extract`` adds ``text`` (NULL on failure) to (file_id, name, mime_type) rows; failed and
    unreadable messages go to ``out/bad`` for another delivery.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch, EXTRACTION_MESSAGE, ["file_id", "name", "mime_type"])
        done = extract(parsed.filter(~F.col("bad")).drop("bad")).persist()
        done.filter(F.col("text").isNotNull()).select(
            F.to_json(F.struct("file_id", "name", "text")).alias("value")).write.mode(
            "overwrite").text(f"{out}/text/part={batch_id}")
        parsed.filter("bad").select("value").unionByName(
            done.filter(F.col("text").isNull()).select("value")).write.mode(
            "overwrite").text(f"{out}/bad/part={batch_id}")
        done.unpersist()

    writer = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def read_status(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STATUS).option("recursiveFileLookup", "true").parquet(f"{out}/status")


def current_registry(registry: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """The registry with the last status of every file; unknown files are ignored."""
    return apply_status(registry, status.drop("name"), now, ["batch_id"])


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """The messages set aside so far, for repair and another delivery."""
    return spark.read.option("recursiveFileLookup", "true").text(f"{out}/bad")


def compact_status(spark: SparkSession, out: str, folder: str) -> None:
    """Write the last status of every file to ``folder``; the log of small batches can go then."""
    latest_by(read_status(spark, out), "file_id", ["batch_id"]).write.mode("overwrite").parquet(folder)
