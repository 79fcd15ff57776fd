"""Tables kept as files and changed in proportion to the change.

A stored table lies in one folder per hash bucket of its key. A batch reads only the buckets its keys
fall into, computes their next version, writes it to the scratch folder first, and then replaces exactly
these folders by a dynamic partition overwrite. So a batch that touches one bucket in a hundred reads and writes a
hundredth of the table, a failed batch leaves the table as it was, and a repeated batch finds its own result.

Choose the number of buckets so that one bucket is a file of a good size, and well above the ids of a usual
batch: ids are hashed, so a batch of n ids touches up to n buckets. Rows are not shuffled by bucket before they are
written: in a commit each task takes a share of its files (``TASK_ROWS`` rows, less while tasks are idle) and writes one file in every bucket it has
rows of. So a bucket has as many files as there are such shares, and one key may hold a large share of the rows (the findings of one file).

Deliveries may repeat. Beside the table lies a note of the last batch, by a digest of its rows; the same batch delivered
again at once is known by it and changes nothing, whatever its rows would do to themselves. Any other batch is applied.

One writer at a time; readers see buckets of two versions only while a batch is being committed. A row
without a key belongs to the bucket of the null hash like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from sievemark.operators import registry
from sievemark.session import discard, scratch_folder, written_to

BUCKET, LIVE = "_bucket", "_live"
#: Rows that a task of a commit takes: so many, or no less than the second number to keep all tasks busy.
TASK_ROWS, LEAST_ROWS = 1 << 21, 1 << 18
#: Buckets named one by one in a path; more are chosen by a filter on the whole folder.
NAMED = 500
Change = Callable[[DataFrame], DataFrame]


class StoredTable(NamedTuple):
    """``schema`` has no bucket column; ``key`` decides the bucket."""

    folder: str
    key: str
    buckets: int
    schema: StructType


class Applied(NamedTuple):
    """What a batch did: the buckets it replaced and their rows before and after, both written out to ``folders``."""

    buckets: list[int]
    before: DataFrame
    after: DataFrame
    folders: tuple[str, ...] = ()


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _marked(table: StoredTable, rows: DataFrame, live: bool = True) -> DataFrame:
    """Rows as they are stored; of those that are not ``live`` only the bucket counts."""
    if live:
        return rows.select(*table.schema.fieldNames(), F.lit(True).alias(LIVE), bucket_of(F.col(table.key), table.buckets).alias(BUCKET))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return rows.select(*none, F.lit(False).alias(LIVE), BUCKET)


def _write(table: StoredTable, rows: DataFrame, touched: list[int], counts: dict[int, int]) -> None:
    """Replace the touched buckets by ``rows``, read from files, so many in each; an emptied one gets a marker row, so that it
    is replaced too."""
    spark, total = rows.sparkSession, sum(counts.values())
    tasks = max(-(-total // TASK_ROWS), min(-(-total // LEAST_ROWS), spark.sparkContext.defaultParallelism), 1)
    marked = _marked(table, rows).coalesce(tasks)
    emptied = [(b,) for b in touched if b not in counts]
    if emptied:
        marked = marked.unionByName(_marked(table, spark.createDataFrame(emptied, f"{BUCKET} int").coalesce(1), live=False))
    (marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(BUCKET).parquet(table.folder))


def create(rows: DataFrame, folder: str, key: str, buckets: int) -> StoredTable:
    """Store ``rows``; an existing table in ``folder`` is an error."""
    spark = rows.sparkSession
    table = StoredTable(folder, key, buckets, rows.schema)
    marker = _marked(table, spark.range(0, 1, 1, 1).select(F.lit(0).alias(BUCKET)), live=False)
    _marked(table, rows).unionByName(marker).write.option("compression", "zstd").partitionBy(BUCKET).parquet(folder)
    _note(spark, table, "")
    discard(spark)
    return table


def _note(spark: SparkSession, table: StoredTable, delivery: str) -> None:
    spark.createDataFrame([(delivery,)], "value string").coalesce(1).write.mode("overwrite").text(f"{table.folder}-last")


def _last(spark: SparkSession, table: StoredTable) -> str:
    try:
        return "".join(r.value for r in spark.read.text(f"{table.folder}-last").collect())  # one short row
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return ""


def digest(rows: DataFrame) -> str:
    """Names rows by their number and the sums of two hashes, whatever their order."""
    values = [*rows.columns, *[F.col(c).isNull() for c in rows.columns]]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")) for seed in (1, 2)]
    return " ".join(map(str, rows.agg(F.count("*"), *sums).first()))


def read(spark: SparkSession, table: StoredTable, buckets: list[int] | None = None) -> DataFrame:
    """The whole table, or the rows of some buckets, of which only these folders are listed and read."""
    reader = spark.read.schema(StructType([*table.schema.fields]).add(LIVE, BooleanType()).add(BUCKET, IntegerType()))
    if buckets is None or len(buckets) > NAMED:
        rows = reader.parquet(table.folder)
        rows = rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))
    else:
        names = ",".join(str(b) for b in buckets)
        try:
            rows = reader.option("basePath", table.folder).parquet(f"{table.folder}/{BUCKET}={{{names}}}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], table.schema)  # none of these buckets holds a row yet
    return rows.where(LIVE).drop(LIVE, BUCKET)


def apply(table: StoredTable, keys: DataFrame, change: Change, delivery: str = "") -> Applied:
    """Replace the buckets of ``keys`` (a column named like the key) by ``change`` of their rows.

    The list of touched buckets is all that comes to the driver; it is bounded by the number of buckets. Rows
    that ``change`` puts elsewhere are an error, found before anything is replaced. ``delivery`` names the batch.
    """
    spark = keys.sparkSession
    own = bucket_of(F.col(table.key), table.buckets)
    touched = sorted(r[0] for r in keys.select(own.alias(BUCKET)).distinct().collect())
    before = read(spark, table, touched) if touched else spark.createDataFrame([], table.schema)
    if not touched:
        return Applied([], before, before)
    # The old files go with the commit, so what was read is kept beside the new rows.
    folders = scratch_folder(spark, "before"), scratch_folder(spark, "after")
    before = written_to(before, folders[0])
    after = written_to(change(before).select(*table.schema.fieldNames()), folders[1])
    counts = {r[0]: r[1] for r in after.groupBy(own.alias(BUCKET)).count().collect()}  # one row a bucket
    if not set(counts) <= set(touched):
        raise ValueError("a change may only give rows of the buckets it was given")
    if _last(spark, table):
        _note(spark, table, "")  # a batch that fails from here on leaves no note of another
    _write(table, after, touched, counts)
    if delivery:
        _note(spark, table, delivery)
    return Applied(touched, before, after, folders)


def release(spark: SparkSession, done: Applied) -> None:
    """Give back the disk of a batch whose rows before and after are no longer needed."""
    discard(spark, *done.folders)


def upsert_listing(table: StoredTable, listing: DataFrame, now: Column) -> Applied:
    """S11 on a stored registry."""
    return apply(table, listing, lambda rows: registry.upsert_listing(rows, listing, now))


def apply_status(table: StoredTable, updates: DataFrame, now: Column, order: list[str]) -> Applied:
    """S13 on a stored registry; unknown ids change nothing."""
    return apply(table, updates, lambda rows: registry.apply_status(rows, updates, now, order))


def apply_decisions(table: StoredTable, decisions: DataFrame, column: str, action: str = "action", order: str = "ts") -> Applied:
    """S17 on a table stored by the decided id; unknown actions touch nothing."""
    known = registry.known_decisions(decisions, action)
    return apply(table, known, lambda rows: registry.apply_decisions(rows, known, table.key, column, action, order))


def upsert_files(table: StoredTable, scanned: DataFrame) -> Applied:
    """S14 on a stored files table."""
    return apply(table, scanned, lambda rows: registry.upsert_files(rows, scanned))


def replace_findings(table: StoredTable, new: DataFrame, rescanned: DataFrame) -> Applied:
    """S15 on findings stored by ``file_id``; findings of files that were not rescanned are not taken.

    Findings whose id occurs twice multiply when they are matched by it, so a repeated batch must not be matched again.
    """
    files = rescanned.select("file_id").distinct()
    spark = new.sparkSession
    batch = scratch_folder(spark, "batch")
    ours = written_to(new.join(files, "file_id", "left_semi"), batch)
    delivery = f"{digest(files)}, {digest(ours)}"
    if _last(spark, table) == delivery:
        none = spark.createDataFrame([], table.schema)
        done = Applied([], none, none)
    else:
        done = apply(table, files, lambda rows: registry.replace_findings(rows, ours, files), delivery)
    discard(spark, batch)
    return done
