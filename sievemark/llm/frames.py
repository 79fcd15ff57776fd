"""Helpers shared by the operators: inputs, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import scratch_folder

#: Python's ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and leaves every other byte of a UTF-8 text alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again.

    Cuts the lineage; a lost executor costs a read, not a recomputation.
    """
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give freed memory back to the system; a no-op where the C library offers no such call."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(run: Callable, at_end: Callable[[], None] | None = None) -> Callable:
    """A ``mapInArrow`` function that hands its memory back after its task.

    Workers stay alive between tasks, so what they kept would add up beside the executor's heap.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if at_end:
            at_end()
        trim()

    return whole


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer texts in each Arrow batch of this session, so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def per_row(work: Callable[[object], tuple], names: list[str], schema: pa.Schema, batch_rows: int = 512,
            at_end: Callable[[], None] | None = None):
    """A ``mapInArrow`` function that keeps the columns ``names`` and adds what ``work`` says of the last column.

    The last input column is the payload and is dropped; results leave in batches of a bounded size.
    ``at_end`` runs when a task is through, so that workers, which stay, hold no memory between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                made = list(zip(*map(work, part.column(part.num_columns - 1).to_pylist()), strict=True))
                kept = [part.column(i) for i in range(len(names))]
                added = [pa.array(list(values), schema.field(len(names) + i).type) for i, values in enumerate(made)]
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(schema.field(i).type) for i, c in enumerate(kept)] + added, schema=schema)

    return tidy(run, at_end)


class Memo(dict):
    """What ``work`` says of a word, remembered for ``limit`` to twice ``limit`` words.

    When it is full, its entries become the older generation, from which words in use come back.
    """

    def __init__(self, work: Callable, limit: int = 250_000):
        super().__init__()
        self.work, self.limit, self.older = work, limit, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.work(word)
        self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}
