"""Consumers that remember: flushes by count or time, and redelivery with attempts, backoff and dead letters.

Both keep keyed state in the state store of the stream (``transformWithState``), so a restart from the checkpoint goes on
where the last batch ended. Work is spread over keys: lanes for the flush buffer, message ids for the deliveries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

FLUSH_ROWS, FLUSH_MS = 50, 500
FLUSHED = "lane bigint, flush bigint, cause string, value string"
EMITTED = "id string, action string, attempt int, value string"
REPORT = "id string, attempt int, ok boolean"
Handle = Callable[[DataFrame], DataFrame]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class FlushBuffer(StatefulProcessor):
    """Holds the rows of a lane until there are ``limit`` of them or the oldest is ``wait_ms`` old."""

    def __init__(self, limit: int, wait_ms: int):
        self.limit, self.wait_ms = limit, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "value string")
        #: Rows held, flushes so far, and when the oldest row is due.
        self.meta = handle.getValueState("meta", "held bigint, flushes bigint, due bigint")

    def _flush(self, lane: int, number: int, cause: str, newest: list[tuple]) -> Iterator[Row]:
        for (value,) in [*(self.buffer.get() if self.buffer.exists() else ()), *newest]:
            yield Row(lane=lane, flush=number, cause=cause, value=value)
        self.buffer.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, flushes, due = self.meta.get() if self.meta.exists() else (0, 0, 0)
        timer = due if held else None
        newest: list[tuple] = []
        for row in rows:
            if not held:
                due = now + self.wait_ms
            newest.append((row.value,))
            held += 1
            if held == self.limit:
                yield from self._flush(key[0], flushes, "rows", newest)
                newest, held, flushes = [], 0, flushes + 1
        if newest:
            self.buffer.appendList(newest)
        wanted = due if held else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.meta.update((held, flushes, due))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held, flushes, due = self.meta.get()
        if held and due <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._flush(key[0], flushes, "time", [])
            self.meta.update((0, flushes + 1, due))

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, lane: Column, limit: int = FLUSH_ROWS, wait_ms: int = FLUSH_MS) -> DataFrame:
    """``value`` rows in flushes: each leaves its lane with the flush's number and cause (``rows`` or ``time``).

    A lane stands for one consumer; give as many as tasks should work side by side.
    """
    return (rows.select(lane.cast("bigint").alias("lane"), "value").groupBy("lane")
            .transformWithState(FlushBuffer(limit, wait_ms), FLUSHED, "Append", "ProcessingTime"))


#: The last batch that was handed over to be written.
_BEGUN: WeakKeyDictionary[StreamingQuery, list[int]] = WeakKeyDictionary()


def _writer(rows: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, interval: str) -> StreamingQuery:
    begun: list[int] = []

    def flush_noted(batch: DataFrame, batch_id: int) -> None:
        begun[:] = [batch_id]
        flush(batch, batch_id)

    with state_store(rows.sparkSession):
        query = (rows.writeStream.outputMode("append").foreachBatch(flush_noted).option("checkpointLocation", checkpoint)
                 .trigger(processingTime=interval).start())
    _BEGUN[query] = begun
    return query


def _batch_end(query: StreamingQuery) -> None:
    """Wait until the batch under way, if any, is committed. A stop inside it would cancel its jobs, and Spark looks for the
    cause in the whole error text of the Python call, which can overflow the stack of the stream's thread."""
    for batch_id in tuple(_BEGUN.get(query, ())):
        while query.isActive and (query.lastProgress or {}).get("batchId", -1) < batch_id:
            time.sleep(0.02)


def _read(spark: SparkSession, folder: str, schema: str, live: bool) -> DataFrame:
    """``live``: without the files that a repeated micro-batch replaces meanwhile, for looks at a stream that runs."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", live).parquet(folder)


def start_flushing(rows: DataFrame, lane: Column, out: str, checkpoint: str, limit: int = FLUSH_ROWS,
                   wait_ms: int = FLUSH_MS, interval: str = "0.1 seconds") -> StreamingQuery:
    """Write ``value`` rows to ``out/flushed`` when their buffer is full or due.

    A micro-batch without a due flush writes nothing. A repeated micro-batch replaces itself.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/flushed/part={batch_id}")

    return _writer(buffered(rows, lane, limit, wait_ms), flush, checkpoint, interval)


def flushed(spark: SparkSession, out: str, live: bool = False) -> DataFrame:
    return _read(spark, f"{out}/flushed", FLUSHED, live)


class DeliveryGate(StatefulProcessor):
    """Decides per message what is delivered, when again, and what is given up.

    A message is delivered once, and again only after a failure of its last delivery was reported, after a wait that doubles
    each time. After ``attempts`` failures it is a dead letter. Copies of a message that is under way, or was settled
    within ``remember_ms``, are not delivered; reports of other attempts than the last are ignored.
    """

    def __init__(self, attempts: int, backoff_ms: int, remember_ms: int):
        self.attempts, self.backoff_ms, self.remember_ms = attempts, backoff_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The message under way: its last attempt, and when the next is due (0: a report is awaited).
        self.message = handle.getValueState("message", "value string, attempt int, due bigint")
        self.settled = handle.getValueState("settled", "outcome string", self.remember_ms)

    def _settle(self, outcome: str) -> None:
        self.message.clear()
        self.settled.update((outcome,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.message.get() if self.message.exists() else None
        over = self.settled.exists()
        for row in rows:
            if row.ok is None:
                if known is None and not over:
                    known = (row.value, 1, 0)
                    self.message.update(known)
                    yield Row(id=key[0], action="deliver", attempt=1, value=row.value)
                continue
            if known is None or known[2] or row.attempt != known[1]:
                continue
            value, attempt, _ = known
            if row.ok or attempt >= self.attempts:
                self._settle("done" if row.ok else "dead")
                known, over = None, True
                if not row.ok:
                    yield Row(id=key[0], action="dead", attempt=attempt, value=value)
                continue
            due = timerValues.getCurrentProcessingTimeInMs() + self.backoff_ms * 2 ** (attempt - 1)
            known = (value, attempt, due)
            self.message.update(known)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.message.exists():
            value, attempt, due = self.message.get()
            if due and due <= expiredTimerInfo.getExpiryTimeInMs():
                self.message.update((value, attempt + 1, 0))
                yield Row(id=key[0], action="deliver", attempt=attempt + 1, value=value)

    def close(self) -> None:
        pass


def message_id(value: Column) -> Column:
    """What tells messages apart: equal ones are copies of one message."""
    return F.sha2(value, 256)


def start_deliveries(messages: DataFrame, handle: Handle, out: str, checkpoint: str, attempts: int = 5,
                     backoff_ms: int = 500, remember_ms: int = 7 * 86_400_000, interval: str = "0.1 seconds") -> StreamingQuery:
    """Deliver ``value`` messages to ``handle`` until it accepts them or gives up.

    ``handle`` takes (id, attempt, value) rows and returns them with ``ok`` and further columns of its own. Its rows
    go to ``out/handled`` and, as reports, back into the stream; dead letters to ``out/dead``. What a micro-batch
    delivers is written before it is handled, so a repeated one handles the same rows and replaces its own files.
    """
    spark = messages.sparkSession
    reports = f"{out}/reports"
    spark.createDataFrame([], REPORT).write.mode("append").parquet(f"{reports}/part=none")
    spark.createDataFrame([], EMITTED).write.mode("append").parquet(f"{out}/dead/part=none")
    told = spark.readStream.schema(REPORT).option("recursiveFileLookup", "true").parquet(reports)
    none = F.lit(None)
    rows = messages.select(message_id(F.col("value")).alias("id"), none.cast("int").alias("attempt"),
                           none.cast("boolean").alias("ok"), "value").unionByName(
        told.select("id", "attempt", "ok", none.cast("string").alias("value")))
    gated = rows.groupBy("id").transformWithState(
        DeliveryGate(attempts, backoff_ms, remember_ms), EMITTED, "Append", "ProcessingTime")

    def flush(batch: DataFrame, batch_id: int) -> None:
        part = f"part={batch_id}"
        batch.write.mode("overwrite").parquet(f"{out}/emitted/{part}")
        emitted = batch.sparkSession.read.schema(EMITTED).parquet(f"{out}/emitted/{part}")
        if batch_id and emitted.isEmpty():  # the first is handled anyway, so that ``handled`` has files to read
            return
        handle(emitted.where("action = 'deliver'").select("id", "attempt", "value")).write.mode("overwrite").parquet(
            f"{out}/handled/{part}")
        emitted.where("action = 'dead'").write.mode("overwrite").parquet(f"{out}/dead/{part}")
        batch.sparkSession.read.parquet(f"{out}/handled/{part}").select("id", "attempt", F.coalesce("ok", F.lit(False)).alias(
            "ok")).write.mode("overwrite").parquet(f"{reports}/{part}")

    return _writer(gated, flush, checkpoint, interval)


def handled(spark: SparkSession, out: str, schema: str, live: bool = False) -> DataFrame:
    """Every delivery with what the handler said; ``schema`` is that of the handler's rows."""
    return _read(spark, f"{out}/handled", schema, live)


def dead_letters(spark: SparkSession, out: str, live: bool = False) -> DataFrame:
    return _read(spark, f"{out}/dead", EMITTED, live)


def stop_when(query: StreamingQuery, done: Callable[[], bool], most_seconds: float = 300) -> None:
    """Let a stream run until ``done`` holds, then stop it; a stream that failed is an error, and so is one that idles.

    A batch under way is committed first. Only time without new rows counts, and no time inside a batch: a larger input may take as long as it needs.
    """
    idle, looked, batch = 0.0, time.monotonic(), None
    try:
        while not done():
            if query.exception() is not None:
                raise query.exception()
            before, looked, status = looked, time.monotonic(), query.status
            last, batch = batch, (query.lastProgress or {}).get("batchId")
            if status["isDataAvailable"]:
                idle = 0.0
            elif batch != last or not status["isTriggerActive"]:
                idle += looked - before
            if idle > most_seconds:
                raise TimeoutError(f"the stream did not come to its end and had nothing to do for {most_seconds} seconds")
            time.sleep(0.2)
        _batch_end(query)
    finally:
        query.stop()
