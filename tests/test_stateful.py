"""Streams with state: flushes by count and time, redelivery with attempts, restarts in between."""

import json
import time
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sievemark.streaming import consumers, stateful
from workload.changes import stream_dead_letters
from workload.derived import stream

WAIT = 3_600_000


def put(folder, name, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(v + "\n" for v in values))


def progressed(stream, rows):
    """The stream has read so many rows since its start."""
    return lambda: sum(p["numInputRows"] for p in stream.recentProgress) >= rows


def flushes(spark, out):
    rows = stateful.flushed(spark, out).collect()
    groups = Counter((r.lane, r.flush, r.cause) for r in rows)
    return groups, Counter(r.value for r in rows)


def test_full_buffers_leave_and_a_restart_keeps_the_rest(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a", [f"m{i}" for i in range(120)])

    def start():
        return stateful.start_flushing(consumers.message_stream(spark, str(inbox)), F.lit(1), out,
                                       str(tmp_path / "cp"), limit=50, wait_ms=WAIT)

    first = start()
    stateful.stop_when(first, progressed(first, 120))
    groups, _ = flushes(spark, out)
    assert groups == {(1, 0, "rows"): 50, (1, 1, "rows"): 50}
    put(inbox, "b", [f"m{i}" for i in range(120, 155)])
    second = start()
    stateful.stop_when(second, progressed(second, 35))
    groups, values = flushes(spark, out)
    # 20 rows waited in the state for the 30 that fill the buffer.
    assert groups == {(1, 0, "rows"): 50, (1, 1, "rows"): 50, (1, 2, "rows"): 50}
    assert len(values) == 150 and set(values.values()) == {1}


def test_the_oldest_row_does_not_wait_longer(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a", [f"m{i}" for i in range(130)])
    stream = stateful.start_flushing(consumers.message_stream(spark, str(inbox)), F.substring("value", -1, 1).cast("int") % 2,
                                     out, str(tmp_path / "cp"), limit=50, wait_ms=300)
    stateful.stop_when(stream, lambda: progressed(stream, 130)() and stateful.flushed(spark, out).count() >= 130)
    groups, values = flushes(spark, out)
    assert groups == {(lane, n, cause): size for lane in (0, 1) for n, cause, size in ((0, "rows", 50), (1, "time", 15))}
    assert len(values) == 130 and set(values.values()) == {1}


def test_session_setting_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


SCHEMA = "id string, attempt int, ok boolean, name string, accept_at int"


def accept(rows):
    """Each message says at which attempt it is accepted; what cannot be read never is."""
    read = rows.withColumn("m", F.from_json("value", "name string, accept_at int"))
    return read.select("id", "attempt", (F.col("attempt") >= F.col("m.accept_at")).alias("ok"), "m.name", "m.accept_at")


def test_redelivery_dead_letters_and_a_restart(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    wanted = {"first": 1, "third": 3, "last": 4, "never": 9}
    messages = [json.dumps({"name": n, "accept_at": a}) for n, a in wanted.items()] + ["{broken"]
    put(inbox, "a", [*messages, messages[0], messages[1]])  # two come twice

    def start():
        return stateful.start_deliveries(consumers.message_stream(spark, str(inbox)), accept, out, str(tmp_path / "cp"),
                                         attempts=4, backoff_ms=50)

    def settled():
        return stateful.handled(spark, out, SCHEMA).where("ok").count() + stateful.dead_letters(spark, out).count()

    first = start()
    stateful.stop_when(first, lambda: progressed(first, 7)())
    put(inbox, "b", [messages[0], messages[3], '{"name": "late", "accept_at": 2}'])  # copies of a settled and an open message
    second = start()
    stateful.stop_when(second, lambda: settled() >= 6)
    third = start()  # nothing is left to do
    stateful.stop_when(third, lambda: third.lastProgress is not None and third.lastProgress["batchId"] >= second.lastProgress["batchId"] + 2)

    deliveries = Counter((r.name, r.attempt) for r in stateful.handled(spark, out, SCHEMA).collect())
    want = [(n, i) for n, a in {**wanted, "late": 2, None: 9}.items() for i in range(1, min(a, 4) + 1)]
    assert deliveries == Counter(want)  # every attempt once
    dead = {json.loads(r.value)["name"] if r.value != "{broken" else None: r.attempt for r in stateful.dead_letters(spark, out).collect()}
    assert dead == {"never": 4, None: 4}


def test_a_broken_handler_ends_the_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    put(inbox, "a", ["x"])
    stream = stateful.start_deliveries(consumers.message_stream(spark, str(inbox)),
                                       lambda rows: rows.withColumn("ok", F.raise_error(F.lit("no way")).cast("boolean")),
                                       out, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="no way"):
        stateful.stop_when(stream, lambda: False, 60)


@pytest.mark.parametrize("shape", ["file", "folder"])
def test_a_given_table_is_streamed_whether_file_or_folder(spark, tmp_path, shape):
    pq.write_table(pa.table({"doc_id": [1, 2, 3]}), tmp_path / "part.parquet")
    sf = tmp_path / "given"
    (sf / "documents.parquet" if shape == "folder" else sf).mkdir(parents=True)
    (tmp_path / "part.parquet").rename(sf / "documents.parquet" / "part-0.parquet" if shape == "folder" else sf / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [9]}), sf / "documents_old.parquet")
    out = str(tmp_path / "out")
    query = stream(spark, str(sf), "documents").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert sorted(r.doc_id for r in spark.read.schema("doc_id long").parquet(out).collect()) == [1, 2, 3]


class Busy:
    """A stream with new rows for as long as ``looks`` last."""

    lastProgress = None

    def __init__(self, looks, active=False):
        self.looks, self.active, self.stopped = looks, active, False

    def exception(self):
        return None

    @property
    def status(self):
        self.looks -= 1
        return {"isDataAvailable": self.looks > 0, "isTriggerActive": self.active}

    def stop(self):
        self.stopped = True


def test_only_idle_time_ends_a_stream():
    busy = Busy(5)
    stateful.stop_when(busy, lambda: busy.looks <= 1, 0.3)  # longer than 0.3 seconds, with rows all the time
    inside = Busy(0, active=True)  # one batch that has not ended
    stateful.stop_when(inside, lambda: inside.looks <= -5, 0.3)
    idle = Busy(0)
    with pytest.raises(TimeoutError):
        stateful.stop_when(idle, lambda: idle.looks <= -50, 0.3)
    assert busy.stopped and inside.stopped and idle.stopped


ODD = [(1, "a"), (1, "a"), (2, "b@c.org"), (3, None), (7, "d"), (7, "d")]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_dead_letters_of_repeated_and_missing_texts(spark, tmp_path, rows):
    table = pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t in rows], pa.schema({"doc_id": pa.int64(), "text": pa.string()}))
    pq.write_table(table, tmp_path / "documents.parquet")
    got = Counter(tuple(r) for r in stream_dead_letters(spark, str(tmp_path)).select("doc_id", "outcome", "attempt", "status_flag").collect())
    want = {(1, "done", 1, "not_flagged"): 2, (2, "done", 1, "flagged"): 1, (3, "dead", 4, None): 1, (7, "dead", 4, None): 2}
    assert got == (want if rows else {})


def test_a_stop_waits_for_the_batch_under_way(spark, tmp_path):
    inbox, out, begun, ended = tmp_path / "in", str(tmp_path / "out"), [], []
    put(inbox, "a", ["x"])

    def slow(rows):
        begun.append(1)
        time.sleep(3)
        done = rows.withColumn("ok", F.lit(True))
        ended.append(done.count())
        return done

    stream = stateful.start_deliveries(consumers.message_stream(spark, str(inbox)), slow, out, str(tmp_path / "cp"))
    stateful.stop_when(stream, lambda: bool(begun), 60)
    assert ended == [1] and stream.exception() is None
    assert stateful.handled(spark, out, "id string, attempt int, value string, ok boolean").count() == 1


@pytest.mark.parametrize("name", ["stream_dead_letters", "stream_extraction", "stream_flush", "stream_malformed", "stream_scan"])
def test_a_table_in_a_folder_of_files_goes_through_the_streams(spark, tmp_path, name):
    folder, texts = tmp_path / "documents.parquet", ["plain\nlines", "write to a@b.org", "call 555-123-4567, \"or\" not"]
    folder.mkdir()
    rows = pa.Table.from_pylist([{"doc_id": i, "text": texts[i % 3] + str(i)} for i in range(410)])
    for k in range(3):
        pq.write_table(rows.slice(150 * k, 150), folder / f"part-{k}.parquet")
    database = duckdb.connect()
    database.register("documents", rows)
    wanted = database.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = contract.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(wanted.fetchall())


def test_a_look_at_a_running_stream_allows_for_replaced_files(spark, tmp_path):
    schema = "id string, attempt int, ok boolean"
    for part in "ab":
        spark.createDataFrame([(part, 1, True)], schema).coalesce(1).write.parquet(str(tmp_path / "handled" / f"part={part}"))
    look, strict = (stateful.handled(spark, str(tmp_path), schema, live=live) for live in (True, False))
    for file in (tmp_path / "handled" / "part=a").glob("*.parquet"):
        file.unlink()
    assert [r.id for r in look.collect()] == ["b"]
    with pytest.raises(Exception, match="(?i)not exist"):  # results are never read with a gap
        strict.collect()
