"""Operator 7: token ids in binary files of patched frame-of-reference blocks.

A file holds a range of documents in ascending id order, as rows of one chunk each. A chunk holds
whole documents of about ``CHUNK_IDS`` ids, so that it can be read on its own. Its payload:

    magic "PFR1", ids in a block (u32), ids (u64), blocks (u32)
    index: where each block starts in the payload, from its beginning (u64 a block)
    a block: smallest id (u32), width (u8), ids (u32), exceptions (u32), the ids less the smallest at
    that width in bits, places of exceptions (u32 each), ids of exceptions less the smallest (u32 each)

All numbers are little-endian. The width is what ``PERCENTILE`` percent of a block's ids need; larger
ones go to the exception list and leave zero bits behind. Beside the payload a chunk lists its
documents, their lengths and the ids of its file before it. Files are written by Spark's committer, so
a task that is run again leaves no half file.

Documents are dealt by ranges of their id, ties by a hash of the text; null ids come first. Null texts
count as empty and hold the end id only. A very long text makes a chunk of its own. Repeated rows are
written as often as they come, an empty table gives no chunk, further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.bpe import SPLIT, byte_letters, checked, tokenizer_of
from sievemark.llm.frames import shuffle_partitions, text_of, tidy

MAGIC = b"PFR1"
BLOCK_IDS, CHUNK_IDS, PERCENTILE = 4096, 1 << 18, 99
#: tiktoken cannot split about a million whitespace characters in a row; runs from this length on go around it.
LONG_RUN = 100_000
HEAD, BLOCK_HEAD = struct.Struct("<4sIQI"), struct.Struct("<IBII")
CHUNKS = ("shard int, chunk int, start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
          "payload binary")


def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    kth = min(len(rest) - 1, -(-len(rest) * percentile // 100) - 1)
    width = int(np.partition(rest, kth)[kth]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    patched = rest.copy()
    patched[over] = 0
    if width % 8 == 0 and width in (8, 16, 32):
        packed = patched.astype(f"<u{width // 8}").tobytes()
    else:
        bits = np.unpackbits(patched.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        packed = np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()
    return (BLOCK_HEAD.pack(low, width, len(ids), len(over)) + packed
            + over.astype("<u4").tobytes() + rest[over].astype("<u4").tobytes())


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, n, exceptions = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size
    size = -(-n * width // 8)
    if width in (8, 16, 32):
        ids = np.frombuffer(data, f"<u{width // 8}", n, at).astype(np.uint32)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little")
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits.reshape(n, width)
        ids = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)
    places = np.frombuffer(data, "<u4", exceptions, at + size)
    ids[places] = np.frombuffer(data, "<u4", exceptions, at + size + 4 * exceptions)
    return ids + np.uint32(low)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The payload of a chunk."""
    blocks = [pack_block(ids[i:i + block_ids]) for i in range(0, len(ids), block_ids)]
    first = HEAD.size + 8 * len(blocks)
    starts = first + np.cumsum([0, *map(len, blocks)])[:len(blocks)]
    return b"".join([HEAD.pack(MAGIC, block_ids, len(ids), len(blocks)), starts.astype("<u8").tobytes(), *blocks])


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from ``first`` to before ``last``; only the blocks that hold them are read."""
    magic, block_ids, n, blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u8", blocks, HEAD.size).tolist()
    data, begin = memoryview(payload), first // block_ids
    ids = [unpack_block(data[starts[b]:]) for b in range(begin, (last - 1) // block_ids + 1)]
    return np.concatenate(ids)[first - begin * block_ids:last - begin * block_ids]


class IdEncoder:
    """Whole texts to the ids that the tokenizers library gives for a byte-level BPE file.

    The file's vocabulary is loaded into tiktoken, which merges several times faster and remembers
    nothing between texts; that both agree is tested over all code points. Its split pattern fails on very
    long runs of whitespace; these are cut out as the pattern would and merged by the automaton of ``bpe``.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special, letter = checked(spec), byte_letters()
        ranks = {bytes(letter[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        order = [ranks[bytes(letter[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))]
                 for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of the merges")
        self.engine = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.long_run = regex.compile(r"\s{%d,}+" % LONG_RUN)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) < LONG_RUN:
            return self._split_and_merged(text)
        parts, here = [], 0
        for run in self.long_run.finditer(text):
            first, end = run.span()
            # Before a word, the last character of the run belongs to what follows.
            if end < len(text) and not text.startswith(self.special, end):
                end -= 1
            ids = tokenizer_of(self.path).automaton.encode(text[first:end].encode())
            parts += [self._split_and_merged(text[here:first]), np.array(ids, "<u4").tobytes()]
            here = end
        return b"".join([*parts, self._split_and_merged(text[here:])])

    def _split_and_merged(self, text: str) -> bytes:
        return self.engine.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_LOADED: dict[str, IdEncoder] = {}


def encoder_of(path: str) -> IdEncoder:
    if path not in _LOADED:
        _LOADED[path] = IdEncoder(path)
    return _LOADED[path]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_column: str = "doc_id",
              text_column: str = "text", files: int | None = None) -> None:
    """Write the ids of all documents, each closed by ``end_id``, to ``folder``."""
    n = files or shuffle_partitions(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    names = [field.split(" ")[0] for field in CHUNKS.split(", ")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts = [], []
        held, encode = 0, encoder_of(tokenizer).encode

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                pa.array([pack(ids)], pa.binary())], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc_id.as_py())
                parts.append(encode(text.as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= CHUNK_IDS:
                    yield close()
                    chunk, start, held = chunk + 1, start + held, 0
                    doc_ids, parts = [], []
        if parts:
            yield close()

    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("_tie"))
    (rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
     .select("doc_id", "text").mapInArrow(tidy(chunks), CHUNKS).write.parquet(folder))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids before it), ``n_tokens, ids_crc32`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers. A task reads chunk by chunk.
    """
    schema = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = unpack(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                cut = [data[4 * (e - n):4 * e] for n, e in zip(row["lengths"], ends.tolist(), strict=True)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array(row["start"] + ends - np.array(row["lengths"]), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary())], schema=schema)

    chunks = spark.read.schema(CHUNKS).parquet(folder)
    read = chunks.select("shard", "start", "doc_ids", "lengths", "payload").mapInArrow(
        tidy(documents), "shard int, start long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shifts = (chunks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
              .select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before")))
    return (read.join(F.broadcast(shifts), "shard")  # as many rows as files
            .select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids"))
