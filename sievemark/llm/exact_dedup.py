"""Operator 5: exact duplicates through a minimal perfect hash over the digests of earlier deliveries.

The distinct digests of the history are dealt into buckets. Each bucket gets a minimal perfect hash:
levels of bit arrays in which every digest owns a bit that no other digest of its level claims; the
rank of that bit is its slot. A slot holds the full 32-byte digest and the locator of the winner (the
largest id) with the number of its copies. A new digest is looked up in its bucket and counts as a
member only if all bytes of the slot agree; a member is a repeat of the history, the nonmembers are
grouped among themselves. Copies are counted before anything is shuffled by digest, so a text that
owns a third of all rows is one row per task by then; the last join, back to the rows, is a plain
equi-join whose hot keys adaptive execution splits.

Texts are equal if they are identical; null counts as empty. The largest id stays, null ids come
last: a group with null ids only keeps a null. Of rows repeated under one id, one is marked as kept.
Very long texts are only hashed, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import crc_of, shuffle_partitions, text_of, written

#: Digests in a bucket on average; small tables get at least ``BUCKETS_PER_PARTITION`` buckets a partition.
BUCKET_DIGESTS, BUCKETS_PER_PARTITION = 50_000, 16
#: Bits of a level per digest that is still to be placed, and the number of levels.
SPARE, LEVELS = 2, 48
INDEX = "bucket long, bits binary, sizes binary, slots binary, winners binary, copies binary"


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit that each digest (four 64-bit words) claims on a level."""
    with np.errstate(over="ignore"):
        h = keys[:, level % 4] ^ (keys[:, (level + 1) % 4] * np.uint64(2 * level + 1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash over distinct digests, given as rows of four 64-bit words."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(8, SPARE * len(rest))
            at = _level(rest, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("digests are not distinct")
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(bits.astype(np.uint8), np.array([len(x) for x in levels], np.int64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each digest, some slot or -1 for digests that are not members."""
        found = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _level(keys[rest], level, size).astype(np.int64) + base
            hit = self.bits[at] == 1
            found[rest[hit]] = self.rank[at[hit]]
            rest, base = rest[~hit], base + size
        return found


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def digests_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(text_of(text_column).cast("binary"), 256)).alias("digest"))


def grouped(digests: DataFrame) -> DataFrame:
    """One row per distinct digest: the winner and the number of copies."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("copies"))


def _in_buckets(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; null becomes the smallest long, which no winner with an id can lose to."""
    return column.fill_null(-(1 << 63)).to_numpy()


def _build(group: pa.Table) -> pa.Table:
    keys = _words(group["digest"])
    made = PerfectHash.of(keys)
    slot = made.slot(keys)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    return pa.table({
        "bucket": group["bucket"].slice(0, 1), "bits": [np.packbits(made.bits).tobytes()],
        "sizes": [made.sizes.tobytes()], "slots": [keys[order].tobytes()],
        "winners": [_ids(group["winner"])[order].tobytes()],
        "copies": [group["copies"].to_numpy()[order].tobytes()]})


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index over distinct digests (see ``grouped``): one row per bucket."""
    return _in_buckets(groups, buckets).groupBy("bucket").applyInArrow(_build, INDEX)


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum()))
        slots = np.frombuffer(row["slots"], np.uint64).reshape(-1, 4)
        winners = np.frombuffer(row["winners"], np.int64).copy()
        copies = np.frombuffer(row["copies"], np.int64).copy()
        hash_ = PerfectHash(bits, sizes)
    else:
        slots, winners, copies = np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hash_ = PerfectHash(np.zeros(0, np.uint8), np.zeros(0, np.int64))
    keys = _words(new["digest"]) if new.num_rows else np.zeros((0, 4), np.uint64)
    slot = hash_.slot(keys)
    member = slot >= 0
    member[member] = (slots[slot[member]] == keys[member]).all(axis=1)
    new_winner = _ids(new["winner"]) if new.num_rows else np.zeros(0, np.int64)
    new_copies = new["copies"].to_numpy() if new.num_rows else np.zeros(0, np.int64)
    hit = slot[member]  # distinct digests have distinct slots
    repeated = np.zeros(len(slots), bool)
    repeated[hit] = True
    winners[hit] = np.maximum(winners[hit], new_winner[member])
    copies[hit] += new_copies[member]
    every = np.concatenate([slots, keys[~member]])
    keep = np.concatenate([winners, new_winner[~member]])
    return pa.table({
        "digest": pa.array([k.tobytes() for k in every], pa.binary()),
        "keep_id": pa.array(keep, pa.int64(), mask=keep == -(1 << 63)),
        "group_size": pa.array(np.concatenate([copies, new_copies[~member]]), pa.int64()),
        "in_history": pa.array(np.arange(len(every)) < len(slots)),
        "repeated": pa.array(np.concatenate([repeated, np.zeros(int((~member).sum()), bool)]))})


def look_up(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """History and new groups in one: per digest who stays, how many copies, whether it was known.

    Nonmembers of the history come out as groups of their own.
    """
    return (_in_buckets(groups, buckets).groupBy("bucket").cogroup(index.groupBy("bucket"))
            .applyInArrow(lambda new, old: _look_up(old, new),
                          "digest binary, keep_id long, group_size long, in_history boolean, repeated boolean"))


def find_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, in_history``.

    Half of the rows, by a hash of the id, are the earlier delivery whose index is built and stored;
    the other half is looked up in it.
    """
    spark = docs.sparkSession
    rows = written(digests_of(docs, id_column, text_column), "digests")
    earlier = F.pmod(crc_of("doc_id"), F.lit(2)) == 0
    history, new = grouped(rows.where(earlier)), grouped(rows.where(~earlier))
    n = rows.count()
    buckets = max(-(-n // BUCKET_DIGESTS), BUCKETS_PER_PARTITION * shuffle_partitions(spark))
    index = written(build_index(history, buckets), "digest-index")
    verdicts = look_up(index, new, buckets)
    counted = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("_rows"))
    return (counted.join(verdicts, "digest")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "in_history"))


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each text."""
    key = F.concat(F.col("text_sha256"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    dropped = written(
        find_copies(docs, id_column, text_column).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(key.alias("_key")), "dropped")
    own = F.concat(F.sha2(text_of(text_column).cast("binary"), 256),
                   F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    rows = docs.select(own.alias("_key"), F.struct("*").alias("_row"))
    return rows.join(dropped, "_key", "left_anti").dropDuplicates(["_key"]).select("_row.*")
