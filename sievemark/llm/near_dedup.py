"""Operator 10: near duplicates from bottom-k sketches of one hash function.

1. Every document gets its set of hashed five-word shingles; the ``SKETCH`` smallest are its sketch.
   Documents with the same set are one class, represented by its smallest id.
2. Inverted lists. Two sets with a similarity of 0.75 or more agree in half of their sketches or more:
   of the 96 smallest values of the union 72 are expected in both, and fewer than 48 have a probability
   under 4e-8. So, with the values of a sketch in order of how many sketches hold them, two such
   sketches share a value among the rarest half, plus one. Only these values of a class, as far as another
   class holds them too, become entries of lists. What is common to many documents (a passage, a line) so
   costs nothing unless it makes up half of a sketch.
3. Stars. The member of a list whose values are most widespread is its pivot. Each other member is
   compared with the pivot: exact intersection of the full sets. That gives links, and components.
4. The rest. Two members of a list can be linked though not both are linked with the pivot. Of members in
   different components, those are compared whose sets can be similar enough. Either they share a number of
   shingles that the pivot lacks, as what both share with the pivot is at most the smaller of the two shares; or
   three quarters of each lie inside the pivot and are shared there. Inverted lists over the shingles beyond, and over those
   inside the pivot, again with only the rarest as far as that number demands, bring such
   pairs together, and what they share beyond the pivot is counted in full. Such pairs pass the union-sketch estimate (the
   part of the union's smallest values that both hold, at least ``LEAST_ESTIMATE``: six deviations below
   0.75) and are then verified on the full sets.
5. Connected components of all links.

Nothing emits all pairs of a group: a group of m similar documents costs m comparisons with its pivot,
and the others only where a count says that they can be linked. Shingles are compared by 64-bit hashes.
Full sets are made again from the texts of list members only, found with a bit table of fixed size in
front of the exact join.

Null and empty texts have no shingle and are linked with nothing; shorter texts are one shingle. Rows
without id are linked with nothing and stay. Rows repeated under one id are one document in the links and
give one row each. Very long texts, ties and further columns need no special care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.frames import Memo, text_of, tidy, trim, words_of, written

SHINGLE, SKETCH = 5, 96
#: Similarity as a fraction: 100 * intersection >= 75 * union.
OVER, UNDER = 75, 100
LEAST_ESTIMATE = 0.48
#: Bits of the table in front of the exact join to candidate texts (2 MB, whatever the data).
TABLE_BITS = 24


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the distinct runs of five words, ascending; fewer words are one run."""
    n = max(1, len(hashes) - SHINGLE + 1) if len(hashes) else 0
    run = min(SHINGLE, len(hashes))
    with np.errstate(over="ignore"):
        h = np.full(n, run, np.uint64)
        for i in range(run):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return np.unique(h.view(np.int64))


class ShingleSets:
    """Turns texts into shingle sets; word hashes are remembered."""

    def __init__(self):
        self.memo = Memo(lambda word: xxhash.xxh64_intdigest(word))

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        return shingles(np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n`` (size of the set), ``key`` (digest of the set) and ``sketch`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()),
                        ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = ShingleSets()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [sets_of(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists([s[:SKETCH] for s in sets])], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("_text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, key binary, sketch array<bigint>")


def list_entries(classes: DataFrame) -> DataFrame:
    """Entries of the inverted lists: ``value, x, weight`` from ``x, n, sketch``."""
    entries = classes.select("x", F.explode("sketch").alias("value"))
    held = entries.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    size = F.least(F.col("n"), F.lit(SKETCH))
    shared = (entries.join(held, "value").groupBy("x")
              .agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("_values")))  # at most SKETCH
    # Values that no other class holds come first in the order of the whole sketch.
    left = F.lit(1) + size - F.ceil(size / 2) - (size - F.size("_values"))
    kept = shared.join(classes.select("x", "n"), "x").withColumn("_left", left.cast("int")).where("_left > 0")
    weight = F.aggregate("_values", F.lit(0).cast("long"), lambda a, v: a + v["held"])
    return kept.select("x", weight.alias("weight"), F.explode(F.slice("_values", 1, F.col("_left"))).alias("_v")) \
        .select(F.col("_v.value").alias("value"), "x", "weight")


def star_pairs(entries: DataFrame) -> DataFrame:
    """Each member of a list with the list's pivot: distinct ``x, p``."""
    first = F.max(F.struct("weight", (-F.col("x")).alias("minus")))
    pivots = entries.groupBy("value").agg(first.alias("_first")).select("value", (-F.col("_first.minus")).alias("p"))
    return entries.join(pivots, "value").where("x <> p").select("x", "p").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``x, set`` of the documents in ``ids`` (column ``x``), from their texts."""
    spark: SparkSession = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << TABLE_BITS))
    words = (ids.select(place("x").alias("_at")).groupBy(F.shiftright("_at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("bits"))).toArrow()
    bits = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    known = spark.sparkContext.broadcast(bits)
    del words
    trim()  # what came to the driver is not needed on it any more
    schema = pa.schema([("x", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = ShingleSets()
        for batch in batches:
            at = batch.column(1).to_numpy()
            wanted = np.flatnonzero((known.value[at >> 6] >> (at & 63)) & 1)
            for start in range(0, len(wanted), 256):
                part = batch.take(pa.array(wanted[start:start + 256]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists([sets_of(t) for t in part.column(2).to_pylist()])], schema=schema)

    own = F.col(id_column).cast("long")
    rows = docs.where(own.isNotNull()).select(own.alias("x"), place(own).alias("_at"), text_of(text_column).alias("_t"))
    return rows.mapInArrow(tidy(run), "x long, set array<bigint>").join(ids.select("x"), "x", "left_semi")


def linked(inter: Column, first: Column, second: Column) -> Column:
    return UNDER * inter >= OVER * (first + second - inter)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``x, p`` with the sizes ``nx, np``, the size ``i`` of the intersection, and what p lacks."""
    a = sets.select("x", F.col("set").alias("_a"))
    b = sets.select(F.col("x").alias("p"), F.col("set").alias("_b"))
    return (pairs.join(a, "x").join(b, "p")
            .select("x", "p", F.size("_a").alias("nx"), F.size("_b").alias("np"),
                    F.size(F.array_intersect("_a", "_b")).alias("i"), F.array_except("_a", "_b").alias("beyond")))


def components(links: DataFrame) -> DataFrame:
    """``x, c``: the smallest node reachable, for every node of the links ``a, b``.

    Labels flow to neighbours and are then replaced by the labels of their own nodes, so the rounds
    are few also on long chains.
    """
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("x")).alias("c")), "labels")
    while True:
        seen = (edges.join(labels.select(F.col("x").alias("b"), "c"), "b").groupBy(F.col("a").alias("x"))
                .agg(F.min("c").alias("_near")))
        near = labels.join(seen, "x").select("x", F.col("c").alias("_old"), F.least("c", "_near").alias("_near"))
        jump = labels.select(F.col("x").alias("_near"), F.col("c").alias("_far"))
        now = written(near.join(jump, "_near").select("x", "_old", F.least("_near", "_far").alias("c")), "labels")
        if not now.where("c <> _old").limit(1).count():
            return now.select("x", "c")
        labels = now.select("x", "c")


def estimate(first: Column, second: Column) -> Column:
    """Similarity of two sets from their sketches: the part of the union's smallest values in both."""
    smallest = F.slice(F.array_sort(F.array_union(first, second)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(first, second), smallest)) / F.greatest(F.size(smallest), F.lit(1))


def rare_first(values: DataFrame, need: Column) -> DataFrame:
    """Entries ``p, x, c, nx, i, value, rest`` of the inverted lists of stars.

    ``values`` holds a row for each value of a member. With the values of a star in one order, rare ones first, two members that
    share ``need`` of them meet in the first entries: all but ``need - 1`` of each. Values that members of one component alone
    hold are left out. ``rest`` is how many entries a member has from here on.
    """
    both = (values.groupBy("p", "value").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("held"))
            .where("_lo < _hi").select("p", "value", "held"))
    return (values.join(both, ["p", "value"]).groupBy("p", "x", "c", "nx", "i")
            .agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("_values"))
            .withColumn("_left", (F.size("_values") - need + 1).cast("int")).where("_left > 0")
            .select("p", "x", "c", "nx", "i", F.size("_values").alias("_all"),
                    F.posexplode(F.slice("_values", 1, F.col("_left"))).alias("_at", "_v"))
            .select("p", "x", "c", "nx", "i", (F.col("_all") - F.col("_at")).alias("rest"), F.col("_v.value").alias("value")))


def meeting(entries: DataFrame, able: Column) -> DataFrame:
    """Distinct pairs ``p, xa, xb`` of different components that meet in a list where ``able`` holds."""
    sides = [entries.select("p", "value", *[F.col(k).alias(f"{k}{s}") for k in ("x", "nx", "c", "i", "rest")]) for s in "ab"]
    differ = (F.col("xa") < F.col("xb")) & (F.col("ca") != F.col("cb"))
    return sides[0].join(sides[1], ["p", "value"]).where(differ & able).select("p", "xa", "xb").distinct()


def reach(most: Column) -> Column:
    """100 * inter >= 75 * (na + nb - inter), with the most that inter can be."""
    return (UNDER + OVER) * most >= OVER * (F.col("nxa") + F.col("nxb"))


def other_pairs(stars: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``x, p`` of one star, in different components, that can be linked; see step 4."""
    pivots = stars.select(F.col("p").alias("x"), "p", F.col("np").alias("nx"), F.col("np").alias("i"),
                          F.expr("cast(array() as array<bigint>)").alias("beyond")).dropDuplicates(["p"])
    members = stars.select("x", "p", "nx", "i", "beyond").unionByName(pivots)
    members = members.join(found, "x", "left").withColumn("c", F.coalesce("c", "x"))
    split = members.groupBy("p").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("p")
    members = written(members.join(split, "p", "left_semi"), "members")
    # A partner of x has 0.75 of its size or more and shares 0.75 of x's values at least. Without a common value
    # beyond the pivot all of these lie inside it.
    least = F.ceil(OVER * F.col("nx") / F.lit(UNDER))
    close = members.where(UNDER * F.col("i") >= OVER * F.col("nx")).select("p", "x", "c", "nx", "i")
    inside = (close.join(sets, "x").join(sets.select(F.col("x").alias("p"), F.col("set").alias("_pivot")), "p")
              .select("p", "x", "c", "nx", "i", F.explode(F.array_intersect("set", "_pivot")).alias("value")))
    within = meeting(rare_first(inside, least), reach(F.least("resta", "restb"))).select("xa", "xb")
    # With common values beyond the pivot they share ``need`` of these at least.
    beyond = members.select("p", "x", "c", "nx", "i", F.explode("beyond").alias("value"))
    need = F.greatest(F.lit(1), F.ceil((OVER * F.col("nx") - UNDER * F.col("i")) / F.lit(UNDER)))
    # Where a pair first meets, it can share no more than the values from there on.
    met = meeting(rare_first(beyond, need), reach(F.least("ia", "ib") + F.least("resta", "restb")))
    whole = [members.select("p", *[F.col(k).alias(f"{k}{s}") for k in ("x", "nx", "i", "beyond")]) for s in "ab"]
    shared = F.size(F.array_intersect("beyonda", "beyondb"))
    with_more = (met.join(whole[0], ["p", "xa"]).join(whole[1], ["p", "xb"])
                 .where(reach(F.least("ia", "ib") + shared)).select("xa", "xb"))
    return within.unionByName(with_more).distinct().select(F.col("xa").alias("x"), F.col("xb").alias("p"))


def group_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    rows = written(sketches(docs, id_column, text_column), "sketches")
    classes = (rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key")
               .agg(F.min("doc_id").alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    entries = written(list_entries(classes), "lists")
    pairs = written(star_pairs(entries), "stars")
    ids = written(pairs.select("x").unionByName(pairs.select(F.col("p").alias("x"))).distinct(), "members")
    sets = written(full_sets(docs, ids, id_column, text_column), "sets")
    stars = written(measured(pairs, sets), "measured")
    is_link = linked(F.col("i"), F.col("nx"), F.col("np"))
    links = stars.where(is_link).select(F.col("x").alias("a"), F.col("p").alias("b"))
    found = components(links)
    small = rows.join(ids.withColumnRenamed("x", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("x"), "sketch")
    others = (other_pairs(stars, found, sets).join(small.withColumnRenamed("sketch", "_a"), "x")
              .join(small.select(F.col("x").alias("p"), F.col("sketch").alias("_b")), "p")
              .where(estimate(F.col("_a"), F.col("_b")) >= LEAST_ESTIMATE).select("x", "p"))
    more = written(measured(others, sets).where(is_link).select(F.col("x").alias("a"), F.col("p").alias("b")), "others")
    # Components are links themselves: only they and the new links have to be joined up.
    whole = components(found.where("x <> c").select(F.col("x").alias("a"), F.col("c").alias("b")).unionByName(more))
    members = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("x"))
    named = members.join(whole, "x", "left").select("key", F.coalesce("c", "x").alias("_c"))
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    dropped = written(group_near_copies(docs, id_column, text_column).where("NOT kept").select("doc_id").distinct(), "dropped")
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.struct("*").alias("_row"))
    return rows.join(dropped.withColumnRenamed("doc_id", "_id"), "_id", "left_anti").select("_row.*")
