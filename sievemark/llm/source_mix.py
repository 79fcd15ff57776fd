"""Operator 6: mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

The documents of a source, in the order of a hash of their ids, form a line of words that is cut into
blocks of equal length, about the total over ``SLOTS``. The schedule has ``SLOTS`` places; place i gets
the van der Corput point i (its bits reversed, over ``SLOTS``), and the cumulative targets map the point
to a source. A source whose size or target is under ``FINE`` such blocks has a finer grid of its own:
its blocks are halved until there are so many, and its places lie at fractions of a place. So every
stretch of the schedule holds each source in proportion, and each source has its share of places to
within one, however small it is. The places of a source are ranked; rank r takes block r modulo the
number of blocks, in pass r / blocks, and passes beyond the limit take nothing. What a document gives is
the overlap of its words with the blocks taken, repeats counted.

Hot sources: sums are taken per source and hash bucket first, and words are placed on the line inside
such a bucket, shifted by the buckets before it. Only the list of sources (one row each) is ordered as
a whole. The number of places does not grow with the words, the length of a block does; a source on a
finer grid adds a few thousand.

Null texts have no words, a null source is a source of its own and comes last. Documents without words
are never taken. Repeated rows are documents of their own, in a tie on the line either may come first.
Reruns agree, since all order comes from hashes of ids. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.ordering import with_position
from sievemark.llm.frames import WORD, text_of, written

#: Places of the schedule, as a power of two; hash buckets per source; places per ranking bucket.
SLOT_BITS, BUCKET_BITS, RANK_BITS = 18, 12, 10
SLOTS = 1 << SLOT_BITS
#: Blocks that a source and its target have at least.
FINE = 1024
WEIGHTS = (5, 2, 1)


def number_of_words(text: Column) -> Column:
    """Words become one letter each, what lies between them goes; no array of words is made."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\f\r", "")).cast("long")


def sizes_of(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Id, source, number of words and place in the shuffled order of each document."""
    text = text_of(text_column)
    source = F.col(source_column)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), source.alias("source"),
        number_of_words(text).alias("size"),
        F.xxhash64(F.lit(6), F.col(id_column), F.when(F.col(id_column).isNull(), text)).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))


def _key(text: Column) -> Column:
    """A text as a join key; null gets one of its own."""
    return F.coalesce(F.concat(F.lit("="), text), F.lit("null"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """Sources (``source, source_size``) with rank ``s`` and ``target``; and the total size.

    Targets above ``most`` times the size are cut there and the excess is shared again by weight.
    """
    # Long: a weight times the words of a mix soon exceeds an int, and literals are ints as long as they fit.
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("long")
    ranked = written(
        with_position(sources, [F.col("source").asc_nulls_last()], "s")
        .withColumn("s", F.col("s") - 1).withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight, capped = total, ranked.agg(F.sum("weight")).first()[0] or 1, -1
    while True:  # at most one round per source, each round one aggregate
        over = F.col("cap") * F.lit(open_weight) <= F.col("weight") * F.lit(left)
        now = ranked.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if now[0] == capped or not total or not now[2]:
            break
        capped, left, open_weight = now[0], total - now[1], now[2]
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(open_weight))
    target = F.when(over, F.col("cap").cast("double")).otherwise(share) if total else F.lit(0.0)
    return ranked.withColumn("target", target), total


def with_blocks(sources: DataFrame, total: int) -> DataFrame:
    """Adds how often each source halves the places (``halved``) and its number of ``blocks``."""
    span = max(total, 1)
    least = F.least(F.col("source_size"), F.col("target"))
    halved = F.ceil(F.log2(F.lit(FINE * span / SLOTS) / least))
    return (sources.withColumn("halved", F.when(least > 0, F.greatest(halved, F.lit(0))).otherwise(0).cast("int"))
            .withColumn("blocks", F.greatest(F.lit(1), F.ceil(
                F.col("source_size") * F.pow(F.lit(2.0), "halved") * F.lit(SLOTS / span))).cast("long")))


def schedule(sources: DataFrame, total: int, most: int) -> DataFrame:
    """One row per place of the schedule: ``slot, s, block, pass``; fractions of a slot on finer grids."""
    line = Window.orderBy("s")  # one row per source
    places = F.pow(F.lit(2.0), F.col("halved") + SLOT_BITS)
    end = F.sum("target").over(line.rowsBetween(Window.unboundedPreceding, 0))
    bounds = with_blocks(sources, total).withColumn("_to", F.least(end / F.lit(float(max(total, 1))), F.lit(1.0)))
    bounds = (bounds.withColumn("_start", F.ceil(F.coalesce(F.lag("_to").over(line), F.lit(0.0)) * places))
              .withColumn("_end", F.ceil(F.col("_to") * places)))
    points = bounds.where("_end > _start").select(
        "s", "blocks", "halved", F.explode(F.sequence("_start", F.col("_end") - 1)).alias("_point"))
    bits = F.reverse(F.lpad(F.bin("_point"), F.col("halved") + SLOT_BITS, F.lit("0")))
    slot = F.conv(bits, 2, 10).cast("double") / F.pow(F.lit(2.0), "halved")
    slots = points.select("s", "blocks", slot.alias("slot"))
    slots = slots.withColumn("_part", F.floor(F.col("slot") / (1 << RANK_BITS)))
    counts = slots.groupBy("s", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("s", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("s", "_part").orderBy("slot")) - 1
    return (slots.join(shifts, ["s", "_part"]).withColumn("_rank", F.col("_before") + inside)
            .select("slot", "s", (F.col("_rank") % F.col("blocks")).alias("block"),
                    F.expr("_rank div blocks").alias("pass"))
            .where(F.col("pass") < most))


def on_the_line(sized: DataFrame) -> DataFrame:
    """The first word's position (``start``) of each document on its source's line."""
    sums = sized.groupBy("s", "bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("s", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    ahead = (Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (sized.join(shifts, ["s", "bucket"])
            .withColumn("start", F.col("_shift") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
            .drop("_shift"))


def _scheduled(docs: DataFrame, weights: tuple[int, ...], most: int, id_column: str, text_column: str, source_column: str
               ) -> tuple[DataFrame, DataFrame]:
    """Pieces of documents with the places of the schedule that take them (null ``slot``: none does); documents without words."""
    sized = written(sizes_of(docs, id_column, text_column, source_column), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources, total = with_targets(sources, weights, most)
    sources = written(sources, "targets")
    known = with_blocks(sources, total).select(
        _key(F.col("source")).alias("_key"), "s", "source_size", "target", "blocks")
    rows = sized.withColumn("_key", _key(F.col("source"))).join(known, "_key").drop("_key")
    places = schedule(sources.select("s", "source_size", "target"), total, most)
    # Block j holds the words from j * size / blocks on, so all blocks are evenly full.
    first = F.expr("start * blocks div source_size")
    last = F.expr("(start + size - 1) * blocks div source_size")
    begin = F.greatest("start", F.expr("(block * source_size + blocks - 1) div blocks"))
    end = F.least(F.col("start") + F.col("size"), F.expr("((block + 1) * source_size + blocks - 1) div blocks"))
    pieces = (on_the_line(rows.where("size > 0")).withColumn("block", F.explode(F.sequence(first, last)))
              .withColumns({"first_word": begin - F.col("start"), "words": end - begin}).where("words > 0"))
    return pieces.join(places, ["s", "block"], "left"), rows.where("size = 0")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``; ``taken`` sums the mixture."""
    pieces, empty = _scheduled(docs, weights, most, id_column, text_column, source_column)
    used = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))
    taken = pieces.groupBy("s", "start", "doc_id", "size", "source_size", "target").agg(F.sum(used).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(*columns))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of the schedule: partitions follow one another, each is sorted."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, id_column: str = "doc_id",
            text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixture itself, in the order of the schedule: ``slot, source, pass, doc_id, first_word, words``.

    Each place holds the pieces of documents of one block: so many words of a document from a word (counted from 0) on. Any
    stretch from the start holds every source to within a block of its share.
    """
    pieces, _ = _scheduled(docs, weights, most, id_column, text_column, source_column)
    rows = pieces.where(F.col("slot").isNotNull())
    return _in_order(rows, "slot", "s", "start", "doc_id").select("slot", "source", "pass", "doc_id", "first_word", "words")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3,
                    id_column: str = "doc_id", text_column: str = "text",
                    source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: ``taken / size``, rounded; not at all for 0.

    Copies stand at the places of the schedule that take the document first in each pass, so files and their rows
    follow the mixture. Rounding concerns the one or two documents of a source that lie across the edge of what is taken.
    Rows that share an id, or have none, share one rounded number.
    """
    pieces = written(_scheduled(docs, weights, most, id_column, text_column, source_column)[0].select(
        _key(F.col("doc_id").cast("string")).alias("_key"), "s", "start", "size", "slot", "pass", "words"), "pieces")
    whole = pieces.groupBy("_key", "s", "start", "size").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))).alias("taken")).groupBy("_key").agg(
        F.round(F.expr("try_divide(sum(taken), sum(size))")).cast("int").alias("_times")).where("_times > 0")
    # At most one place a pass and key.
    places = (pieces.where(F.col("slot").isNotNull()).groupBy("_key", "pass").agg(F.min("slot").alias("slot"))
              .groupBy("_key").agg(F.array_sort(F.collect_list("slot")).alias("_slots")))
    times = written(whole.join(places, "_key"), "times")
    rows = docs.select(_key(F.col(id_column).cast("long").cast("string")).alias("_key"), F.struct("*").alias("_row"))
    copies = rows.join(times, "_key").select("_key", "_row", "_slots", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    slot = F.coalesce(F.try_element_at("_slots", F.col("_copy")), F.element_at("_slots", -1))
    return _in_order(copies.withColumn("_slot", slot), "_slot", "_key", "_copy").select("_row.*")
