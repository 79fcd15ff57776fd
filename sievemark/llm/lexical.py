"""Operator 11: ranked lexical search over posting lists in geometric blocks.

1. ``index`` reads every whole text once and writes, for each document with a term, its number of terms and
   its distinct terms with their counts. From it come the corpus statistics (documents, terms, document frequencies).
2. Items are taken in blocks of ``ITEMS``; a block's terms get numbers and weights. Every task reads its documents in
   segments. In a segment each term has its posting list. A list is clustered by document similarity: some
   of its documents, evenly spaced, are centres, each other joins the nearest one (distance between randomly projected,
   weighted impact vectors), and a cluster is a block, cut where it is larger than twice ``BLOCK``. A block stores
   its summary: the maximum of its documents' impacts in each coordinate that a search may ask for.
3. An item's terms are walked from the heaviest weight to the lightest. A document is judged in the list of the first of the
   item's terms that it holds, so what a block of that list can still reach is the inner product of its summary with this
   and the lighter terms. Only where that bound is below the item's k-th best score the block is skipped; all others are
   scored in full. The best scores go along from segment to segment of a task; the best of all tasks are merged in Spark.

All sums are exact: in doubles as long as every possible sum stays below 2**53, in 64-bit integers otherwise.

Defined results: null and empty texts have no terms; such documents do not count, such items have no rows. Documents
without an id count and rank after those with one at equal scores. Rows of one id rank separately, also
with equal texts; items of one id too. Other columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.frames import text_of, tidy, written
from sievemark.session import scratch_folder

TOP = 10
#: Parts of the length normalisation, in hundredths, and of the saturation, in thousandths.
SLOPE, SATURATION, IMPACT, WEIGHT = 75, 8, 1_000_000_000, 1000
#: Items searched for at a time; documents of a segment, and cells of its impact matrix.
ITEMS, SEGMENT, CELLS = 256, 4096, 1 << 24
#: Documents of a block, about; coordinates of the projection for the clustering.
BLOCK, PROJECTED = 24, 32
#: Lower-cases A-Z and turns all ASCII but letters and digits into spaces; all other bytes are parts of terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split()


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` of each row with a term, written once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.binary())),
                        ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [Counter(terms_of(text)) for text in part.column(1).to_pylist()]
                kept = [i for i, counts in enumerate(found) if counts]
                offsets = pa.array(np.cumsum([0, *(len(found[i]) for i in kept)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(kept, pa.int64())),
                    pa.array([sum(found[i].values()) for i in kept], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array([t for i in kept for t in found[i]], pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array([c for i in kept for c in found[i].values()], pa.int32())),
                ], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("_text"))
    return written(rows.mapInArrow(tidy(run), "doc_id long, n long, terms array<binary>, counts array<int>"), "lexical-index")


def document_frequencies(indexed: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """In how many documents each term occurs; one number a term comes back, whatever the documents."""
    values = pa.array(vocabulary, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(values), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=values).drop_null().to_numpy()
            held += np.bincount(at, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "held"])

    counted = indexed.select("terms").mapInArrow(tidy(run), "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    out = np.zeros(len(vocabulary), np.int64)
    rows = counted.toArrow()
    out[rows["term"].to_numpy()] = rows["held"].to_numpy()
    return out


@dataclass
class Plan:
    """What a block of items asks for: terms by number, heaviest first, and who asks for them."""

    vocabulary: list[bytes]
    weights: np.ndarray
    #: For each item its terms, heaviest first, and weight times repeats of each.
    terms: list[np.ndarray]
    shares: list[np.ndarray]
    documents: int
    length: int
    #: For each term: the items that hold it, the coordinates that count from it on, and their shares (one column an item).
    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def of(items: list[Counter], frequency: dict[bytes, int], documents: int, length: int) -> Plan:
        weight = {t: math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * held + 1))) for t, held in frequency.items() if held}
        # Heaviest first; a term without weight adds nothing to any score.
        vocabulary = sorted((t for t, w in weight.items() if w > 0), key=lambda t: (-weight[t], t))
        number = {t: i for i, t in enumerate(vocabulary)}
        terms, shares = [], []
        for item in items:
            own = sorted(number[t] for t in item if t in number)
            terms.append(np.array(own, np.int64))
            shares.append([item[vocabulary[i]] * weight[vocabulary[i]] for i in own])
        exact = max((sum(s) for s in shares), default=0) * (IMPACT // 1000) < 1 << 53
        kind = np.float64 if exact else np.int64
        plan = Plan(vocabulary, np.array([weight[t] for t in vocabulary], float), terms,
                    [np.array(s, kind) for s in shares], documents, length)
        holders: list[list[int]] = [[] for _ in vocabulary]
        for i, own in enumerate(terms):
            for t in own.tolist():
                holders[t].append(i)
        for t, held_by in enumerate(holders):
            rest = [own[np.searchsorted(own, t):] for own in (terms[i] for i in held_by)]
            coordinates = np.unique(np.concatenate(rest))
            table = np.zeros((len(coordinates), len(held_by)), kind)
            for column, (i, own) in enumerate(zip(held_by, rest, strict=True)):
                table[np.searchsorted(coordinates, own), column] = shares[i][len(terms[i]) - len(own):]
            plan.asked.append((np.array(held_by), coordinates, table))
        return plan

    def impacts(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 100 - SLOPE + SLOPE * sizes * self.documents // self.length
        return IMPACT * counts // (1000 * counts + SATURATION * m)


@dataclass
class Best:
    """The best documents of each item so far: scores descending, equal ones by id, those without an id last."""

    k: int
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    least: np.ndarray
    #: Pairs of an item and a document scored, and pairs that share a term; blocks scored and met.
    scored: int = 0
    pairs: int = 0
    opened: int = 0
    blocks: int = 0

    @staticmethod
    def empty(items: int, k: int) -> Best:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        return Best(k, [none] * items, np.ones(items, np.int64))

    def add(self, item: int, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        fine = scores >= self.least[item]
        kept = [np.concatenate(pair) for pair in zip(self.rows[item], (x[fine] for x in (scores, no_id, ids)), strict=True)]
        order = np.lexsort((kept[2], kept[1], -kept[0]))[:self.k]
        self.rows[item] = tuple(x[order] for x in kept)
        if len(order) == self.k:
            self.least[item] = max(1, self.rows[item][0][-1])


def blocks_of(rows: np.ndarray, places: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a posting list in block order, and where blocks start; ``places`` holds a point for each document."""
    if len(rows) <= size:
        return rows, np.zeros(1, np.int64)
    points = places[rows]
    centres = points[np.linspace(0, len(rows) - 1, -(-len(rows) // size)).astype(np.int64)]
    nearest = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
    order = np.argsort(nearest, kind="stable")
    ranked = nearest[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    within = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[order], np.flatnonzero(within % (2 * size) == 0)


def search_segment(plan: Plan, best: Best, ids: np.ndarray, no_id: np.ndarray, row: np.ndarray, term: np.ndarray,
                   impact: np.ndarray, size: int = BLOCK) -> None:
    """Take the documents of one segment (postings as ``row, term, impact``) into ``best``."""
    width = len(plan.vocabulary)
    cells = np.zeros((len(ids), width), np.int32)
    cells[row, term] = impact
    signs = np.random.default_rng(11).choice(np.float32([-1, 1]), (width, PROJECTED))
    places = cells.astype(np.float32) @ (signs * (plan.weights / 1e6).astype(np.float32)[:, None])
    by_term = np.argsort(term, kind="stable")
    edges = np.searchsorted(term[by_term], np.arange(width + 1))
    seen = np.zeros((len(plan.terms), len(ids)), bool)
    for t in range(width):
        if edges[t] == edges[t + 1]:
            continue
        rows, starts = blocks_of(row[by_term[edges[t]:edges[t + 1]]], places, size)
        held_by, coordinates, table = plan.asked[t]
        summaries = np.maximum.reduceat(cells[np.ix_(rows, coordinates)], starts, axis=0)
        bounds = summaries.astype(table.dtype) @ table
        hits = bounds >= best.least[held_by]
        best.blocks += hits.size
        best.pairs += len(rows) * len(held_by)
        lengths = np.diff(np.append(starts, len(rows)))
        for column in np.flatnonzero(hits.any(axis=0)):
            item = held_by[column]
            chosen = rows[np.repeat(hits[:, column], lengths)]
            chosen = chosen[~seen[item, chosen]]
            best.opened += int(hits[:, column].sum())
            if not len(chosen):
                continue
            seen[item, chosen] = True
            best.scored += len(chosen)
            scores = cells[np.ix_(chosen, plan.terms[item])].astype(table.dtype) @ plan.shares[item]
            best.add(item, scores.astype(np.int64), no_id[chosen], ids[chosen])


def best_of_task(plan: Plan, k: int, batches: Iterator[pa.RecordBatch]) -> Best:
    """Search the documents of a task (batches of the index), segment after segment."""
    values = pa.array(plan.vocabulary, pa.binary())
    most = max(1, min(SEGMENT, CELLS // max(1, len(values))))
    best = Best.empty(len(plan.terms), k)
    held: list[tuple] = []

    def search() -> None:
        sizes = [len(h[0]) for h in held]
        shift = np.repeat(np.cumsum([0, *sizes[:-1]]), [len(h[2]) for h in held])
        ids, no_id, row, term, impact = (np.concatenate(part) for part in zip(*held, strict=True))
        search_segment(plan, best, ids, no_id, row + shift, term, impact)
        held.clear()

    waiting = 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            lists = part.column(2)
            found = pc.index_in(lists.flatten(), value_set=values)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            row = pc.list_parent_indices(lists).to_numpy()[at]
            impact = plan.impacts(part.column(3).flatten().to_numpy()[at].astype(np.int64), part.column(1).to_numpy()[row])
            if waiting + part.num_rows > most and held:
                search()
                waiting = 0
            held.append((part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False),
                         row, found.drop_null().to_numpy().astype(np.int64), impact))
            waiting += part.num_rows
    if held:
        search()
    return best


def search_block(indexed: DataFrame, items: list[tuple[object, str]], documents: int, length: int, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for a bounded block of items."""
    terms = [Counter(terms_of(text)) for _, text in items]
    vocabulary = sorted(set().union(*terms))
    frequency = dict(zip(vocabulary, document_frequencies(indexed, vocabulary).tolist(), strict=True))
    plan = indexed.sparkSession.sparkContext.broadcast(Plan.of(terms, frequency, documents, length))
    names = [item_id for item_id, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = best_of_task(plan.value, k, batches)
        for item, (scores, no_id, ids) in enumerate(best.rows):
            n = len(scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, item, np.int32)), pa.array([names[item]] * n, pa.int64()),
                 pa.array(ids, pa.int64(), mask=no_id), pa.array(scores, pa.int64())], ["item", "item_id", "doc_id", "score"])

    found = indexed.mapInArrow(tidy(run), "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    indexed = index(docs, id_column, text_column)
    documents, length = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    folder = scratch_folder(spark, "lexical-results")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    asked = ((r[0], r[1]) for r in items.select(F.col(item_column).cast("long"), text_of(item_text)).toLocalIterator())
    while documents and (block := list(islice(asked, ITEMS))):
        search_block(indexed, block, documents, length, k).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
