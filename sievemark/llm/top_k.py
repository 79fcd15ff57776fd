"""Operator 8: exact top-k by inner product with the threshold algorithm over sorted lists.

A task reads its candidates in blocks of ``CANDIDATES``. A block keeps one list per dimension, sorted by component. A
query reads the lists of its non-zero dimensions from the end that suits the sign of its component. The best score
of a vector not met yet is bounded by the product of the query with the components at the present depths. Each round goes
deeper in the dimensions that hold the largest shares of this bound, not in all alike; every vector met there gets its full
score by random access. A query is done with a block when the bound is below its k-th score (a bound equal to it could
still hide a tie with a smaller id). The k-th score is carried from block to block, so a block whose largest components cannot
beat it is left without a single access. When few vectors of a block are unmet they are scored at once. Where the bound at the
depths at which half of a block would be met still reaches the k-th score, no stop can come before that: such queries are scored
against the whole block together.

Queries are a stated set, taken in blocks that are sent to the tasks: candidates are neither copied nor shuffled. The k
best of each task meet in one ranking per query.

Components are integers; products are summed in doubles while they are exact, else in 64-bit integers.
Vectors that are null, hold nulls or non-finite components, or have no id take no part; shorter vectors
count as ending in zeros. A query id counts once (of several vectors the smallest); vectors with the query's own id are
no candidates, other repeated vectors each keep their row. Ties go to the smaller id. Fewer than k candidates give
fewer rows, an empty table none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.frames import tidy, written
from sievemark.session import scratch_folder

#: Vectors of a block of candidates, and components of a block of queries.
CANDIDATES, QUERY_CELLS = 16_384, 1 << 20
#: Depth of the first access to a list, and how much deeper each further one goes.
FIRST_DEPTH, DEEPER = 8, 2
#: Part of the dimensions that a round goes deeper in; part of a block that is scored at once when it alone is unmet.
LEADING, REST = 8, 4
#: Queries scored together against a whole block.
TOGETHER = 128


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``vec_id`` and ``v``: components times ``scale``, rounded down, of the vectors that take part."""
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.where(vector.isNotNull() & F.col(id_column).isNotNull() & finite)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"),
                       F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in column.to_pylist()]


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row[:width]
    return out


class Best:
    """The k best of each query so far, carried from block to block."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        #: Vectors scored and vectors offered, for tests and figures.
        self.scored = self.offered = 0

    def kth(self, query: int) -> int | None:
        return int(self.scores[query][-1]) if len(self.scores[query]) == self.k else None

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[query], scores), np.append(self.ids[query], ids)
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


class SortedLists:
    """A block of candidates: ids, components, and one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def late(self, best: Best, queries: np.ndarray) -> np.ndarray:
        """Which queries cannot stop before half of the block is met; also those without k scores so far."""
        n, width = self.vectors.shape
        used = np.maximum((queries != 0).sum(axis=1), 1)
        depth = np.minimum(n - 1, ((1 - 0.5 ** (1 / used)) * n).astype(np.int64))
        out = np.ones(len(queries), bool)
        for query in range(len(queries)):
            kth = best.kth(query)
            if kth is not None:
                q = queries[query]
                ends = np.where(q < 0, self.values[depth[query]], self.values[n - 1 - depth[query]])
                out[query] = float((q.astype(float) * ends).sum()) >= kth
        return out

    def score_all(self, best: Best, at: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> None:
        """Score the whole block for the queries ``at``."""
        for start in range(0, len(at), TOGETHER):
            part = at[start:start + TOGETHER]
            largest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries[part]).max(initial=0))
            kind = np.float64 if largest * max(1, queries.shape[1]) < 2**53 else np.int64
            scores = (queries[part].astype(kind) @ self.vectors.astype(kind).T).astype(np.int64)
            best.offered += scores.size
            best.scored += scores.size
            for query, row in zip(part.tolist(), scores, strict=True):
                usable = np.flatnonzero(self.ids != query_ids[query])
                if len(usable) > best.k:
                    kth = np.partition(row[usable], len(usable) - best.k)[len(usable) - best.k]
                    usable = usable[row[usable] >= kth]
                if len(usable):
                    best.add(query, row[usable], self.ids[usable])

    def search(self, best: Best, query: int, query_id: int, vector: np.ndarray) -> None:
        """Take what the block holds for one query into ``best``."""
        n = len(self.ids)
        best.offered += n
        dims = np.flatnonzero(vector)
        largest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(vector).max(initial=0))
        kind = np.float64 if largest * max(1, len(vector)) < 2**53 else np.int64
        q, falling = vector[dims].astype(kind), vector[dims] < 0
        depth = np.zeros(len(dims), np.int64)
        unmet = np.ones(n, bool)

        def score(rows: np.ndarray) -> None:
            unmet[rows] = False
            best.scored += len(rows)
            rows = rows[self.ids[rows] != query_id]
            if len(rows):
                best.add(query, (self.vectors[rows][:, dims].astype(kind) @ q).astype(np.int64), self.ids[rows])

        while True:
            # The components at the present depths are the largest that a vector not met can have.
            shares = q * self.values[np.where(falling, depth, n - 1 - depth), dims]
            kth = best.kth(query)
            if kth is not None and int(shares.sum()) < kth:
                return
            deeper = np.argsort(-shares, kind="stable")[:max(1, -(-len(dims) // LEADING))] if len(dims) else dims
            goal = np.minimum(n, np.maximum(FIRST_DEPTH, depth[deeper] * DEEPER))
            if not len(dims) or (goal == n).any() or unmet.sum() * REST <= n:
                score(np.flatnonzero(unmet))
                return
            found = [self.order[d:g, dim] if f else self.order[n - g:n - d, dim] for d, g, dim, f in zip(
                depth[deeper], goal, dims[deeper], falling[deeper], strict=True)]
            rows = np.unique(np.concatenate(found))
            depth[deeper] = goal
            score(rows[unmet[rows]])


def best_of_task(query_ids: np.ndarray, queries: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Best:
    """Search the candidates of a task (``vec_id, v``) for a block of queries, block after block."""
    best = Best(len(query_ids), k)
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def search() -> None:
        width = max(queries.shape[1], 1)  # what a candidate has beyond meets zeros
        lists = SortedLists(np.concatenate(ids), _matrix(rows, width))
        asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        late = lists.late(best, asked)
        lists.score_all(best, np.flatnonzero(late), query_ids, asked)
        for query in np.flatnonzero(~late).tolist():
            lists.search(best, query, int(query_ids[query]), asked[query])
        ids.clear()
        rows.clear()

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy())
            rows += _rows(batch.column(1))
        if len(rows) >= CANDIDATES:
            search()
    if rows:
        search()
    return best


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = written(quantized(vectors, id_column, vector_column, scale), "vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    width = asked.agg(F.max(F.size("v"))).first()[0] or 0
    folder = scratch_folder(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    waiting = asked.toLocalIterator()
    while block := list(islice(waiting, max(1, QUERY_CELLS // max(1, width)))):
        _search_block(rows, block, width, k).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _search_block(rows: DataFrame, block: list, width: int, k: int) -> DataFrame:
    query_ids = np.array([r[0] for r in block], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, _matrix([np.array(r[1], np.int64) for r in block], width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = best_of_task(ids, queries, k, batches)
        sizes = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
            ["query_id", "vec_id", "score"])

    met = rows.select("vec_id", "v").mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
