"""Operator 1: toxicity from the nearest labelled examples.

Fitting. From the labels that may be learned from, ``SAMPLE`` rows are drawn by a hash of their id (the bound of all that is
fitted). Equal texts are one example. The terms of a text are its words, the stems of its longer words (the first four
and six bytes), and for each stem the marks that its share of all words reaches. Every term of every example is in the
vocabulary. A term weighs its TF (logarithm of its share of the words) times its IDF (over all documents) times its relevance: how
much more often than expected it occurs in toxic examples, at least 1, to the third power. Four fifths of the sample are the
examples, toxic and clean ones, as unit vectors; the rest calibrates.

Index. Similar examples are brought together in blocks of ``BLOCK``. Terms that few examples hold have posting lists; of the
``COMMON`` most widespread ones each block stores its weights and, as the block's maxima, the largest weight of each.

Scoring. The posting lists give every example its part of the cosine from the rarer terms. With the block maxima this bounds
what any example of a block can reach. A block is completed only where its bound is not below the k-th best
cosine known so far, starting with the blocks of largest bound, so what is skipped cannot be among the ``k`` nearest. The
best are computed once more in full: the cosines are exact. Neighbours vote with the inverse of their distance
together with a weak vote of the prior; the vote is mapped by monotone regression on the calibration part to a probability.
Texts without a neighbour get the share of toxic ones among such texts of the sample. The neighbours are the evidence.

Texts are taken apart by pieces of an Arrow batch: each distinct word of a piece is looked up once, with its stems.

The model is bounded by the sample and is sent to the workers; scoring is one narrow map. Null texts count as empty, empty
texts have no neighbour. Ties among neighbours go to the example that comes first in the hash order of the
sample. Several labels of an id, or of equal texts, count as toxic if one is; null labels and ids are not learned from.
Without any label every text gets 0. Repeated rows, very long texts and further columns need no special care.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import text_of, tidy, trim, written

#: The most labelled rows that are learned from.
SAMPLE = 3_000
BLOCK, NEIGHBOURS, COMMON = 64, 16, 1024
#: Bytes of the stems of longer words, and the marks of the shares of all words that a stem can reach.
STEMS = (4, 6)
LEVELS = ((b"*", 0.0), (b"*1", 0.002), (b"*2", 0.008), (b"*3", 0.03))
#: Occurrences that a term's counts are drawn to the expected by; the prior's part in a vote.
DOUBT, PRIOR = 2.0, 0.2
#: Texts scored together; bytes of texts taken apart together (one longer text goes alone).
BATCH, PIECE = 128, 4 << 20
#: Room for the rounding of single precision, in which blocks are bounded and completed.
ROUNDING = 1e-4
#: ASCII letters and digits stay, A-Z lower-cased; other ASCII separates words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SEPARATORS = bytes(c for c in range(256) if PLAIN[c] == 32)


def terms_in(text: str) -> tuple[dict[bytes, int], int]:
    """All terms of a text with their counts, and its number of words."""
    words = Counter(text.encode("utf-8", "replace").translate(PLAIN).split())
    size = words.total()
    found, stems = dict(words), {}
    for word, n in words.items():
        for length in STEMS:
            if len(word) > length:
                stem = word[:length]
                stems[stem] = stems.get(stem, 0) + n
    for stem, n in stems.items():
        for mark, least in LEVELS:
            if n >= least * size:
                found[stem + mark] = n
    return found, size


def _data(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where each text begins in the data, with the end of the last one, and the data."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    if bounds is None or data is None:  # Arrow may leave them out where there is no text
        return np.zeros(len(texts) + 1, np.int64), pa.py_buffer(b"")
    return np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset), data


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[slice]:
    """Consecutive texts of at most ``most`` bytes together, or a single longer one."""
    bounds, low = _data(texts)[0], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
        yield slice(low, high)
        low = high


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one text after the other, and how many words each text has."""
    bounds, data = _data(texts)
    data, bounds = data[bounds[0]:bounds[-1]].to_pybytes(), bounds - bounds[0]
    inside = np.frombuffer(data.translate(PLAIN), np.uint8) != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]  # words do not go on into the next text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.append(0, np.cumsum(last - first + 1)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data.translate(PLAIN, SEPARATORS))])
    return words, np.diff(np.searchsorted(first, bounds))


Vector = tuple[np.ndarray, np.ndarray]
Neighbours = tuple[np.ndarray, np.ndarray]


def block_order(points: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """An order that brings similar points together: halves along the direction of largest spread, down to blocks."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        low, high = todo.pop()
        if high - low <= size:
            continue
        part = order[low:high]
        inside = points[part] - points[part].mean(axis=0)
        along = inside @ np.linalg.eigh(inside.T @ inside)[1][:, -1]
        order[low:high] = part[np.argsort(np.round(along * np.sign(along[np.argmax(np.abs(along))]), 6), kind="stable")]
        middle = low + -(-(high - low) // (2 * size)) * size  # whole blocks on the left
        todo += [(low, middle), (middle, high)]
    return order


@dataclass
class ToxicityModel:
    """Vocabulary, examples, calibration. The index is made from them where it is needed."""

    terms: dict[bytes, int]
    weights: np.ndarray
    example_ids: np.ndarray
    toxic: np.ndarray
    #: Terms and weights of example i: ``[start[i]:start[i + 1]]``.
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    chances: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    alone: float = 0.0

    @staticmethod
    def of(terms: dict[bytes, int], weights: np.ndarray, ids: list[int], toxic: list[int], vectors: list[Vector]) -> ToxicityModel:
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        join = lambda i, kind: np.concatenate([v[i] for v in vectors]).astype(kind) if vectors else np.zeros(0, kind)
        return ToxicityModel(terms, weights, np.array(ids, np.int64), np.array(toxic, np.int64),
                             np.append(0, np.cumsum(sizes)), join(0, np.int32), join(1, np.float64))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def index(self) -> Index:
        if "_index" not in vars(self):
            self._index = Index(self)
        return self._index

    def _prepare(self) -> None:
        """Rows for words and stems, and for each row its terms: a word's own, a stem's by level (-1: not in the vocabulary).

        As the vocabulary is ascending, the terms of ascending rows are so as well.
        """
        rows: dict[bytes, int] = {}
        marks = {mark: i for i, (mark, _) in enumerate(LEVELS)}
        found = []
        for term, number in self.terms.items():
            part, star, mark = term.partition(b"*")
            found.append((rows.setdefault(part + star, len(rows)), marks[star + mark] if star else 0, number))
        self._levels = np.full((len(rows), len(LEVELS)), -1, np.int64)
        for row, level, number in found:
            self._levels[row, level] = number
        self._least = np.array([least for _, least in LEVELS])
        #: Words, and stems of each length, with their rows; the last row stands for all others.
        self._sets = []
        for length in (0, *STEMS):
            held = [r for r in rows if (len(r) - 1 if r.endswith(b"*") else 0) == length]
            self._sets.append((length, pa.array([r.removesuffix(b"*") for r in held], pa.binary()),
                               np.array([*(rows[r] for r in held), -1], np.int64)))

    def _rows_of(self, words: pa.Array) -> Iterator[np.ndarray]:
        """The rows of the words, then of their stems by length; -1 where there is none."""
        sizes = pc.binary_length(words).to_numpy()
        for length, held, rows in self._sets:
            part = pc.binary_slice(words, 0, length) if length else words
            at = pc.fill_null(pc.index_in(part, value_set=held), -1).to_numpy(zero_copy_only=False)
            yield np.where(sizes > length, rows[at], -1)

    def known(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The terms of some texts that are in the vocabulary: the place of the text, the term, its count, ascending by text and term.

        The last array is each text's number of words. A word is looked up once for all texts.
        """
        if "_sets" not in vars(self):
            self._prepare()
        words, sizes = words_in(texts)
        coded, width = words.dictionary_encode(), len(self._levels)
        codes, base = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)) * width, sizes)
        keys = []
        for rows in self._rows_of(coded.dictionary):
            rows = rows[codes]
            held = rows >= 0
            keys.append(base[held] + rows[held])
        keys = np.sort(np.concatenate(keys))
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.diff(np.append(starts, len(keys)))
        place, rows = np.divmod(keys[starts], max(width, 1))
        levels = self._levels[rows]
        reached = (levels >= 0) & (counts[:, None] >= self._least * sizes[place][:, None])
        many = np.count_nonzero(reached, axis=1)
        return np.repeat(place, many), levels[reached], np.repeat(counts, many), sizes

    def vectors(self, texts: pa.Array) -> list[Vector]:
        """The unit vectors of some texts: terms, ascending, and weights."""
        place, terms, counts, sizes = self.known(texts)
        weights = np.log1p(1000 * counts / sizes[place]) * self.weights[terms]
        ends = np.searchsorted(place, np.arange(len(texts) + 1)).tolist()
        parts = ((terms[low:high], weights[low:high]) for low, high in zip(ends, ends[1:], strict=False))
        return [(t, w / np.linalg.norm(w) if len(t) else w) for t, w in parts]

    def vote(self, near: Neighbours) -> float | None:
        best, cosines = near
        if not len(best):
            return None
        close = cosines / (1 - np.minimum(cosines, 1) + 0.05)
        prior = self.toxic.mean()
        return float((close @ self.toxic[best] + PRIOR * prior) / (close.sum() + PRIOR))

    def nearest(self, vectors: list[Vector]) -> list[Neighbours]:
        return [n for at in range(0, len(vectors), BATCH) for n in self.index().nearest(vectors[at:at + BATCH])]

    def scores(self, texts: pa.Array | list[str]) -> list[tuple[float, Neighbours]]:
        near = self.nearest(self.vectors(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
        votes = [self.vote(n) for n in near]
        return [(self.alone if v is None else float(np.interp(v, self.votes, self.chances)), n)
                for v, n in zip(votes, near, strict=True)]

    def evidence(self, near: list[Neighbours]) -> pa.ListArray:
        """The neighbours of each text as rows of the example's id, the cosine and the label."""
        best = np.concatenate([n[0] for n in near]) if near else np.zeros(0, np.int64)
        cosines = np.concatenate([n[1] for n in near]) if near else np.zeros(0)
        rows = pa.StructArray.from_arrays([
            pa.array(self.example_ids[best], pa.int64()), pa.array(np.minimum(cosines, 1)),
            pa.array(self.toxic[best].astype(np.int32))], ["example_id", "cosine", "toxic"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(n[0]) for n in near)]), pa.int32()), rows)

    def calibrate(self, vectors: list[Vector], toxic: list[int]) -> None:
        """Monotone regression of the labels on the votes (pool adjacent violators).

        Labels of texts without neighbours set the probability of such texts.
        """
        every = [*self.toxic.tolist(), *toxic]
        votes = [self.vote(n) for n in self.nearest(vectors)]
        without = self.toxic[np.diff(self.start) == 0].tolist() + [t for v, t in zip(votes, toxic, strict=True) if v is None]
        self.alone = (sum(without) + sum(every) / len(every)) / (len(without) + 1)
        pools: list[list[float]] = []  # sum of votes, sum of labels, number
        for vote, label in sorted((v, t) for v, t in zip(votes, toxic, strict=True) if v is not None):
            pools.append([vote, label, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            chances = [(p[1] + 0.1) / (p[2] + 0.2) for p in pools]
            self.votes = np.array([0.0] + [p[0] / p[2] for p in pools] + [1.0])
            self.chances = np.maximum.accumulate([0.0] + chances + [max(chances)])


class Index:
    """Block-max inverted index of a model's examples."""

    def __init__(self, model: ToxicityModel, common: int = COMMON):
        self.start, self.term, self.weight = model.start, model.term.astype(np.intp), model.weight
        self.n, self.terms = len(model.toxic), len(model.weights)
        self.blocks = -(-self.n // BLOCK)
        self.query = np.zeros(self.terms)
        row = np.repeat(np.arange(self.n), np.diff(self.start))
        held = np.bincount(self.term, minlength=self.terms)
        #: Column of each common term; -1: it has a posting list.
        self.column = np.full(self.terms, -1, np.int64)
        widest = np.argsort(-held, kind="stable")[:common]
        widest = widest[held[widest] > 1]
        self.column[widest] = np.arange(len(widest))
        at = self.column[self.term]
        self.full = np.zeros((self.blocks * BLOCK, len(widest)), np.float32)
        self.full[row[at >= 0], at[at >= 0]] = self.weight[at >= 0]
        self.full = self.full.reshape(self.blocks, BLOCK, len(widest))
        self.most = self.full.max(axis=1) if self.n else np.zeros((0, len(widest)), np.float32)
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.posting_start = np.searchsorted(self.term[rare], np.arange(self.terms + 1))
        self.posting_row, self.posting_weight = row[rare], self.weight[rare]
        #: Blocks completed and blocks bounded, for tests and figures.
        self.completed = self.bounded = 0

    def _rare_part(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = self.posting_start[terms]
        sizes = self.posting_start[terms + 1] - first
        places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        places += np.arange(len(places))
        parts = self.posting_weight.take(places)
        parts *= np.repeat(weights, sizes)
        return np.bincount(self.posting_row.take(places), parts, minlength=self.blocks * BLOCK)

    def _exact(self, vector: Vector, rows: np.ndarray) -> np.ndarray:
        """Cosines with a few examples, each of which has terms, in double precision."""
        query, start, term, weight = self.query, self.start, self.term, self.weight
        query[vector[0]] = vector[1]
        bounds = zip(start[rows].tolist(), start[rows + 1].tolist(), strict=True)
        out = np.array([weight[low:high] @ query.take(term[low:high]) for low, high in bounds])
        query[vector[0]] = 0
        return out

    def nearest(self, vectors: list[Vector], k: int = NEIGHBOURS) -> list[Neighbours]:
        """The k nearest examples of each vector and their cosines, exact, best first."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        sums = np.zeros((len(vectors), self.blocks * BLOCK), np.float32)
        asked = np.zeros((len(vectors), self.full.shape[2]), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            at = self.column[terms]
            asked[i, at[at >= 0]] = weights[at >= 0]
            sums[i] = self._rare_part(terms[at < 0], weights[at < 0])
        in_blocks = sums.reshape(len(vectors), self.blocks, BLOCK)
        bounds = in_blocks.max(axis=2) + asked @ self.most.T + ROUNDING / 2
        done = np.repeat(np.array([[not len(terms)] for terms, _ in vectors]), self.blocks, axis=1)  # nothing can be near those

        def complete(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, block])
                in_blocks[rows, block] += asked[rows] @ self.full[block].T
            done[wanted] = True

        kth = min(k, sums.shape[1])
        # What is known of an example is never more than its cosine, so the k-th best known is a threshold.
        threshold = lambda: -np.partition(-sums, kth - 1, axis=1)[:, kth - 1:kth]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1)[:, :2], True, axis=1)
        complete(first & ~done)
        complete(~done & (bounds >= threshold() - ROUNDING / 2))
        self.completed += int(done.sum())
        self.bounded += done.size
        # A block that was not completed holds none of the k nearest: its bound is below the threshold.
        low = threshold() - ROUNDING
        in_blocks[~done] = -1
        out = []
        for i, vector in enumerate(vectors):
            rows = np.flatnonzero((sums[i] >= low[i]) & (sums[i] > 0))
            cosines = self._exact(vector, rows) if len(rows) else np.zeros(0)
            order = np.lexsort((rows, -np.round(cosines, 12)))[:k]
            order = order[cosines[order] > 0]
            out.append((rows[order], cosines[order]))
        return out


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts (``_text, _toxic``) each term occurs, counted per batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            counts = Counter(), Counter()
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts[label].update(terms_in(text)[0].keys())
            every = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(every, pa.binary()), pa.array([counts[1][t] for t in every], pa.int64()),
                pa.array([counts[0][t] for t in every], pa.int64())], names=["term", "toxic", "clean"])


def _frequencies(docs: DataFrame, text: Column, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term of the vocabulary occurs, and how many documents there are."""
    width = len(terms)
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel.of(terms, np.ones(width), [], [], []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(width + 1, np.int64), 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                counts[:-1] += np.bincount(shared.value.known(batch.column(0)[piece])[1], minlength=width)
            rows += batch.num_rows
        counts[-1] = rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "docs"])

    counted = docs.select(text).mapInArrow(tidy(run), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[counted["term"].to_numpy()] = counted["docs"].to_numpy()
    return out[:-1], int(out[-1])


def relevance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """How much more often than expected a term occurs in toxic examples, at least 1, to the third power."""
    return np.maximum(1.0, (toxic + DOUBT) / ((toxic + clean) * share + DOUBT)) ** 3


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Learn from ``labels`` (ids and 0 or 1) where ``may_learn``, a condition on the id, holds."""
    spark = docs.sparkSession
    known = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).where(may_learn)
             .groupBy(F.col(id_column).cast("long").alias("_id"))
             .agg(F.max((F.col(label_column) == 1).cast("int")).alias("_toxic"))
             .withColumn("_order", F.xxhash64("_id", F.lit(1))))
    # Hashes are even, so a bound on them leaves about twice the sample to be ordered.
    part = min(1.0, 2 * sample / max(known.count(), 1))
    known = known.where(F.col("_order") <= min((1 << 63) - 1, int(part * (1 << 64)) - (1 << 63))).orderBy("_order", "_id").limit(sample)
    drawn = spark.createDataFrame(known.toArrow())  # at most ``sample`` rows
    text = text_of(text_column).alias("_text")
    # Equal texts are one example: the first in the order of the sample, toxic if one of them is.
    first = F.min(F.struct("_order", "_id")).alias("_first")
    texts = written(docs.select(F.col(id_column).cast("long").alias("_id"), text)
                    .join(F.broadcast(drawn), "_id").groupBy("_text").agg(F.max("_toxic").alias("_toxic"), first)
                    .select("_text", "_toxic", "_first._order", "_first._id"), "examples")
    example = F.pmod(F.col("_order"), F.lit(5)) != 0
    counted = (texts.where(example).select("_text", "_toxic")
               .mapInArrow(tidy(_class_counts), "term binary, toxic long, clean long")
               .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow().sort_by("term"))
    terms = {t: i for i, t in enumerate(counted["term"].to_pylist())}
    sizes = {r[0]: r[1] for r in texts.where(example).groupBy("_toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    held, every = _frequencies(docs, text, terms)
    weights = (np.log((1 + every) / (1 + held)) + 1) * relevance(counted["toxic"].to_numpy(), counted["clean"].to_numpy(), share)
    frame = ToxicityModel.of(terms, weights, [], [], [])
    shared = spark.sparkContext.broadcast(frame)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [v for piece in pieces(batch.column(0)) for v in shared.value.vectors(batch.column(0)[piece])]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array([t for t, _ in made], pa.list_(pa.int32())),
                pa.array([w for _, w in made], pa.list_(pa.float64()))], ["_toxic", "_order", "_id", "terms", "weights"])

    # The sample comes to the driver as vectors over the vocabulary.
    rows = texts.select("_text", "_toxic", "_order", "_id").mapInArrow(
        tidy(vectors), "_toxic int, _order long, _id long, terms array<int>, weights array<double>").toArrow()
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("_order", "_id", "_toxic")), rows["terms"], rows["weights"], strict=True),
                  key=lambda r: r[:2])
    as_vector = lambda r: (np.array(r[3].values, np.int64), np.array(r[4].values, float))
    examples, rest = [r for r in rows if r[0] % 5], [r for r in rows if not r[0] % 5]
    found = [as_vector(r) for r in examples]
    order = block_order(projected(found, len(terms)))
    model = ToxicityModel.of(terms, weights, [examples[i][1] for i in order], [examples[i][2] for i in order],
                             [found[i] for i in order])
    if rows:
        model.calibrate([as_vector(r) for r in rest], [r[2] for r in rest])
    return model


def projected(vectors: list[Vector], terms: int, dimensions: int = 24) -> np.ndarray:
    """The vectors by random signs in few dimensions, from a fixed seed."""
    signs = np.random.default_rng(1).choice(np.float32([-1, 1]), (terms, dimensions))
    return np.array([w @ signs[t] for t, w in vectors]).reshape(len(vectors), dimensions)


def _in_pieces(work: Callable[[pa.RecordBatch], pa.RecordBatch], at: int) -> Callable:
    """``work`` on pieces of the batches by the texts in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                yield work(batch[piece])

    return tidy(run)


def _shared(docs: DataFrame, model: ToxicityModel):
    """The model for all tasks; what it was learned from leaves the driver's memory."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    trim()
    return shared


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``score``, ``predicted`` and the ``evidence``."""
    shared = _shared(docs, model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scored = shared.value.scores(part.column(1))
        return pa.RecordBatch.from_arrays([
            part.column(0), pa.array([s for s, _ in scored], pa.float64()),
            shared.value.evidence([n for _, n in scored])], [id_column, "score", "evidence"])

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), text_of(text_column).alias("_text"))
    scored = rows.mapInArrow(
        _in_pieces(work, 1),
        f"`{id_column}` long, score double, evidence array<struct<example_id: bigint, cosine: double, toxic: int>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with all their columns."""
    shared = _shared(docs, model)
    at = docs.columns.index(text_column)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([s < threshold for s, _ in shared.value.scores(part.column(at))], pa.bool_()))

    return docs.mapInArrow(_in_pieces(work, at), docs.schema)
