"""Operator 12: quality rules as an isolation forest over rule statistics.

1. One pass over the whole texts gives the rule statistics of each document. They are written once
   (a few numbers a row); everything after works on them.
2. The forest is fitted on the statistics of all labelled rows. Each of ``TREES`` trees draws its own ``PSI`` of them, those
   with the smallest hashes for that tree (that a tree sees few rows is what makes odd ones stand out), and splits
   them at a random value of a random feature that still varies, until single rows are left or the depth reaches
   log2(``PSI``). A leaf that keeps several rows adds the expected depth of a tree over them. The features (``FEATURES``) are ratios
   drawn towards an ordinary text by a number of words added to each, so that a short text is not odd for its
   length alone; symbols count on a logarithmic scale, and the two kinds of repetition, which come together, as one.
3. The score of a document is ``2 ** (-mean path length / expected path length)``: near 1 where few splits
   set it apart. The cut is calibrated on all labelled rows that pass the base rule: the one with the
   greatest share of low-quality rows above it minus ``CLEAN_WEIGHT`` times the share of good rows above it,
   placed midway between two neighbouring scores. A document at or above the cut is not kept. The driver gets the
   ``TREES * PSI`` rows drawn and the cut; the labelled rows stay in Spark.

Defined results: a null text is an empty one; it has no words, so the base rule drops it. Rows without an id or with
a repeated id are judged like all others. Labels without a quality count as no label; of several labels of an id the lower counts.
With no labelled rows, or none of one of the two kinds, there is no cut and the base rule alone decides. Other
columns are not looked at, so their names cannot clash. Reruns agree: the draws follow from hashes of the rows and a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.frames import per_row, text_of, tidy, written

TREES, PSI = 128, 256
#: Ranges of scores within which the cut is looked for side by side.
RANGES = 1 << 12
#: One good document lost weighs as much as this many low-quality ones caught.
CLEAN_WEIGHT = 10.0
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("characters a word", "symbols a word", "repeated lines and words a word")
#: Ordinary words of five characters added to every text for the first feature, and words for the third.
MORE_WORDS, MORE_REPEATED = 100, 200


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five that occurs twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    base = len(known)
    if base**WINDOW < 1 << 62:  # a window is one number in base ``base``
        keys = np.zeros(n - WINDOW + 1, np.int64)
        for i in range(WINDOW):
            keys = keys * base + ids[i:i + len(keys)]
    else:  # ranks of pairs, of fours, of fives: no two windows share a number either
        two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (n + 1) + two[2:], return_inverse=True)[1]
        keys = four[:-1] * (n + 1) + ids[WINDOW - 1:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    starts = order[np.append(same, False) | np.insert(same, 0, False)]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def statistics_of(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    spaces = len(data) - len(data.translate(None, SPACES))
    return (len(words), len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the rule statistics of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in STATISTICS)])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("_text"))
    return rows.mapInArrow(per_row(statistics_of, ["doc_id"], schema),
                           "doc_id long, " + ", ".join(f"{name} long" for name in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    words = columns["n_words"].astype(float)
    return np.column_stack([
        (columns["word_chars"] + 5 * MORE_WORDS) / (words + MORE_WORDS),
        np.log1p(100 * columns["n_symbols"] / np.maximum(words, 1)),
        (columns["n_dup_lines"] + columns["n_repeat_words"]) / (words + MORE_REPEATED)])


def expected_path(n: int) -> float:
    """Mean depth at which a search in a random tree over ``n`` rows ends."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as flat arrays: a node's children are at ``child`` and ``child + 1``; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    scale: float
    #: Scores from here on are anomalous; infinite without a calibration.
    threshold: float = float("inf")

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Path length of each row (first axis) in each tree."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.child[at] + (x[row, self.feature[at]] >= self.cut[at])
        return self.path[at]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.exp2(-self.paths(x).mean(axis=1) / self.scale) if len(x) else np.zeros(0)


def grow(x: np.ndarray, seed: int = 12, trees: int = TREES, psi: int = PSI) -> Forest:
    """A forest over the rows of ``x``."""
    draw = np.random.default_rng(seed)
    psi = min(psi, len(x))
    return grown((x[draw.choice(len(x), psi, replace=False)] for _ in range(trees)), draw, psi)


def grown(drawn: Iterable[np.ndarray], draw: np.random.Generator, psi: int) -> Forest:
    """A tree over each of the sets of (about) ``psi`` rows."""
    depth = int(np.ceil(np.log2(max(psi, 2))))
    feature, cut, child, path, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, 0), (cut, np.inf), (child, len(child)), (path, 0.0)):
            column.append(value)
        return len(child) - 1

    for own in drawn:
        roots.append(node())
        todo = [(roots[-1], own, 0)]
        while todo:
            at, rows, level = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(high > low)
            if level == depth or not len(able):
                path[at] = level + expected_path(len(rows))
                continue
            f = int(draw.choice(able))
            value = draw.uniform(low[f], high[f])
            above = rows[:, f] >= value
            if above.all():  # the draw met the minimum itself
                value = high[f]
                above = rows[:, f] >= value
            feature[at], cut[at] = f, value
            child[at] = node()
            node()
            todo += [(child[at], rows[~above], level + 1), (child[at] + 1, rows[above], level + 1)]
    return Forest(*(np.array(c) for c in (feature, cut, child, path, roots)), depth, max(expected_path(psi), 1.0))


def calibrated(scores: np.ndarray, low: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The cut that parts rows marked ``low`` from the others best; infinite if none does."""
    if not len(scores) or low.all() or not low.any():
        return float("inf")
    values = np.unique(scores)
    caught = 1.0 - np.searchsorted(np.sort(scores[low]), values) / low.sum()
    lost = 1.0 - np.searchsorted(np.sort(scores[~low]), values) / (~low).sum()
    gain = caught - clean_weight * lost
    best = len(values) - 1 - int(np.argmax(gain[::-1]))  # of equal gains the highest cut
    if gain[best] <= 0:
        return float("inf")
    return float(values[best] if best == 0 else (values[best - 1] + values[best]) / 2)


def draws(rows: DataFrame, n: int, trees: int = TREES, psi: int = PSI) -> list[np.ndarray]:
    """For each tree the ``psi`` of all ``n`` rows of statistics that its hashes put first.

    Equal rows are told apart by a number, so each is drawn for itself. Hashes far above those of the first ``psi`` are left
    in the tasks: of ``4 * psi`` expected for a tree, the first ``psi`` go on.
    """
    apart = rows.groupBy("doc_id", *STATISTICS).agg(F.count("*").alias("_n")).select(
        "doc_id", *STATISTICS, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    least = apart.select(F.xxhash64("doc_id", *STATISTICS, "_copy").alias("_h"), *STATISTICS)
    most = np.uint64(min(1.0, 4 * psi / max(n, 1)) * (2**63 - 1024))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for tree in range(trees):
                h = own + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                h = (h ^ (h >> np.uint64(31))) >> np.uint64(1)
                first = np.flatnonzero(h <= most)
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), tree)), pa.array(h[first].astype(np.int64)),
                         *(c.take(pa.array(first)) for c in batch.columns[1:])], ["tree", "place", *STATISTICS])

    found = least.mapInArrow(tidy(run), "tree long, place long, " + ", ".join(f"{name} long" for name in STATISTICS))
    order = Window.partitionBy("tree").orderBy("place", *STATISTICS)
    table = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= psi).toArrow()
    x, tree = features({name: table[name].to_numpy() for name in STATISTICS}), table["tree"].to_numpy()
    return [x[tree == t] for t in range(trees) if (tree == t).any()]


def cut_of(scored: DataFrame, clean_weight: float = CLEAN_WEIGHT) -> float:
    """``calibrated`` for rows (``anomaly``, ``low``) of any number: the same cut, by sums over ranges of the scores."""
    counted = written(scored.groupBy("anomaly").agg(
        F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("good")).withColumn(
        "_range", F.floor(F.col("anomaly") * RANGES)), "scores")
    sums = counted.groupBy("_range").agg(F.sum("low").alias("_low"), F.sum("good").alias("_good"))
    low, good = sums.agg(F.sum("_low"), F.sum("_good")).first()
    if not low or not good:
        return float("inf")
    none = F.lit(0)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    inside = Window.partitionBy("_range").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *[F.coalesce(F.sum(c).over(ranges), none).alias(c) for c in ("_low", "_good")])
    below = {c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), none) for c in ("low", "good")}
    rows = counted.join(F.broadcast(before), "_range").select("anomaly", *[x.alias(c) for c, x in below.items()])
    gain = (1.0 - F.col("low") / low) - clean_weight * (1.0 - F.col("good") / good)
    best = rows.agg(F.max(F.struct(gain.alias("gain"), "anomaly")).alias("b")).first().b  # of equal gains the highest cut
    if best.gain <= 0:
        return float("inf")
    under = counted.where(F.col("anomaly") < best.anomaly).agg(F.max("anomaly")).first()[0]
    return best.anomaly if under is None else (under + best.anomaly) / 2


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Forest | None:
    """The forest and its cut from all labelled rows; None where no row is labelled."""
    marks = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min(label_column).cast("int").alias("_mark")))
    labelled = written(stats.join(marks, "doc_id").select("doc_id", *STATISTICS, "_mark"), "labelled")
    n = labelled.count()
    if not n:
        return None
    forest = grown(draws(labelled, n), np.random.default_rng(12), min(PSI, n))
    passed = labelled.where(~base_failed()).select(*STATISTICS, (F.col("_mark") == 0).alias("low"))
    forest.threshold = cut_of(scored(passed, forest))
    return forest


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` with ``anomaly``, the forest's score of their statistics."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = features({n: part.column(names.index(n)).to_numpy() for n in STATISTICS})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.scores(x))], [*names, "anomaly"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(run), f"{schema}, anomaly double")


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """``stats`` with ``base_failed``, ``anomaly`` (the score, 0 to 1; null without a forest) and ``kept``."""
    kept = ~F.col("base_failed")
    rows = stats.withColumn("base_failed", base_failed())
    if forest is None:
        return rows.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", kept)
    return scored(rows, forest).withColumn("kept", kept & (F.col("anomaly") < F.lit(forest.threshold)))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            label_column: str = "quality") -> DataFrame:
    """One row per document: its statistics, ``base_failed``, ``anomaly`` and ``kept``."""
    stats = written(statistics(docs, id_column, text_column), "statistics")
    return judge(stats, fit(stats, labels, id_column, label_column))
