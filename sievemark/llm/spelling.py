"""Operator 13: spelling variants grouped through a frequency-vector trie.

1. Words. Every whole text gives its runs of letters (A-Z lower-cased), counted inside the task and summed in
   Spark. Where 97 divides the checksum of ``<doc_id>:<run>``, the run loses one code point (a planted slip).
   Distinct results of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences on are the words.
2. Vectors. A word's frequency vector says how often each letter group occurs in it: the letters a to z are groups
   of their own, frequent ones first, all others are dealt to ``OTHERS`` groups. One inserted or deleted code point
   changes one count by one, one replaced code point raises one count and lowers another, or none in its group.
3. Trie. Words are arranged by successive counts. The first levels cut the trie into branches, deep enough that
   none holds more than ``BRANCH`` words (or down to the whole vector). A word lives in one branch and visits those its
   vector can reach with one surplus and a later deficit; looking for a surplus first finds each pair from
   one side only. Spark deals the branches to tasks.
4. Search. Inside a task the visitors go down the branches depth first, a block of them at a time: equal counts
   are free, a surplus and then a deficit of one spend the budget. What arrives at a leaf is verified: exactly
   one code point inserted, deleted or replaced. Large pairs of leaves are met by equal halves first, as one edit leaves one
   half of a word alone, so no leaf is compared all with all.
5. A word's form is its near word of largest count (ties: smallest) if that is twice its own or more. Roots follow
   forms by pointer doubling; counts double at each step, so there are few rounds.

Defined results: null and empty texts have no words. A row without an id has the empty text as its id. Repeated
rows count each. Counts over 255 in a vector are taken as 255, which only lets more words arrive at
the verification. Words of any length are kept. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import LOWER, shuffle_partitions, text_of, tidy, written

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many has a planted slip.
SLIP = 97
#: The form's count is at least this many times the word's.
OVER = 2
#: Fixed order of the levels: letters of their own group, then the groups of all other code points.
LETTERS = "entaiorhsulcdgbmfpwyvkxqzj"
OTHERS = 8
GROUPS = len(LETTERS) + OTHERS
#: Words in a branch before the trie is cut one step deeper.
BRANCH = 4096
FIRST_CUT, CUT_STEP = 4, 2
#: Words counted, rows searched, states expanded and pairs verified at a time.
COUNTED, ROWS, STATES, PAIRS = 400_000, 150_000, 1 << 19, 1 << 18
#: Pairs of leaves with more word pairs than this meet by equal halves.
LARGE_LEAVES = 1 << 14
#: Words up to this length are verified as rows of a matrix.
WIDE = 48
#: A word with a whole letter is at least so long; shorter runs cannot become words.
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)

GROUP_OF = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % OTHERS for c in range(256)])


def runs_of(key: bytes, text: str) -> Iterator[tuple[str, int]]:
    """The runs of a text after slips, with their counts; ``key`` is the id as text with a colon."""
    start = zlib.crc32(key)
    lowered = text.encode("utf-8", "replace").translate(LOWER).decode("utf-8")
    for run, n in Counter(RUN.findall(lowered)).items():
        check = zlib.crc32(run.encode("utf-8"), start)
        if check % SLIP == 0:
            at = check % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n`` of all words with enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
                                               names=["word", "n"])
            totals.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, n in runs_of(key.encode("utf-8"), text):
                        totals[word] += n
                if len(totals) > COUNTED:
                    yield out()
        yield out()

    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(key.alias("_key"), text_of(text_column).alias("_text"))
    counted = rows.mapInArrow(tidy(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of the letter groups, one row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    cells = np.repeat(np.arange(len(words)) * GROUPS, sizes) + GROUP_OF[letters]
    counts = np.bincount(cells, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.minimum(counts, 255).astype(np.uint8)


def _encoded(column: pa.Array) -> list[bytes]:
    return [word.encode("latin-1") for word in column.to_pylist()]


def _as_binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(rows)], pa.binary())


def with_vectors(words: DataFrame) -> DataFrame:
    """``word, n`` with ``vector`` (one byte a level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, _as_binary(vectors(_encoded(batch.column(0))))], ["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(tidy(run), "word string, n long, vector binary")


def branch_depth(words: DataFrame, limit: int = BRANCH) -> int:
    """Levels that name a branch: the fewest steps at which no branch is too large."""
    for depth in range(FIRST_CUT, GROUPS, CUT_STEP):
        largest = words.groupBy(F.substring("vector", 1, depth).alias("b")).count().agg(F.max("count")).first()[0]
        if not largest or largest <= limit:
            return depth
    return GROUPS


def visits(words: DataFrame, depth: int) -> DataFrame:
    """``branch, word, n, spent``: each word at home (0) and where it may find others: after a surplus
    (1), or after a surplus and a deficit (2)."""
    # A visited branch differs from the home branch by +1 at one level and perhaps -1 at a later one.
    steps = [(None, None)] + [(i, None) for i in range(depth)] + [(i, j) for i in range(depth) for j in range(i + 1, depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, GROUPS)[:, :depth]
            for up, down in steps:
                able = np.ones(len(home), bool)
                if up is not None:
                    able &= home[:, up] < 255
                if down is not None:
                    able &= home[:, down] > 0
                chosen = np.flatnonzero(able)
                branch = home[chosen].copy()
                if up is not None:
                    branch[:, up] += 1
                if down is not None:
                    branch[:, down] -= 1
                at, spent = pa.array(chosen), (up is not None) + (down is not None)
                yield pa.RecordBatch.from_arrays(
                    [_as_binary(branch), batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(np.full(len(chosen), spent, np.int32))], ["branch", "word", "n", "spent"])

    return words.select("word", "n", "vector").mapInArrow(tidy(run), "branch binary, word string, n long, spent int")


class Trie:
    """Distinct vectors by successive counts; a node of a level is the rank of its prefix."""

    def __init__(self, leaves: np.ndarray):
        """``leaves``: distinct vectors in ascending order."""
        self.children = []
        parent = np.zeros(len(leaves), np.int64)
        for level in range(leaves.shape[1]):
            edges = parent * 256 + leaves[:, level]
            new = np.append(True, edges[1:] != edges[:-1])
            self.children.append(edges[new])
            parent = np.cumsum(new) - 1

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child with that count, and these children."""
        edges, wanted = self.children[level], node * 256 + count
        at = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
        found = np.flatnonzero(edges[at] == wanted)
        return found, at[found]

    def search(self, visitors: np.ndarray, node: np.ndarray, spent: np.ndarray, level: int
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth first, in blocks: ``visitor, leaf, spent`` of what arrives at the leaves."""
        todo = [(level, np.arange(len(visitors)), node, spent)]
        while todo:
            level, who, node, spent = todo.pop()
            if level == len(self.children):
                yield who, node, spent
                continue
            if len(who) > STATES:
                half = len(who) // 2
                todo += [(level, who[half:], node[half:], spent[half:]), (level, who[:half], node[:half], spent[:half])]
                continue
            count = visitors[who, level].astype(np.int64)
            found = []
            for able, change in ((None, 0), ((spent == 0) & (count < 255), 1), ((spent == 1) & (count > 0), -1)):
                rows = np.arange(len(who)) if able is None else np.flatnonzero(able)
                hit, to = self.child(level, node[rows], count[rows] + change)
                found.append((who[rows[hit]], to, spent[rows[hit]] + abs(change)))
            parts = [np.concatenate(p) for p in zip(*found, strict=True)]
            if len(parts[0]):
                todo.append((level + 1, *parts))


def near(a: bytes, b: bytes) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    same = len(os.path.commonprefix([a, b]))
    if len(a) == len(b):
        return same < len(a) and a[same + 1:] == b[same + 1:]
    return len(b) - len(a) == 1 and a[same:] == b[same + 1:]


class Words:
    """Words as rows of a matrix, for the verification of many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(WIDE, self.sizes.max(initial=1))) + 1
        self.matrix = np.array([w[:width] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows are near."""
        gap = self.sizes[b] - self.sizes[a]
        a, b = np.where(gap < 0, b, a), np.where(gap < 0, a, b)
        gap = np.abs(gap)
        x, y = self.matrix[a], self.matrix[b]
        differ = x != y
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        # After the first difference the longer word has to go on one place later than the shorter.
        shifted = x[:, :-1] != y[:, 1:]
        last = np.where(shifted.any(axis=1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        ok = np.where(gap == 0, differ.sum(axis=1) == 1, (gap == 1) & (last < first))
        for at in np.flatnonzero((self.sizes[b] > WIDE) & (gap < 2)):
            ok[at] = near(self.words[a[at]], self.words[b[at]])
        return ok


def _halves_met(words: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share the half that one edit leaves alone: a superset of the near pairs."""
    kept = defaultdict(list)
    for i in left.tolist():
        word = words[i]
        half = len(word) // 2
        kept[len(word), 0, word[:half]].append(i)
        kept[len(word), 1, word[half:]].append(i)
    met = set()
    for j in right.tolist():
        word = words[j]
        for size in (len(word) - 1, len(word), len(word) + 1):
            half = size // 2
            for key in ((size, 0, word[:half]), (size, 1, word[len(word) - (size - half):])):
                met.update((i, j) for i in kept.get(key, ()))
    pairs = np.array(sorted(met), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` in order, the members of each one after another, and where each starts."""
    packed = np.ascontiguousarray(keys).view([("", np.void, keys.shape[1])]).ravel()
    order = np.argsort(packed, kind="stable") if len(packed) else np.zeros(0, np.int64)
    ranked = keys[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))[:len(order)]
    starts = np.append(np.flatnonzero(new), len(order))
    return ranked[new], order, starts


def candidate_pairs(words: list[bytes], visitor, home, arrived) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to verify, in blocks, for what arrived at leaves."""
    _, from_rows, from_starts = visitor
    _, home_rows, home_starts = home
    for who, leaf, spent in arrived:
        m, k = np.diff(from_starts)[who], np.diff(home_starts)[leaf]
        large = m * k > LARGE_LEAVES
        for at in np.flatnonzero(large):
            left = from_rows[from_starts[who[at]]:from_starts[who[at] + 1]]
            right = home_rows[home_starts[leaf[at]]:home_starts[leaf[at] + 1]]
            a, b = _halves_met(words, left, right)
            fine = (a < b) if spent[at] == 0 else np.ones(len(a), bool)
            for i in range(0, len(a), PAIRS):
                yield a[i:i + PAIRS][fine[i:i + PAIRS]], b[i:i + PAIRS][fine[i:i + PAIRS]]
        who, leaf, spent, m, k = (x[~large] for x in (who, leaf, spent, m, k))
        ends = np.cumsum(m * k)
        cuts = np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS), side="right")
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ends)), strict=True):
            sizes = (m * k)[lo:hi]
            if not sizes.sum():
                continue
            of = np.repeat(np.arange(lo, hi), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            a = from_rows[from_starts[who[of]] + place // k[of]]
            b = home_rows[home_starts[leaf[of]] + place % k[of]]
            fine = (spent[of] != 0) | (a < b)  # words of one leaf meet once
            yield a[fine], b[fine]


def pairs_in_branches(rows: pa.RecordBatch | pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """``word, near, near_n`` in both directions, for rows that hold whole branches."""
    rows = rows.combine_chunks()
    spent = rows["spent"].to_numpy()
    is_home = spent == 0
    if not is_home.any():
        return
    words = _encoded(rows["word"])
    own = vectors(words)
    branch = np.frombuffer(b"".join(rows["branch"].to_pylist()), np.uint8).reshape(len(words), depth)
    home_at = np.flatnonzero(is_home)
    leaves, order, starts = _groups(own[home_at])
    home = (leaves, home_at[order], starts)
    trie = Trie(leaves)
    # Visitors with the same vector in the same branch go down together.
    visitor = _groups(np.hstack([branch, own]))
    target, vector = visitor[0][:, :depth], visitor[0][:, depth:]
    spent = spent[visitor[1][visitor[2][:-1]]]
    there, node = np.arange(len(target)), np.zeros(len(target), np.int64)
    for level in range(depth):
        hit, node = trie.child(level, node, target[there, level].astype(np.int64))
        there = there[hit]
    kept = (None, visitor[1], visitor[2])
    table = Words(words)
    arrived = ((there[who], leaf, s) for who, leaf, s in trie.search(vector[there], node, spent[there].astype(np.int64), depth))
    for a, b in candidate_pairs(words, kept, home, arrived):
        ok = table.near(a, b)
        a, b = a[ok], b[ok]
        if len(a):
            first, second = pa.array(np.append(a, b)), pa.array(np.append(b, a))
            yield pa.RecordBatch.from_arrays(
                [rows["word"].combine_chunks().take(first), rows["word"].combine_chunks().take(second),
                 rows["n"].combine_chunks().take(second)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, limit: int = BRANCH) -> DataFrame:
    """``word, near, near_n``: every near pair of ``word, n``, in both directions."""
    rows = written(with_vectors(words), "vectors")
    depth = branch_depth(rows, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > ROWS:
                table = pa.concat_tables(held).combine_chunks()
                # The last branch may go on in the next batch.
                ends = table["branch"].to_pylist()
                cut = len(ends)
                while cut and ends[cut - 1] == ends[-1]:
                    cut -= 1
                if cut:
                    yield from pairs_in_branches(table.slice(0, cut), depth)
                held = [table.slice(cut)]
                size = len(ends) - cut
        if size:
            yield from pairs_in_branches(pa.concat_tables(held), depth)

    dealt = visits(rows, depth).repartition(shuffle_partitions(words.sparkSession), "branch").sortWithinPartitions("branch")
    return dealt.mapInArrow(tidy(run), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` (and more) with ``root``: the end of the chain of forms."""
    now = written(forms.withColumn("root", F.col("form")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        now = written(now.drop("_on").join(onward, "root", "left").withColumn("root", F.coalesce("_on", "root")), "roots")
        if not now.where("_on IS NOT NULL").limit(1).count():
            return now.drop("_on")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    words = written(word_counts(docs, id_column, text_column), "words")
    best = (near_words(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")))
    best = best.select("word", "n_near", (-F.col("_best.less")).alias("_n"), F.col("_best.near").alias("_near"))
    found = written(words.join(best, "word", "left"), "near")
    formed = found.where(F.col("_n") >= OVER * F.col("n")).select("word", F.col("_near").alias("form"), F.col("_n").alias("form_n"))
    return (found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).join(roots(formed), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
