"""Operator 12 against plain versions."""

import random
import re

import numpy as np
import pytest

from sievemark.llm import quality_forest as forest
from tests.llm.helpers import CLASHES, ODD, documents, words

SPACE = re.compile(r"[\x20\x09-\x0D]")


def plain_statistics(text):
    text = text or ""
    tokens = [w for w in SPACE.split(text) if w]
    seen, equal = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            equal += line in seen
            seen.add(line)
    places = {}
    for i in range(len(tokens) - 4):
        places.setdefault(tuple(tokens[i:i + 5]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(5)}
    return (len(tokens), len(SPACE.sub("", text)), sum(text.count(c) for c in "#*$%&|<>"), equal, len(covered))


def texts():
    r = random.Random(5)
    for n in (0, 1, 5, 6, 9, 40, 400):
        for vocabulary in (1, 2, 3, 50):
            yield " ".join(f"{r.choice('aé🙂#')}{r.randrange(vocabulary)}" for _ in range(n))
    line = "the same line of seven words here"
    yield "\n".join([line, "other", line, "", "", " ", line + " ", "\t", "x\x0b\x0cy\r"])
    yield "a b c d e f g h a b c d e z"
    yield "\x85    a"


def test_statistics_are_exact():
    for text in texts():
        assert forest.statistics_of(text) == plain_statistics(text), text[:80]


def test_many_distinct_words_in_one_text():
    # Above 5400 distinct words a window no longer fits into one packed number.
    tokens = words(1, 9000, 100_000) + ["p", "q", "r", "s", "t", "u"] + words(2, 9000, 100_000) + ["p", "q", "r", "s", "t", "u"]
    text = " ".join(tokens)
    assert len(set(tokens)) > 6300
    assert forest.statistics_of(text) == plain_statistics(text)


def plain_path(f, x, root):
    at, steps = root, 0
    while f.child[at] != at:
        at = f.child[at] + int(x[f.feature[at]] >= f.cut[at])
        steps += 1
    return f.path[at], steps


def test_paths_follow_the_splits():
    x = np.random.default_rng(1).normal(size=(600, 3))
    x[::50] += 6
    f = forest.grow(x, trees=20)
    plain = [[plain_path(f, row, root)[0] for root in f.roots] for row in x[:80]]
    assert np.allclose(f.paths(x[:80]), plain)
    assert max(plain_path(f, row, root)[1] for row in x[:80] for root in f.roots) <= f.depth == 8
    scores = f.scores(x)
    assert scores[::50].min() > np.median(np.delete(scores, np.s_[::50]))
    assert np.array_equal(scores, forest.grow(x, trees=20).scores(x))


def test_expected_path_of_small_sets():
    def mean_depth(n):  # of a tree that splits off a uniform number of rows
        return 0 if n < 2 else sum(1 + (k * depth[k] + (n - k) * depth[n - k]) / n for k in range(1, n)) / (n - 1)
    depth = [0, 0]
    for n in range(2, 200):
        depth.append(mean_depth(n))
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert abs(forest.expected_path(199) - depth[199]) < 0.1


def test_calibration():
    low = np.array([False] * 50 + [True] * 5)
    assert 0.49 < forest.calibrated(np.r_[np.linspace(0.3, 0.49, 50), np.linspace(0.5, 0.7, 5)], low) < 0.5
    assert forest.calibrated(np.linspace(0, 1, 55), ~np.zeros(55, bool)) == float("inf")
    assert forest.calibrated(np.linspace(0, 1, 55), np.zeros(55, bool)) == float("inf")
    assert forest.calibrated(np.full(55, 0.5), low) == float("inf")
    assert forest.calibrated(np.zeros(0), np.zeros(0, bool)) == float("inf")


def corpus():
    good = [(i, " ".join(words(i, 60 + i % 90))) for i in range(400)]
    bad = [(i, " ".join(w + "###" if i % 2 else "| " + w for w in words(i, 60 + i % 50))) for i in range(400, 440)]
    return good + bad


def test_labelled_low_quality_is_found(spark):
    docs = documents(spark, corpus())
    # Half of each kind is labelled; the verdict on the others counts.
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 440) if i % 4 < 2], "doc_id long, quality int, toxic int")
    rows = forest.quality(docs, labels).collect()
    assert len(rows) == 440
    assert len([r.doc_id for r in rows if not r.kept and r.doc_id < 400]) <= 8  # of 200 that had no label
    assert [r.doc_id for r in rows if r.kept and r.doc_id >= 400] == []
    again = {r.doc_id: r.anomaly for r in forest.quality(docs.repartition(7), labels.repartition(2)).collect()}
    assert again == {r.doc_id: r.anomaly for r in rows}


@pytest.mark.parametrize("labelled", [[], [(1, None, 0), (None, 1, 0)], [(1, 1, 0), (1, 0, 1)]])
def test_odd_rows(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    rows = forest.quality(documents(spark, ODD, clashes=True), labels).collect()
    got = sorted(((r.doc_id, *(r[n] for n in forest.STATISTICS)) for r in rows), key=str)
    assert got == sorted(((i, *plain_statistics(t)) for i, t in ODD), key=str)
    assert all(r.kept == (not r.base_failed) for r in rows)  # nothing to calibrate on
    assert not set(CLASHES) - {"kept"} & set(rows[0].asDict())


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert forest.quality(documents(spark, []), labels).collect() == []


def test_every_labelled_row_counts(spark, monkeypatch):
    """All low-quality rows but one come last in the order of the hashes that once chose the rows."""
    monkeypatch.setattr(forest, "SAMPLE", 300, raising=False)  # the cap of the time before
    rows = [(i, 100, 500 + i % 40, 0, 0, 0) for i in range(2000)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} long" for n in forest.STATISTICS))
    order = [r.doc_id for r in stats.select("doc_id").orderBy(forest.F.xxhash64("doc_id")).collect()]
    low = set(order[300:340])
    stats = stats.withColumn("n_symbols", forest.F.when(forest.F.col("doc_id").isin(low), 90).otherwise(forest.F.col("n_symbols")))
    labels = spark.createDataFrame([(i, int(i not in low)) for i in range(2000)], "doc_id long, quality int")
    fitted = forest.fit(stats, labels)
    assert fitted.threshold < 1
    judged = forest.judge(stats, fitted).collect()
    assert {r.doc_id for r in judged if not r.kept} == low


def test_draws_come_from_all_rows_once_each(spark):
    same = [(i % 700, 100, i % 700, 0, 0, 0) for i in range(1400)]  # every row twice
    stats = spark.createDataFrame(same, "doc_id long, " + ", ".join(f"{n} long" for n in forest.STATISTICS))
    drawn = forest.draws(stats, 1400, trees=40, psi=50)
    again = forest.draws(stats.repartition(5), 1400, trees=40, psi=50)
    assert [len(x) for x in drawn] == [50] * 40
    assert all(np.array_equal(np.sort(a, axis=0), np.sort(b, axis=0)) for a, b in zip(drawn, again, strict=True))
    met = np.unique(np.concatenate(drawn)[:, 0], return_counts=True)
    assert len(met[0]) > 600 and met[1].max() < 15  # 2,000 draws over 700 kinds of rows
    alone = [len(np.unique(x[:, 0])) for x in drawn]
    assert 45 < np.mean(alone) < 50  # copies do not come together


@pytest.mark.parametrize("seed", range(4))
def test_cut_over_many_rows_is_the_plain_one(spark, seed):
    draw = np.random.default_rng(seed)
    low = draw.random(500) < 0.1
    scores = np.round(np.where(low, draw.normal(0.6, 0.05, 500), draw.normal(0.45, 0.05 + 0.05 * seed, 500)).clip(0, 1), 3)
    rows = spark.createDataFrame(list(zip(scores.tolist(), low.tolist(), strict=True)), "anomaly double, low boolean")
    assert forest.cut_of(rows) == forest.calibrated(scores, low)
    assert forest.cut_of(rows.where("low")) == float("inf") == forest.cut_of(rows.where("NOT low"))
