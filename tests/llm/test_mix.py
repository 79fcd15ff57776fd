"""Operator 6 against a plain water-filling, and its schedule's properties."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.llm import source_mix
from tests.llm.helpers import ODD, documents, words

NATIVE = ("Python", "Pandas", "Arrow")


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in capped else weight[s] * left / share for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def rows_of(sizes, seed=1):
    r, rows = random.Random(seed), []
    for source, size in sizes.items():
        while size > 0:
            n = min(size, r.randint(1, 60))
            rows.append((len(rows), " ".join(words(len(rows), n)), source))
            size -= n
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 3000, "b": 3000, "c": 3000}, {"a": 100, "b": 9000, "c": 50, None: 2000, "Z": 700}, {"only": 500},
    {"a": 1, "b": 20_000}])
def test_targets_and_taken_words(spark, sizes):
    rows = rows_of(sizes)
    got = source_mix.mix(documents(spark, rows, clashes=True)).collect()
    source = {i: s for i, _, s in rows}
    targets, taken = plain_targets(sizes, (5, 2, 1), 3), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(3, 0.01 * targets[s])
    again = source_mix.mix(documents(spark, rows, parts=5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("total", [5_000_000, 5_000_000_000])
def test_small_sources_reach_their_targets_in_a_large_mix(spark, monkeypatch, total):
    small = {"a": 1, "b": 500, "c": 2000, "d": 2500, "e": 10_000, "f": 30_000}
    sizes = small | {"y": total // 2, "z": total // 2 - sum(small.values())}
    # The text of a row says how many words it stands for.
    monkeypatch.setattr(source_mix, "number_of_words", lambda text: text.cast("long"))
    rows, r = [], random.Random(3)
    for source, size in sizes.items():
        while size > 0:
            n = min(size, r.randint(1, 60) if source in small else total // 50)
            rows.append((len(rows), str(n), source))
            size -= n
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    for row in source_mix.mix(documents(spark, rows)).collect():
        taken[source[row.doc_id]] += row.taken
    for s, target in plain_targets(sizes, (5, 2, 1), 3).items():
        assert abs(taken[s] - target) <= max(1, 0.005 * target), s


@pytest.mark.parametrize("total", [430_000_000, 1_650_000_000, 2_147_483_647, 2_147_483_648])
def test_totals_that_fit_a_short_number_but_not_times_a_weight(spark, monkeypatch, total):
    sizes = {"a": total // 2, "b": total // 4, None: total // 100}
    sizes["z"] = total - sum(sizes.values())
    monkeypatch.setattr(source_mix, "number_of_words", lambda text: text.cast("long"))
    docs = documents(spark, [(i, str(size), source) for i, (source, size) in enumerate(sizes.items())])
    targets = plain_targets(sizes, (5, 2, 1), 3)
    for row, source in zip(sorted(source_mix.mix(docs).collect()), sizes, strict=True):
        assert row.target == pytest.approx(targets[source]) and abs(row.taken - targets[source]) <= 0.005 * targets[source], source


def test_schedule_spreads_every_source(spark):
    sources = spark.createDataFrame([(0, 1000, 500.0), (1, 1000, 300.0), (2, 100, 200.0)],
                                    "s long, source_size long, target double")
    slots = source_mix.schedule(sources, 1000, 3)
    quarter = F.floor(F.col("slot") / (source_mix.SLOTS // 4)).alias("q")
    share = {(r.s, r.q): r["count"] / (source_mix.SLOTS // 4) for r in slots.groupBy("s", quarter).count().collect()}
    for s, part in ((0, 0.5), (1, 0.3), (2, 0.2)):
        assert all(share[s, q] == pytest.approx(part, abs=0.001) for q in range(4))
    assert slots.groupBy("slot").count().where("count > 1").count() == 0


def test_odd_rows(spark):
    got = source_mix.mix(documents(spark, [(*r, None) for r in ODD], clashes=True)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert {r.taken for r in got if r.size == 0} == {0}
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.001)


def test_tables_without_words(spark):
    assert source_mix.mix(documents(spark, [])).count() == 0
    got = source_mix.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert source_mix.mixed_documents(documents(spark, [(1, None)])).count() == 0


def test_documents_come_as_often_as_taken(spark):
    sizes = {"a": 400, "b": 4000, "c": 1500}
    docs = documents(spark, rows_of(sizes), clashes=True)
    mixed = source_mix.mixed_documents(docs)
    assert mixed.schema.names == docs.schema.names
    n = {r.source: r.n for r in mixed.groupBy("source").agg(
        F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    for s, target in plain_targets(sizes, (5, 2, 1), 3).items():
        assert abs(n[s] - target) <= 0.05 * target + 60
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0


def test_no_python_in_the_plan(spark):
    plan = source_mix.mix(documents(spark, rows_of({"a": 50, "b": 50})))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in NATIVE)


@pytest.mark.parametrize("sizes", [{"a": 3000, "b": 3000, "c": 3000}, {"a": 100, "b": 9000, "c": 50, None: 2000, "Z": 700}])
def test_any_stretch_of_the_mixture_holds_each_source_in_proportion(spark, sizes):
    rows = rows_of(sizes)
    docs = documents(spark, rows)
    mixture = source_mix.mixture(docs).collect()
    slots = [r.slot for r in mixture]
    assert slots == sorted(slots)  # collected in order of partitions: files follow the schedule
    assert len({r.slot for r in mixture}) > 500
    targets = plain_targets(sizes, (5, 2, 1), 3)
    # A block is about a word here, or less: the total over the places, or a thousandth of the source.
    block = {s: max(sum(sizes.values()) / source_mix.SLOTS, sizes[s] / source_mix.FINE, 1) for s in sizes}
    held, at = defaultdict(int), 0
    for part in range(1, 21):
        edge = source_mix.SLOTS * part / 20
        while at < len(mixture) and mixture[at].slot < edge:
            held[mixture[at].source] += mixture[at].words
            at += 1
        for s in sizes:
            assert abs(held[s] - targets[s] * part / 20) <= 2 * block[s] + 0.002 * targets[s], (s, part)
    # What mix() says is the sum of the mixture, and no word is taken twice in a pass.
    taken = defaultdict(int)
    for r in mixture:
        taken[r.doc_id] += r.words
    size = {r.doc_id: r.size for r in source_mix.mix(docs).collect()}
    assert {r.doc_id: r.taken for r in source_mix.mix(docs).collect() if r.taken} == dict(taken)
    seen = defaultdict(set)
    for r in mixture:
        words_taken = set(range(r.first_word, r.first_word + r.words))
        assert not words_taken & seen[r.doc_id, r["pass"]] and max(words_taken) < size[r.doc_id]
        seen[r.doc_id, r["pass"]] |= words_taken


def test_mixed_documents_stand_in_the_order_of_the_mixture(spark):
    rows = rows_of({"a": 6000, "b": 6000, "c": 6000})
    docs = documents(spark, rows)
    first = {}
    for r in source_mix.mixture(docs).collect():
        first.setdefault((r.doc_id, r["pass"]), r.slot)
    found = [r.doc_id for r in source_mix.mixed_documents(docs).collect()]
    copies = defaultdict(int)
    places = []
    for i in found:
        known = sorted(slot for (d, _), slot in first.items() if d == i)
        places.append(known[min(copies[i], len(known) - 1)])
        copies[i] += 1
    assert places == sorted(places) and len(places) > 300
