"""Operator 11 against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievemark.llm import lexical
from tests.llm.helpers import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if no_id else doc_id, -minus)
                for rank, (minus, no_id, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, items, k=10, clashes=False):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(documents(spark, rows, clashes), asked, k).collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    pool = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(pool, weights, k=r.choice([3, 20, 60, 400])))) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(60)]  # copies: equal scores
    items = [(i, " ".join(r.choices(pool, weights, k=r.choice([1, 8, 30])))) for i in range(40)]
    return rows, items + [(99, rows[3][1]), (99, rows[3][1]), (98, "unknown words only"), (97, None), (None, "t1 T1, t390")]


@pytest.mark.parametrize("segment,block,item_block", [(4096, 24, 256), (64, 2, 7)])
def test_ranks_and_scores(spark, monkeypatch, segment, block, item_block):
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", item_block)
    rows, items = corpus(segment, 700)
    assert found(spark, rows, items) == plain(rows, items)


def test_odd_rows(spark):
    rows = ODD + [(12, "Word wORD word-word_é"), (13, "É é ÉÉ"), (14, "0 9 : @ [ `{ \x7f 日本日本 日本")]
    items = [(1, "word é"), (2, "日本 日本 É ß"), (3, ""), (4, "a b c d e f " * 50), (5, "x" * 30_000 + " no id")]
    assert found(spark, rows, items, clashes=True) == plain(rows, items)
    assert found(spark, [], items) == [] and found(spark, rows, []) == []
    assert found(spark, [(1, ""), (2, None)], items) == []


def test_terms_in_every_document(spark):
    rows = [(i, "same " * (i % 5 + 1)) for i in range(40)]
    assert found(spark, rows, [(1, "same same"), (2, "same")]) == plain(rows, [(1, "same same"), (2, "same")])


def local(rows, asked, k=10):
    """One segment searched without Spark for items given by the counts of their terms."""
    held = [Counter(lexical.terms_of(t)) for _, t in rows]
    df = Counter(t for c in held for t in c)
    plan = lexical.Plan.of(asked, {t: df[t] for c in asked for t in c}, len(held), sum(sum(c.values()) for c in held))
    number = {t: i for i, t in enumerate(plan.vocabulary)}
    posts = [(d, number[t], tf, sum(c.values())) for d, c in enumerate(held) for t, tf in c.items() if t in number]
    row, term, tf, size = (np.array(x, np.int64) for x in zip(*posts, strict=True))
    best = lexical.Best.empty(len(asked), k)
    lexical.search_segment(plan, best, np.array([i for i, _ in rows]), np.zeros(len(rows), bool), row, term, plan.impacts(tf, size))
    return plan, best


def test_most_blocks_are_skipped_and_nothing_is_lost():
    r = random.Random(4)
    pool = [f"t{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    rows = [(i, " ".join(r.choices(pool, weights, k=100))) for i in range(3000)]
    items = [(i, " ".join(r.choices(rows[i][1].split(), k=30))) for i in range(20)]
    _, best = local(rows, [Counter(lexical.terms_of(t)) for _, t in items])
    got = [(i, rank, int(d), int(s)) for i, (scores, _, ids) in enumerate(best.rows) for rank, (s, d) in enumerate(zip(scores, ids, strict=True), 1)]
    assert sorted(got, key=str) == plain(rows, items)
    assert best.opened < best.blocks / 4 and best.scored < best.pairs / 4


def test_sums_too_large_for_doubles_stay_exact():
    rows = [(i, "big " * (i + 1) + "small") for i in range(30)] + [(i, "other") for i in range(30, 99)]
    repeats = 10**8 + 1
    plan, best = local(rows, [Counter({b"big": repeats})])
    assert plan.shares[0].dtype == np.int64
    want = [(d, s * repeats) for _, _, d, s in sorted(plain(rows, [(1, "big")]), key=lambda r: r[1])]
    assert list(zip(best.rows[0][2].tolist(), best.rows[0][0].tolist(), strict=True)) == want


def test_blocks_hold_each_posting_once():
    places = np.random.default_rng(1).normal(size=(1000, 8))
    rows = np.arange(0, 1000, 3)
    order, starts = lexical.blocks_of(rows, places, 10)
    assert sorted(order) == rows.tolist() and starts[0] == 0
    sizes = np.diff(np.append(starts, len(rows)))
    assert sizes.min() >= 1 and sizes.max() <= 20
    # Documents of a block lie closer together than documents of a list.
    spread = np.mean([places[order[a:a + n]].std(axis=0).mean() for a, n in zip(starts, sizes, strict=True) if n > 4])
    assert spread < places[rows].std(axis=0).mean()
