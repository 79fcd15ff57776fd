"""Operators 5 and 10 against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from sievemark.llm import exact_dedup, near_dedup
from tests.llm.helpers import ODD, SCHEMA, documents, words


def digest(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_perfect_hash_is_minimal_and_rejects_strangers_by_bytes():
    keys = np.frombuffer(b"".join(digest(i) for i in range(5000)), np.uint64).reshape(-1, 4)
    hash_ = exact_dedup.PerfectHash.of(keys)
    slots = hash_.slot(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    strangers = np.frombuffer(b"".join(digest(-i - 1) for i in range(500)), np.uint64).reshape(-1, 4)
    held = np.empty_like(keys)
    held[slots] = keys
    guess = hash_.slot(strangers)
    assert not (held[guess[guess >= 0]] == strangers[guess >= 0]).all(axis=1).any()
    with pytest.raises(ValueError, match="distinct"):
        exact_dedup.PerfectHash.of(np.concatenate([keys[:1], keys[:1]]))


def plain_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_copies_agree_with_grouping(spark):
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(120)}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)] + ODD
    got = exact_dedup.find_copies(documents(spark, rows, clashes=True)).drop("in_history").collect()
    assert sorted(map(tuple, got), key=str) == plain_copies(rows)


def test_history_members_are_found_and_strangers_grouped(spark):
    old = exact_dedup.grouped(exact_dedup.digests_of(documents(spark, [(1, "a"), (2, "b"), (9, "b")])))
    new = exact_dedup.grouped(exact_dedup.digests_of(documents(spark, [(5, "b"), (10, "b"), (3, "c"), (4, "c")])))
    index = exact_dedup.build_index(old, 3)
    got = {(r.keep_id, r.group_size, r.in_history, r.repeated) for r in exact_dedup.look_up(index, new, 3).collect()}
    assert got == {(1, 1, True, False), (10, 4, True, True), (4, 2, False, False)}


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), *ODD]
    docs = documents(spark, rows, clashes=True)
    kept = exact_dedup.without_copies(docs)
    assert kept.schema.names == docs.schema.names
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert {r.doc_id for r in kept.where("text = 'a'").collect()} == {2}


def test_no_rows(spark):
    none = documents(spark, [])
    assert exact_dedup.find_copies(none).count() == exact_dedup.without_copies(none).count() == 0
    assert near_dedup.group_near_copies(none).count() == near_dedup.without_near_copies(none).count() == 0


def plain_sets(rows):
    sets = defaultdict(set)
    for i, t in rows:
        w = (t or "").lower().split() if (t or "").isascii() else (t or "").encode().lower().split()
        own = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        sets[i].add(frozenset(own))
    return sets


def plain_components(rows):
    nodes = [(i, s) for i, sets in plain_sets(rows).items() if i is not None for s in sets if s]
    best = {i: i for i, _ in rows if i is not None}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in range(len(nodes)):
        for b in range(a):
            (i, s), (j, t) = nodes[a], nodes[b]
            both = len(s & t)
            if 100 * both >= 75 * len(s | t):
                x, y = root(i), root(j)
                best[max(x, y)] = min(x, y)
    return {i: root(i) for i in best}


def edited(base, share, seed):
    r = random.Random(seed)
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in base]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree_with_all_pairs(spark, seed):
    r = random.Random(seed)
    rows, passage = [], words(99, 60)
    for i in range(60):
        rows.append((len(rows), " ".join(words(1000 * seed + i, r.randint(3, 150)))))
    base = words(7, 180)
    for i in range(120):  # one family of near copies around the threshold, and copies of copies
        copy = edited(base, r.choice([0.01, 0.02, 0.03, 0.05]), 50 + i)
        rows.append((len(rows), " ".join(copy)))
        if i % 5 == 0:
            rows.append((len(rows), " ".join(edited(copy, 0.015, 900 + i))))
    for i in range(60):  # a passage that many share, as a small and as a large part
        rows.append((len(rows), " ".join(passage + words(5000 + i, r.choice([8, 12, 20, 100])))))
    rows += [(len(rows) + i, "One two THREE four" if i % 2 else "one two three four") for i in range(4)]
    r.shuffle(rows)
    got = {x.doc_id: x for x in near_dedup.group_near_copies(documents(spark, rows, clashes=True)).collect()}
    expected = plain_components(rows)
    assert {i: x.component_id for i, x in got.items()} == expected
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())
    assert {i: x.n_shingles for i, x in got.items()} == {i: len(next(iter(s))) for i, s in plain_sets(rows).items()}


def test_near_copies_of_odd_rows(spark):
    docs = documents(spark, ODD, clashes=True)
    got = near_dedup.group_near_copies(docs).collect()
    assert len(got) == len(ODD)
    assert {(x.doc_id, x.component_id) for x in got} == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (None, None), (6, 6), (7, 7), (8, 8)}
    assert {x.doc_id for x in got if x.n_shingles == 0} == {1, 2, 3, None}
    left = near_dedup.without_near_copies(docs)
    assert left.schema.names == docs.schema.names
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(["1", "2", "3", "4", "None", "None", "6", "7", "8"])


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.x: r.c for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_estimate_is_exact_for_sets_within_the_sketch(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [2, 3, 4, 5])], "a array<bigint>, b array<bigint>")
    assert row.select(near_dedup.estimate(row.a, row.b)).first()[0] == pytest.approx(0.6)


def test_schema_of_the_fixture(spark):
    assert documents(spark, []).schema == spark.createDataFrame([], SCHEMA).schema


def test_a_star_of_excerpts_is_not_compared_all_with_all(spark):
    """Two thousand excerpts of one long set, none linked with it: partners are found, pairs are not listed."""
    rng = np.random.default_rng(3)
    text = np.sort(rng.choice(1 << 40, 30_000, replace=False))
    order = rng.permutation(30_000)  # words of neighbours have no neighbouring hashes
    sets = {0: text}
    for i in range(1, 2001):
        at, size = int(rng.integers(0, 29_800)), int(rng.integers(80, 120))
        own = rng.choice(1 << 41, int(rng.integers(0, 6))) + (1 << 40)
        sets[i] = np.unique(np.concatenate([text[order[at:at + size]], own]))
    inside = {i: np.intersect1d(s, text) for i, s in sets.items()}
    stars = spark.createDataFrame(
        [(i, 0, len(s), len(text), len(inside[i]), np.setdiff1d(s, text).tolist()) for i, s in sets.items() if i],
        "x long, p long, nx int, np int, i int, beyond array<bigint>")
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "x long, set array<bigint>")
    found = near_dedup.other_pairs(stars, spark.createDataFrame([], "x long, c long"), frame)
    pairs = {(r.x, r.p) for r in found.collect()}
    small = {i: set(s.tolist()) for i, s in sets.items() if i}
    holders = {}
    for i, s in small.items():
        for v in s:
            holders.setdefault(v, []).append(i)
    near = {(a, b) for members in holders.values() for a in members for b in members if a < b}
    links = {(a, b) for a, b in near if 100 * len(small[a] & small[b]) >= 75 * len(small[a] | small[b])}
    assert links <= pairs and len(links) > 1000
    assert len(pairs) < 20 * len(links) and len(pairs) < 2000 * 2000 / 50


def test_two_texts_under_one_id(spark):
    base = words(1, 60)
    rows = [(1, " ".join(base)), (1, " ".join(words(2, 60))), (2, " ".join(base[:58] + ["other"])), (3, " ".join(words(2, 60)))]
    got = sorted(map(tuple, near_dedup.group_near_copies(documents(spark, rows)).select("doc_id", "component_id").collect()))
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]
