"""Operator 13 against a brute-force version."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import spelling
from tests.llm.helpers import ODD, documents

LETTER = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def edits_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTER.findall(text or ""):
            run = lower(run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % 97 == 0:
                run = run[:check % len(run)] + run[check % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if edits_one(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def noisy(seed, n_docs, alphabet="abcdeéß", size=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randrange(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n_docs):
        tokens = []
        for _ in range(size):
            w = vocabulary[min(int(r.paretovariate(0.7)) - 1, 39)]
            if r.random() < 0.3:
                at, c = r.randrange(len(w) + 1), r.choice(alphabet)
                w = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]])
            tokens.append(w.title() if r.random() < 0.2 else w)
        rows.append((i, " ".join(tokens)))
    return rows


@pytest.mark.parametrize("limit", [4096, 8])
def test_all_pairs_and_chains(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "BRANCH", limit)
    monkeypatch.setattr(spelling, "ROWS", 500)  # several blocks of branches a task
    rows = noisy(3, 12)
    assert got(spelling.variants(documents(spark, rows))) == plain(rows)


def test_slips_happen(spark):
    rows = [(i, "Thousand thousand! " + f"x{i}") for i in range(500)]
    want = plain(rows)
    assert len(want) == 3 and all(w == "thousand" or form == "thousand" for w, (form, *_) in want.items())
    assert got(spelling.variants(documents(spark, rows))) == want


def test_long_chain_has_one_root(spark):
    chain = ["aaaaaaa", "baaaaaa", "bbaaaaa", "bbbaaaa", "bbbbaaa"]
    rows = [(i, " ".join(f"{w} " * (3 * 2**i) for i, w in enumerate(chain)))for i in (1,)]
    out = got(spelling.variants(documents(spark, rows)))
    assert out == plain(rows) and {root for _, root, *_ in out.values()} == {"bbbbaaa"}


def test_ties_take_the_smallest(spark):
    rows = [(1, "wordx " * 4 + "wordz " * 4 + "wordé " * 4 + "wordy " * 2 + "worda " + "wordy ")]
    out = got(spelling.variants(documents(spark, rows)))
    assert out == plain(rows)


def test_odd_rows(spark):
    rows = ODD + [(9, "é" * 300 + " " + "é" * 299 + "x "), (9, ("é" * 300 + " ") * 3 + ("É" * 300 + " ") * 3),
                  (10, ("z" * 260 + " ") * 9 + ("z" * 259 + " ") * 3 + ("z" * 261 + " ") * 3), (11, "ab×cd " * 6 + "ab÷cd " * 3)]
    assert got(spelling.variants(documents(spark, rows, clashes=True))) == plain(rows)
    assert got(spelling.variants(documents(spark, []))) == {}


def every_pair(words, depth):
    """All near pairs through the branches, by hand."""
    encoded = [w.encode("latin-1") for w in words]
    rows = {"branch": [], "word": [], "n": [], "spent": []}
    for word, vector in zip(words, spelling.vectors(encoded), strict=True):
        home = vector[:depth].astype(int)
        moves = [(0, home)]
        for i in range(depth):
            up = home.copy()
            up[i] += 1
            moves.append((1, up))
            for j in range(i + 1, depth):
                if home[j]:
                    down = up.copy()
                    down[j] -= 1
                    moves.append((2, down))
        for spent, branch in moves:
            rows["branch"].append(bytes(branch.tolist()))
            rows["word"].append(word)
            rows["n"].append(1)
            rows["spent"].append(spent)
    table = pa.table({"branch": pa.array(rows["branch"], pa.binary()), "word": rows["word"], "n": rows["n"],
                      "spent": pa.array(rows["spent"], pa.int32())})
    found = [pair for batch in spelling.pairs_in_branches(table, depth)
             for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("depth", [4, spelling.GROUPS])
def test_leaves_and_blocks(monkeypatch, depth):
    r = random.Random(depth)
    words = sorted({"".join(r.choice("abéè") for _ in range(r.randrange(5, 8))) for _ in range(700)})
    want = {(a, b) for a in words for b in words if edits_one(a, b)}
    assert len(want) > 500 and every_pair(words, depth) == want
    monkeypatch.setattr(spelling, "LARGE_LEAVES", 1)
    monkeypatch.setattr(spelling, "STATES", 50)
    monkeypatch.setattr(spelling, "PAIRS", 7)
    assert every_pair(words, depth) == want


def test_a_large_leaf_is_not_met_all_with_all():
    # One multiset of letters, very many orders: halves are met, not pairs.
    r = random.Random(8)
    base = list("aabbccddeeffgg")
    words = set()
    while len(words) < 3000:
        r.shuffle(base)
        words.add("".join(base).encode())
    words = sorted(words)
    a, _ = spelling._halves_met(words, np.arange(3000), np.arange(3000))
    assert len(a) < 3000 * 3000 / 100


def test_verification():
    r = random.Random(2)
    pool = [bytes(r.choice(b"ab") for _ in range(r.choice([5, 6, 47, 48, 49, 50, 60]))) for _ in range(60)]
    for w in list(pool):
        at = r.randrange(len(w))
        pool += [w[:at] + b"c" + w[at:], w[:at] + w[at + 1:], w[:at] + b"d" + w[at + 1:], w[:at] + b"e" + w[at + 2:]]
    table = spelling.Words(pool)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(pool)), np.arange(len(pool))))
    want = [edits_one(pool[i].decode(), pool[j].decode()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.array_equal(table.near(a, b), want)
    assert [spelling.near(pool[i], pool[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)] == want
