"""Operators 8 and 9 against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import top_k, url_filter

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_top(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in ok:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for i, v in ok if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, k=5):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, top_k.search(vectors, F.col("vec_id") % 10 == 0, k).collect()))


@pytest.mark.parametrize("dims,n", [(3, 400), (16, 2500), (1, 60)])
def test_search_is_exact(spark, dims, n):
    r = random.Random(dims)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25]) if dims < 4 else r.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    assert search(spark, rows) == plain_top([(i, [float(f) for f in v]) for i, v in rounded(spark, rows)], 5)


def rounded(spark, rows):
    return [(r.vec_id, r.embedding) for r in spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).collect()]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [0.5]), (8, []), (10, [0.0, 0.0]), (None, [9.0, 9.0]), (20, [1e9, -1e9]),
            (21, [3.0, 4.0, 5.0])]
    assert search(spark, rows) == plain_top(rows, 5)
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []


def test_large_components_are_summed_exactly(spark):
    rows = [(0, [2.0**20, 2.0**20]), (1, [2.0**20, 1 / 256]), (2, [2.0**20, 2 / 256])]
    assert search(spark, rows) == plain_top(rows, 5)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PAGES = "page_id long, url string, html string, host string, _link string"


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)
    return {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, RULES).collect()}


def test_parts_rules_and_longest_match(spark):
    urls = {
        1: ("http://A.Example.NET/en/x?q=/#f", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        2: ("https://b.example.net/fr", ("b.example.net", "/fr", "net/", "block")),
        3: ("https://myexample.com/de/1", ("myexample.com", "/de/1", None, "allow")),
        4: ("https://x.example.com/de/1", ("x.example.com", "/de/1", "example.com/de/", "block")),
        5: ("ftp://org/fr/#a", ("org", "/fr/", "org/fr/", "allow")),
        6: ("no url at all", ("", "", None, "allow")),
        7: (None, ("", "", None, "allow")),
        8: ("http://É.example.org?x://y", ("É.example.org", "", None, "allow")),
        9: ("http://h\nost/a\nb://c", ("h\nost", "/a\nb://c", None, "allow")),
        10: ("http://example.net:80/en/", ("example.net:80", "/en/", None, "allow")),
    }
    got = judged(spark, [(i, u, None) for i, (u, _) in urls.items()])
    assert got == {i: e for i, (_, e) in urls.items()}
    assert judged(spark, []) == {}


def test_of_equally_long_rules_the_first_counts(spark):
    pages = spark.createDataFrame([(1, "http://e.net/ab", None)], "page_id long, url string, html string")
    for rules in ([("block", "net/ab"), ("allow", "e.net/")], [("allow", "e.net/"), ("block", "net/ab")]):
        row = url_filter.judge(pages, rules).first()
        assert (row["rule"], row.verdict) == (rules[0][1], rules[0][0])


def test_repeated_and_very_long_pages(spark):
    page = "<p>word</p>" * 200_000 + "<a href='http://bad.net/'>x</a>" * 1000
    rows = [(1, "http://a.example.com/", page)] * 2 + [(2, "http://bad.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge(pages, RULES).collect()) == [
        (1, "block"), (1, "block"), (2, "block")]


def plain_ranks(links, seeds, rounds=400):
    hosts = {h for e in links for h in e} | seeds
    out = {h: sum(w for (a, _), w in links.items() if a == h) for h in hosts}
    rank = base = {h: (1 / len(seeds) if h in seeds else 0.0) for h in hosts}
    for _ in range(rounds):
        rank = {h: 0.15 * base[h] + 0.85 * sum(rank[a] * w / out[a] for (a, b), w in links.items() if b == h) for h in hosts}
    return rank


def test_trust_and_distrust_flow_along_links(spark):
    links = {("good", "mid"): 2.0, ("mid", "leaf"): 1.0, ("farm", "bad"): 3.0, ("mid", "bad"): 1.0, ("farm2", "farm"): 1.0}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "good"), ("distrust", "bad")], "kind string, host string")
    got = {(r.kind, r.host): r["rank"] for r in url_filter.propagate(frame, seeds).collect()}
    back = {(b, a): w for (a, b), w in links.items()}
    for kind, plain in (("trust", plain_ranks(links, {"good"})), ("distrust", plain_ranks(back, {"bad"}))):
        for host, rank in plain.items():
            assert got.get((kind, host), 0.0) == pytest.approx(rank, abs=1e-5)


def test_hosts_are_judged_by_the_graph(spark):
    link = "<p><A class=x HREF='{}'>t</a>"
    got = judged(spark, [
        (1, "http://bad.net/x", link.format("//bad.net/self") * 3),
        (2, "http://farm.example.com/", link.format("http://bad.net/") * 2),
        (3, "http://clean.example.com/", link.format("/relative") + link.format("https://good.org/fr/")),
        (4, "http://good.org/fr/a", link.format("http://neighbour.example.com/")),
        (5, "http://neighbour.example.com/", link.format("http://bad.net/") + link.format("http://good.org/"))])
    assert {i: v[3] for i, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@pytest.mark.parametrize("linkers", [1, 4, 300])
def test_every_linker_of_a_blocked_host_is_blocked(spark, linkers):
    link = "<a href='http://{}/'>t</a>"
    rows = [(i, f"http://farm{i}.example.com/", link.format("bad.net")) for i in range(linkers)]
    rows += [(1000, "http://bad.net/x", ""), (1001, "http://good.org/fr/a", link.format("read.example.com")),
             (1002, "http://read.example.com/", link.format("bad.net") + link.format("good.org")),
             (1003, "http://portal.example.com/", link.format("bad.net") + "".join(link.format(f"s{i}.com") for i in range(9))),
             (1004, "http://behind.example.com/", link.format("farm0.example.com")),
             (1005, "http://far.example.com/", link.format("portal.example.com"))]
    got = {i: v[3] for i, v in judged(spark, rows).items()}
    assert {got[i] for i in range(linkers)} == {"block"}
    assert [got[i] for i in range(1000, 1006)] == ["block", "allow", "allow", "allow", "block", "allow"]


def test_exposure_is_the_chance_of_coming_to_a_seed(spark):
    links = {("a", "bad"): 1.0, ("a", "b"): 3.0, ("b", "a"): 1.0, ("b", "c"): 1.0, ("bad", "a"): 1.0, ("c", "bad"): 1.0}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, weight double")
    hosts = lambda *names: spark.createDataFrame([(n,) for n in names], "host string")
    got = {r.host: r["rank"] for r in url_filter.exposure(frame, hosts("a", "b", "bad"), hosts("bad")).collect()}
    a = 0.85 * 0.25 / (1 - 0.85 * 0.75 * 0.85 * 0.5)
    assert got == {"bad": 1.0, "a": pytest.approx(a, abs=1e-5), "b": pytest.approx(0.85 * 0.5 * a, abs=1e-5)}


def local_search(vectors, queries, k=5, size=1000):
    """All vectors through blocks of ``size``, without Spark."""
    ids = np.arange(len(vectors))
    best = top_k.Best(len(queries), k)
    for at in range(0, len(vectors), size):
        lists = top_k.SortedLists(ids[at:at + size], vectors[at:at + size])
        asked = vectors[queries]
        late = lists.late(best, asked)
        assert late.all() or at  # without scores so far nothing can stop
        lists.score_all(best, np.flatnonzero(late), np.array(queries), asked)
        for q in np.flatnonzero(~late).tolist():
            lists.search(best, q, queries[q], asked[q])
    return best


def check_local(vectors, queries, best, k=5):
    for q, i in enumerate(queries):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((np.arange(len(vectors)), -scores)) if j != i][:k]
        assert best.ids[q].tolist() == order and best.scores[q].tolist() == scores[order].tolist()


def test_few_vectors_are_scored_where_components_are_skewed():
    rng = np.random.default_rng(6)
    vectors = (rng.pareto(1.5, (8000, 6)) * 20).astype(np.int64)
    queries = list(range(0, 8000, 400))
    best = local_search(vectors, queries)
    check_local(vectors, queries, best)
    assert best.scored < best.offered / 4


def test_blocks_that_cannot_beat_the_known_scores_are_left_alone():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-50, 50, (4000, 32))
    vectors[:100] *= 40  # the first block holds all that counts
    queries = list(range(0, 100, 10))
    best = local_search(vectors, queries)
    check_local(vectors, queries, best)
    assert best.scored <= 1000 * len(queries)


def test_odd_names_and_repeated_queries(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [])]
    vectors = spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows],
                                    "vec_id long, embedding array<float>, _block int, _queries string, v string, rank string")
    got = sorted(map(tuple, top_k.search(vectors, F.col("vec_id") == 0, 5).collect()))
    # The smaller of the two vectors of the query asks; both are no candidates.
    assert got == [(0, 1, 1, 256 * 256), (0, 2, 2, 0), (0, 3, 3, 0)]


@pytest.mark.parametrize("cells,candidates", [(10, 7), (1 << 20, 1 << 14)])
def test_blocks_of_queries_and_candidates(spark, monkeypatch, cells, candidates):
    monkeypatch.setattr(top_k, "QUERY_CELLS", cells)
    monkeypatch.setattr(top_k, "CANDIDATES", candidates)
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(5)]) for i in range(150)]
    assert search(spark, rows) == plain_top(rows, 5)
