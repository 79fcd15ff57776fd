"""Operators 1 and 4: exactness of their parts, and held-out quality on the given tables."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import language_model, toxicity
from sievemark.llm.frames import crc_of, table
from sievemark.llm.queries import op1_toxicity, op4_language_model
from tests.llm.helpers import ODD, documents, words

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def toy(spark, n=400):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = words(i, 40, 60) + ([r.choice(["vileword", "nastything"])] * 2 if bad else [])
        rows.append((i, " ".join(text)))
        labels.append((i, None if i == 7 else 0, 1 if bad else 0))
    return documents(spark, rows, clashes=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_texts_score_higher_and_evidence_is_labelled(spark):
    docs, labels = toy(spark)
    model = toxicity.fit(docs, labels, crc_of("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r.predicted} == {i for i in got if i % 5 == 0}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {e.toxic for e in got[0].evidence} == {1} and {e.toxic for e in got[1].evidence} == {0}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held & {e.example_id for r in got.values() for e in r.evidence}
    left = toxicity.without_toxic(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {i for i in got if i % 5}


def toxicity_rows(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()]
    toxic = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    return docs, toxic


def plain_terms(text):
    """Terms of a text by their definition, one word at a time."""
    tokens = text.encode().translate(toxicity.PLAIN).split()
    found = Counter(tokens)
    for length in (4, 6):
        for stem in {t[:length] for t in tokens if len(t) > length}:
            n = sum(t.startswith(stem) and len(t) > length for t in tokens)
            found[stem + b"*"] = n
            for mark, least in ((b"*1", 0.002), (b"*2", 0.008), (b"*3", 0.03)):
                if n / len(tokens) >= least:
                    found[stem + mark] = n
    return found, len(tokens)


def test_model_and_scores_against_brute_force(spark):
    """Examples, weights, cosines over all terms, votes: all done again in plain loops."""
    docs, toxic = toxicity_rows(spark, "/root/testdata/sf0.001")
    model = toxicity.fit(table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels"),
                         crc_of("doc_id") % 4 != 2)
    order = {r.doc_id: r.o for r in table(spark, "/root/testdata/sf0.001", "documents").selectExpr(
        "doc_id", "xxhash64(doc_id, 1) AS o").collect()}
    learn = {}
    for i, text in docs:
        if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2:
            best, label = learn.get(text, ((order[i], i), 0))
            learn[text] = min(best, (order[i], i)), max(label, toxic[i])
    examples = {i: (plain_terms(text), label) for text, ((o, i), label) in learn.items() if o % 5}
    a, b = Counter(), Counter()
    for (terms, _), label in examples.values():
        (a if label else b).update(terms.keys())
    share = sum(label for _, label in examples.values()) / len(examples)
    held = Counter(t for _, text in docs for t in plain_terms(text)[0])
    weight = {t: (math.log((1 + len(docs)) / (1 + held[t])) + 1) * max(1, (a[t] + 2) / ((a[t] + b[t]) * share + 2)) ** 3
              for t in set(a) | set(b)}
    assert set(model.terms) == set(weight) and set(model.example_ids.tolist()) == set(examples)

    def unit(terms, size):
        v = {t: math.log1p(1000 * n / size) * weight[t] for t, n in terms.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(*terms) for i, (terms, _) in examples.items()}
    scored = {r.doc_id: r for r in toxicity.score(table(spark, "/root/testdata/sf0.001", "documents"), model).collect()}
    for i, text in docs[:120]:
        q = unit(*plain_terms(text))
        cosines = {e: sum(x * v.get(t, 0) for t, x in q.items()) for e, v in vectors.items()}
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[:16]
        assert np.allclose([e.cosine for e in scored[i].evidence], np.minimum(best, 1), atol=1e-9)
        assert all(abs(cosines[e.example_id] - e.cosine) < 1e-9 and examples[e.example_id][1] == e.toxic
                   for e in scored[i].evidence)
        votes = [(c / (1 - min(c, 1) + 0.05), t) for c, t in ((e.cosine, e.toxic) for e in scored[i].evidence)]
        vote = (sum(w * t for w, t in votes) + 0.2 * share) / (sum(w for w, _ in votes) + 0.2) if votes else None
        want = model.alone if vote is None else np.interp(vote, model.votes, model.chances)
        assert scored[i].score == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def vocabulary():
    """A model of 20 000 terms of made-up texts, without examples, and the texts."""
    r = random.Random(8)
    names = ["".join(r.choice("abcdeé") for _ in range(r.randrange(3, 11))) for _ in range(20_000)]
    texts = [" ".join(r.choice(names) for _ in range(300)) for _ in range(1000)]
    terms = sorted(set().union(*(toxicity.terms_in(t)[0] for t in texts[:100])))
    weights = np.array([1 + r.random() for _ in terms])
    return toxicity.ToxicityModel.of({t: i for i, t in enumerate(terms)}, weights, [], [], []), texts


def test_texts_taken_apart_together_keep_their_own_terms(vocabulary):
    model, texts = vocabulary
    texts = ["", None, " ", *texts[:40], "abc", "abc", "x\x00,y",
             "\u65e5\u672c abcde", "", "ABCDEab abcdeab, " * 700, texts[0].replace(" ", "\n\n"), None]
    column = pa.array(["abcde ab", *texts], pa.string())[1:]  # a slice, as batches are cut
    for most in (1, 3000, toxicity.PIECE):
        cut = list(toxicity.pieces(column, most))
        assert [i for c in cut for i in range(c.start, c.stop)] == list(range(len(texts)))
        got = [v for c in cut for v in model.vectors(column[c])]
        for text, (terms, weights) in zip(texts, got, strict=True):
            counts, size = plain_terms(text or "")
            held = [(model.terms[t], n) for t, n in counts.items() if t in model.terms]
            want = {t: math.log1p(1000 * n / size) * model.weights[t] for t, n in held}
            norm = math.sqrt(sum(w * w for w in want.values()))
            assert terms.tolist() == sorted(want) and np.allclose(weights, [want[t] / norm for t in sorted(want)], rtol=1e-12)


def test_taking_texts_apart_costs_less_than_counting_their_terms(vocabulary):
    """Against a plain loop on the same machine: a look-up per word of each text costs more than the loop."""
    model, texts = vocabulary
    column, took = pa.array(texts, pa.string()), {"loop": [], "batch": []}
    model.vectors(column[:10])  # the tables are made
    for _ in range(3):
        for kind, work in (("loop", lambda: [toxicity.terms_in(t) for t in texts]), ("batch", lambda: model.vectors(column))):
            start = time.process_time()
            work()
            took[kind].append(time.process_time() - start)
    assert min(took["batch"]) < 0.6 * min(took["loop"])


def model_of(dense, toxic=None, order=None):
    vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
    terms = dense.shape[1]
    return toxicity.ToxicityModel.of({str(i).encode(): i for i in range(terms)}, np.ones(terms), list(range(len(dense))),
                                     [0] * len(dense) if toxic is None else toxic, vectors)


@pytest.mark.parametrize("common", [0, 7, 1000])
def test_nearest_examples_are_exact(common):
    rng = np.random.default_rng(4)
    n, terms = 700, 30
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.15)
    dense[::7] = dense[0]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    index = toxicity.Index(model_of(dense), common)
    queries = [q / max(np.linalg.norm(q), 1e-9) for q in rng.random((60, terms)) * (rng.random((60, terms)) < 0.2)] + [np.zeros(terms)]
    got = index.nearest([(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in queries], 10)
    for q, (best, cosines) in zip(queries, got, strict=True):
        truth = np.round(dense @ q, 12)
        order = [i for i in np.lexsort((np.arange(n), -truth)) if truth[i] > 0][:10]
        assert best.tolist() == order and np.allclose(cosines, truth[order])


def test_blocks_that_cannot_hold_a_neighbour_are_skipped():
    rng = np.random.default_rng(5)
    # Four groups of examples with terms of their own, as languages have; one query in each.
    dense = np.zeros((2000, 400))
    for g in range(4):
        dense[g * 500:(g + 1) * 500, g * 100:(g + 1) * 100] = rng.random((500, 100)) * (rng.random((500, 100)) < 0.3)
    dense = dense[rng.permutation(2000)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
    dense = dense[toxicity.block_order(toxicity.projected(vectors, 400))]
    index = toxicity.Index(model_of(dense))
    got = index.nearest([(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense[::100]])
    assert index.completed < index.bounded * 0.6  # a quarter of the blocks holds the neighbours
    for row, (best, cosines) in zip(dense[::100], got, strict=True):
        assert np.allclose(cosines, np.sort(dense @ row)[::-1][:16])


def test_calibration_is_monotone():
    one, none = (np.array([0]), np.array([1.0])), (np.zeros(0, np.int64), np.zeros(0))
    model = toxicity.ToxicityModel.of({b"t": 0}, np.ones(1), [0, 1], [0, 1], [one, one])
    model.calibrate([one] * 6 + [none] * 4, [1, 0, 1, 0, 1, 1, 0, 0, 0, 1])
    assert (np.diff(model.chances) >= 0).all() and (np.diff(model.votes) >= 0).all()
    assert model.alone == pytest.approx((1 + 6 / 12) / 5)


def test_few_toxic_labels_still_separate(spark):
    """Thirty toxic labels in the sample."""
    docs, toxic = toxicity_rows(spark, LARGER)
    learnable = [i for i, _ in docs if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2]
    bad = [i for i in learnable if toxic[i]][:30]
    keep = set(bad) | {i for i in learnable if not toxic[i]}
    labels = spark.createDataFrame([(i, 1, toxic[i]) for i in sorted(keep)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, LARGER, "documents"), labels, crc_of("doc_id") % 4 != 2, sample=20_000)
    held = [(i, t) for i, t in docs if i in toxic and zlib.crc32(str(i).encode()) % 4 == 2]
    scores = {i: s for part in range(0, len(held), 64)
              for (i, _), (s, _) in zip(held[part:part + 64], model.scores([t for _, t in held[part:part + 64]]), strict=True)}
    pairs = [(scores[i] > scores[j]) + (scores[i] == scores[j]) / 2 for i in scores for j in scores if toxic[i] > toxic[j]]
    assert np.mean(pairs) > 0.9


def test_neighbours_and_scores_are_spread(spark):
    docs, _ = toxicity_rows(spark, SF)
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), crc_of("doc_id") % 4 != 2)
    rows = toxicity.score(table(spark, SF, "documents"), model).collect()
    texts = dict(docs)
    full = [r for r in rows if texts[r.doc_id].strip()]
    assert np.mean([len(r.evidence) > 0 for r in full]) > 0.95
    assert Counter(round(r.score, 6) for r in rows).most_common(1)[0][1] < 0.2 * len(rows)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs, labels = toy(spark)
    model = toxicity.fit(docs, labels, crc_of("doc_id") % 4 != 2)
    got = toxicity.score(documents(spark, ODD, clashes=True), model).collect()
    assert len(got) == len(ODD) and all(r.score == model.alone for r in got)
    assert toxicity.score(documents(spark, []), model).count() == 0
    unlabelled = toxicity.fit(docs, labels.limit(0), crc_of("doc_id") % 4 != 2)
    assert {r.score for r in toxicity.score(docs, unlabelled).collect()} == {0.0}


def test_held_out_toxicity(spark):
    got = {r.doc_id: r for r in op1_toxicity(spark, LARGER).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in table(spark, LARGER, "labels").collect() if got[r.doc_id].held_out]
    toxic, other = [r for t, r in held if t], [r for t, r in held if not t]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in other) <= 0.01 * len(other)


def seated_one_by_one(customers, new, discount, r):
    """A Chinese restaurant, customer by customer."""
    tables = 0
    for j in range(customers):
        tables += r.random() * (new + j) < new + discount * 0 + 0 if j == 0 else \
            r.random() * (new + j - discount * tables) < new
    return tables


@pytest.mark.parametrize("customers,new,discount", [(1, 2.0, 0.5), (20, 0.3, 0.8), (200, 5.0, 0.6), (3000, 40.0, 0.8)])
def test_seating_by_jumps_has_the_right_mean(customers, new, discount):
    rng, r = np.random.default_rng(1), random.Random(2)
    jumps = language_model.tables_of(np.full(4000, customers), np.full(4000, new), discount, rng)
    plain = [seated_one_by_one(customers, new, discount, r) for _ in range(300 if customers > 500 else 3000)]
    spread = np.std(plain) / math.sqrt(len(plain)) + np.std(jumps) / math.sqrt(len(jumps))
    assert abs(jumps.mean() - np.mean(plain)) <= 5 * spread + 0.02 * np.mean(plain)
    assert jumps.min() >= 1 and jumps.max() <= customers


def plain_base(rows, learned):
    token_lists = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    counts = Counter(w for ws, ok in zip(token_lists, learned, strict=True) if ok for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(ws), sum(counts[w] > 0 for w in ws),
                sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in token_lists]


def test_counts_and_base_scores(spark, monkeypatch):
    # Few frequent words, so that most tokens go through the join.
    monkeypatch.setattr(language_model, "FREQUENT", 20)
    monkeypatch.setattr(language_model, "CONTEXTS", 5)
    rows = [(i, " ".join(words(i, 60, 300)) + " the end of the") for i in range(200)] + [
        (300, None), (301, ""), (302, "never seen before"), (303, "w1 " * 5000)]
    docs = documents(spark, rows, clashes=True)
    held_out = crc_of("doc_id") % 5 == 1
    got = {r.doc_id: r for r in language_model.score_texts(docs, ~held_out).collect()}
    n, plain = plain_base(rows, [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows])
    for (i, _), (tokens, known, base) in zip(rows, plain, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.perplexity == pytest.approx(10 ** (-r.score / tokens))


def test_broadcast_and_join_score_alike(spark, monkeypatch):
    rows = [(i, " ".join(words(i, 50, 200)) + " a b a c") for i in range(150)]
    held_out = crc_of("doc_id") % 5 == 1
    scores = []
    for frequent in (10, 10_000):
        monkeypatch.setattr(language_model, "FREQUENT", frequent)
        monkeypatch.setattr(language_model, "CONTEXTS", 3)
        scored = language_model.score_texts(documents(spark, rows, parts=1), ~held_out).collect()
        scores.append({r.doc_id: r.score for r in scored})
    a, b = (np.array([s[i] for i in sorted(s)]) for s in scores)
    assert np.allclose(a, b, rtol=1e-9)


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SEATED", 40)  # many buckets
    rows = [(i, " ".join(words(i, 50, 200)) + " a b a c") for i in range(150)]
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for shuffle, parts in (("3", 1), ("7", 5)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            docs = documents(spark, rows, parts=parts)
            scored = language_model.score_texts(docs, crc_of("doc_id") % 5 != 1).collect()
            scores.append({r.doc_id: r.score for r in scored})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(scores[0][i] == pytest.approx(scores[1][i], rel=1e-9) for i in scores[0])


def test_probabilities_sum_to_one(spark):
    texts = documents(spark, [(i, " ".join(words(i, 80, 150)) + " x y x z") for i in range(120)]).select("text")
    contexts = language_model.frequent_words(texts, 4)
    counts = language_model.written(language_model.count_table(texts, contexts), "counts")
    model, state = language_model.probabilities(counts, language_model.restaurants_of(counts, contexts))
    model = model.collect()
    root = sum(r.p for r in model) + state.back()[0] * state.base()
    assert root == pytest.approx(1, abs=1e-9)
    unknown = state.back()[0] * state.base()
    for u in range(1, len(contexts) + 1):
        total = sum(dict(zip(r.us, r.ps, strict=True)).get(u, state.back()[u] * r.p) for r in model) + state.back()[u] * unknown
        assert total == pytest.approx(1, abs=1e-9)
    assert sum(r.c for r in model) == state.tokens and len(model) == state.distinct


def test_language_model_of_odd_rows(spark):
    got = language_model.score_texts(documents(spark, ODD, clashes=True), crc_of("doc_id") % 5 != 1).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert language_model.score_texts(documents(spark, []), crc_of("doc_id") % 5 != 1).count() == 0
    untrained = language_model.score_texts(documents(spark, [(1, "a b")]), crc_of("doc_id") < 0).first()
    assert (untrained.train_tokens, untrained.base_score, untrained.score) == (0, 0.0, 0.0)


def test_the_model_beats_the_base_on_held_out_texts(spark):
    held = [r for r in op4_language_model(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_of_every_batch_are_counted(spark):
    """A word of a smaller share of a batch than a cut once left is the most frequent of all."""
    texts = documents(spark, [(i, "rare " + " ".join(f"w{i}x{j}" for j in range(30_000))) for i in range(3)], parts=1).select("text")
    assert language_model.frequent_words(texts, 1) == [b"rare"]
