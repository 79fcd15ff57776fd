import random
import time

from pyspark.sql import functions as F
from sievemark.operators import evaluate, kpis, ownership


#: Findings, labels, and the hits, false alarms and misses counted by hand.
MATCHES = [
    ([], [], (0, 0, 0)),
    ([("a", "xyz")], [], (0, 1, 0)),
    ([], [("a", "x")], (0, 0, 1)),
    ([("a", "xyz")], [("a", "y")], (1, 0, 0)),
    ([("a", "xyz")], [("b", "y")], (0, 1, 1)),
    ([("a", "xyz"), ("a", "xyz")], [("a", "x")], (1, 1, 0)),  # a label is used up
    ([("a", "xy"), ("a", "x")], [("a", "x"), ("a", "y")], (1, 1, 1)),  # the first takes x, nothing is left for x
    ([("a", "x"), ("a", "xy")], [("a", "x"), ("a", "y")], (2, 0, 0)),
    ([("a", "xy"), ("b", "xy")], [("b", "x"), ("a", "x")], (2, 0, 0)),
]


def test_label_matching_is_greedy_in_order(spark):
    random.seed(3)
    drawn = [([(random.choice("ab"), "".join(random.choices("xyz", k=3))) for _ in range(random.randrange(6))],
              [(random.choice("ab"), random.choice("xyz")) for _ in range(random.randrange(6))], None)
             for _ in range(120)]
    df = spark.createDataFrame(
        [(f, x) for f, x, _ in MATCHES + drawn], "findings array<struct<category:string,snippet:string>>, "
                                                 "labels array<struct<category:string,expected:string>>")
    rows = df.select(evaluate.match_labels(F.col("findings"), F.col("labels")).alias("m")).collect()
    for row, (findings, labels, counted) in zip(rows, MATCHES + drawn, strict=True):
        assert counted is None or tuple(row.m) == counted
        # Every finding and every label is counted once.
        assert row.m.tp + row.m.fp == len(findings) and row.m.tp + row.m.fn == len(labels)
    total = evaluate.label_scores(df).first()
    assert total.tp + total.fn == total.labels == sum(len(x) for _, x, _ in MATCHES + drawn)


def test_latency_takes_the_sorted_element(spark):
    random.seed(5)
    times = [random.choice([0.001, 0.002, random.random()]) for _ in range(257)]
    df = spark.createDataFrame(list(enumerate(times)), "file_id int, time_s double")
    row, s, n = evaluate.latency(df).first(), sorted(times), len(times)
    assert (row.p50_ms, row.p95_ms, row.p99_ms) == tuple(
        round(1000 * x, 1) for x in (s[n // 2], s[int(n * .95)], s[int(n * .99)]))
    empty = evaluate.latency(df.limit(0)).first()
    assert (empty.files, empty.mean_ms, empty.p99_ms) == (0, 0.0, 0.0)


def test_file_scores_count_errors_apart(spark):
    df = spark.createDataFrame(
        [(True, 2, None), (True, 0, None), (False, 1, None), (False, 0, None), (False, None, "e")],
        "is_pii boolean, n_findings int, error string")
    row = evaluate.file_confusion(df, "d").first()
    assert (row.files_processed, row.errors, row.tp, row.fp, row.fn) == (4, 1, 1, 1, 1)
    assert (row.precision, row.recall, row.f1, row.false_positive_rate) == (0.5, 0.5, 0.5, 0.3333)
    none = evaluate.file_confusion(df.limit(0), "d").first()
    assert (none.precision, none.recall, none.f1, none.false_positive_rate) == (0, 0, 0, 0)


def test_corpus_truth_and_tiers(spark):
    files = spark.createDataFrame(
        [("a/internal_memo_1.txt",), ("a/clean_001.txt",), ("a/x.rtf",), ("a/b.PDF",)], "path string")
    assert {r.path: r.is_pii for r in evaluate.corpus_files(files).collect()} == {
        "a/internal_memo_1.txt": False, "a/clean_001.txt": True, "a/b.PDF": True}
    rows = spark.createDataFrame(
        [("ner", [("ner+llm",), ("ner+llm",), ("regex",)]), ("llm", [("regex",)]), ("ner", [])],
        "expected string, findings array<struct<source:string>>")
    assert [r.outcome for r in evaluate.tier_check(rows).collect()] == ["PASS", "WARN", "MISS"]


def _registry(spark, rows):
    return spark.createDataFrame(rows, "file_id string, owner string, status_flag string")


def test_missing_status_counts_as_processed(spark):
    df = _registry(spark, [("1", "a", "flagged"), ("2", "a", None), ("3", "", "not checked"),
                           ("4", None, "not_checked"), ("5", "b", "not_flagged")])
    row = kpis.totals(df).first()
    assert (row.total_files_registered, row.total_files_flagged, row.total_files_processed) == (
        5, 1, 4)
    assert row.percentage_files_flagged == 25.0
    assert [r.owner for r in kpis.owners(df).collect()] == ["a", "b"]
    assert [r.owner for r in kpis.clean_owners(df).collect()] == ["b"]
    assert kpis.owner_exists(df, "b") and not kpis.owner_exists(df, "c")
    split = {r.outcome: r.files for r in kpis.outcome_split(df).collect()}
    assert split == {"Flagged (contains PII)": 1, "Not flagged": 3, "Not yet processed": 1}


def test_empty_registry(spark):
    df = _registry(spark, [])
    assert kpis.totals(df).first().percentage_files_flagged == 0.0
    assert kpis.outcome_split(df).count() == 2
    assert kpis.owner_exposure(df).count() == 0


def test_ownership_rules_take_the_first_hit(spark):
    users = spark.createDataFrame(
        [("e2", "Bob", "employee"), ("e1", "Zed", "employee"), ("steward_it", "I", "admin")],
        "id string, name string, role string")
    files = spark.createDataFrame(
        [("/x/Expense_Supplier.txt", " bob "), ("/expense/other.txt", "Bob"),
         ("/x/IT_ACCESS_1", None), ("/x/supplier", None), ("/x/training", "Nobody"),
         ("/x/training2", None)], "path string, primary_name string")
    got = {r.path: (r.source_type, r.owner_user_id, r.master_of_data_user_id)
           for r in ownership.resolve_ownership(files, users).collect()}
    assert got == {
        "/x/Expense_Supplier.txt": ("onedrive", "e2", None),
        "/expense/other.txt": ("fileshare", None, "e2"),
        "/x/IT_ACCESS_1": ("sharepoint", None, "steward_it"),
        "/x/supplier": ("sharepoint", None, "e2"),
        "/x/training": ("onedrive", "e2", None), "/x/training2": ("onedrive", "e2", None)}


def plain_match(findings, labels):
    left, hits = list(labels), 0
    for category, snippet in findings:
        fits = [i for i, (c, e) in enumerate(left) if None not in (c, e, category, snippet) and c == category and e in snippet]
        if fits:
            left.pop(fits[0])
            hits += 1
    return hits, len(findings) - hits, len(left)


MATCH_SCHEMA = ("findings array<struct<category string, snippet string>>, labels array<struct<category string, expected string>>")


def test_matching_against_plain_lists(spark):
    r = random.Random(7)
    piece = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(n)))
    rows = [([(r.choice("xyz"), piece(7)) for _ in range(r.randrange(12))],
             [(r.choice("xyz"), piece(4)) for _ in range(r.randrange(12))]) for _ in range(300)]
    rows += [([(None, "a"), ("x", None), ("x", "ab")], [("x", None), (None, "a"), ("x", "")]), ([], [])]
    got = spark.createDataFrame(rows, MATCH_SCHEMA).select(evaluate.match_labels(F.col("findings"), F.col("labels")).alias("m")).collect()
    assert [tuple(g.m) for g in got] == [plain_match(f, x) for f, x in rows]


def seconds(run):
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def test_matching_many_labels_takes_linear_time():
    def both(n):
        findings = [{"category": "c", "snippet": f"some value {i:06d} and more"} for i in range(n)]
        labels = [{"category": "c", "expected": f"{i:06d}"} for i in reversed(range(n))]
        return findings, labels

    small, large = both(10_000), both(20_000)
    assert evaluate._matched(*small) == (10_000, 0, 0)
    assert min(seconds(lambda: evaluate._matched(*large)) for _ in range(3)) < 3 * min(
        seconds(lambda: evaluate._matched(*small)) for _ in range(3))


ODD_TIMES = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e-310, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0, 1.9999999999999998, 4.0,
             -1.0, -2.5, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), None, 0.1, 0.30000000000000004, 1024.0, 1e16]


def test_order_key_orders_like_the_engine(spark):
    r = random.Random(3)
    values = ODD_TIMES + [r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300) for _ in range(3000)]
    values += [float(2.0**k * (1 + e)) for k in range(-1030, 1023, 7) for e in (0, 2**-52)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", evaluate.order_key(F.col("v")))
    rows = [(x.v, x.k) for x in df.orderBy("v").collect()]
    keys = [k for _, k in rows]
    assert keys == sorted(keys)
    # Different values, different keys.
    same = [(a, b) for (a, x), (b, y) in zip(rows, rows[1:], strict=False) if x == y]
    assert all(a == b or (a != a and b != b) for a, b in same)


def test_latency_without_a_sort(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(ODD_TIMES * 3)], "file_id string, time_s double")
    order = sorted(ODD_TIMES * 3, key=lambda v: (v is not None, v != v if v is not None else 0, v if v is not None and v == v else 0))
    counts = {r["p"]: r["n"] for r in df.groupBy(F.shiftright(evaluate.order_key(F.col("time_s")), 48).alias("p")).agg(
        F.count("*").alias("n")).collect()}
    positions = {str(i): i for i in range(0, len(order), 5)}
    got = evaluate.at_positions(df, "time_s", positions, counts)
    for name, at in positions.items():
        assert got[name] == order[at] or (got[name] != got[name] and order[at] != order[at])
    assert "Sort" not in evaluate.latency(df.where("time_s < 10"))._jdf.queryExecution().toString()
