import html
import random
import re
import time

from pyspark.sql import functions as F

from sievemark.functions import governance as gov
from sievemark.functions import preview
from sievemark.functions.ordering import with_position
from sievemark.functions.preview import explanation, redacted, with_preview
from sievemark.operators import review


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first().o


def test_masking(spark):
    assert _one(spark, "john.doe@x.com 12 abc abcd", gov.mask) == "j•••••• 12 abc a•••"
    assert _one(spark, "", gov.mask) == ""


def test_labels_and_epochs(spark):
    assert _one(spark, "other_pii", gov.pretty_label) == "Other Pii"
    assert _one(spark, "passport", gov.pretty_label) == "Passport number"
    assert _one(spark, "2024-01-02T03:04:05Z", gov.to_epoch) == 1704164645.0
    assert _one(spark, "soon", gov.to_epoch) == 0.0
    assert _one(spark, "fax", lambda c: F.array_join(gov.articles(c), ",")) == "Art. 5,Art. 17"
    assert _one(spark, "email", lambda c: F.array_join(gov.articles(c), ",")) == (
        "Art. 5,Art. 17,Art. 25")
    assert _one(spark, "x", lambda c: gov.grouped_int(F.lit(2613.4))) == "2,613"
    assert _one(spark, "x", lambda c: gov.confidence_percent(F.lit(0.555), True)) == 56


def _plain_preview(text, findings):
    marks = []
    for category, snippet in findings:
        snippet = (snippet or "").strip()
        if len(snippet) < 2:
            continue
        at = text.find(snippet)
        while at != -1:
            if not any(at < e and at + len(snippet) > s for s, e, _ in marks):
                marks.append((at, at + len(snippet), category))
                break
            at = text.find(snippet, at + 1)
    out, cursor = "", 0
    esc = lambda s: html.escape(s).replace("&#x27;", "&#39;")
    for start, end, category in sorted(marks):
        out += f'{esc(text[cursor:start])}<mark data-category="{category}">{esc(text[start:end])}</mark>'
        cursor = end
    return out + esc(text[cursor:])


def test_preview_matches_stepwise_marking(spark):
    cases = [
        ("a <b> & 'c' \"d\"", [("email", "b"), ("email", "<b>")]),
        ("aaaaaa", [("name", "aaa"), ("phone", "aa"), ("fax", "aa"), ("ssn", "a")]),
        ("abcabcabc", [("name", "bca"), ("name", "abc"), ("name", "abc"), ("x", " zz ")]),
        ("Ä💡 tel 12 Ä💡", [("phone", "12"), ("name", "💡 tel"), ("name", "Ä💡")]),
        ("plain", []),
    ]
    df = spark.createDataFrame(
        cases, "text string, findings array<struct<category:string,snippet:string>>")
    for row in with_preview(df).collect():
        assert row.preview == _plain_preview(row.text, [tuple(f) for f in row.findings])


def test_explanation_wording(spark):
    df = spark.createDataFrame([
        ("a.txt", [("email", ["Art. 5", "Art. 17", "Art. 25"])]),
        ("b.txt", [("email", ["Art. 5"]), ("name", ["Art. 17"]), ("email", ["Art. 5"]),
                   ("fax", ["Art. 5"])])],
        "name string, findings array<struct<category:string,gdpr_articles:array<string>>>")
    one, many = [r.o for r in df.select(explanation(F.col("name"), F.col("findings")).alias(
        "o")).collect()]
    assert "detected 1 item of personal data — email address. " in one
    assert "(Art. 17, Art. 25, Art. 5)" in one
    assert "detected 4 items of personal data — email address, name and fax number. " in many


def test_positions_are_global_and_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("same"))
    rows = with_position(df, [F.col("same"), F.col("v")]).collect()
    assert sorted((r.position, r.v) for r in rows) == [(i + 1, i) for i in range(1000)]
    assert with_position(df.filter("v < 0"), [F.col("v")]).count() == 0


def test_review_cycle_wraps_around_for_each_person(spark):
    rows = [("hot", f"f{i:03d}", float(i % 7), ["pending", "extended", "deleted"][i % 3])
            for i in range(90)] + [("solo", "z", 1.0, "pending"), ("done", "y", 1.0, "cancelled")]
    df = spark.createDataFrame(
        rows, "user_id string, id string, last_modified double, decision string")
    got = {(r.user_id, r.id): (r.position, r.cycle_size, r.previous_id, r.next_id)
           for r in review.review_cycle(df).collect()}
    want = {}
    for user in ("hot", "solo"):
        cycle = [r[1] for r in sorted((r for r in rows if r[0] == user and r[3] in (
            "pending", "extended")), key=lambda r: (r[2], r[1]))]
        for i, f in enumerate(cycle):
            want[user, f] = (i + 1, len(cycle), cycle[i - 1], cycle[(i + 1) % len(cycle)])
    assert got == want


def test_braces_in_a_file_name_stay(spark):
    df = spark.createDataFrame([("a {n} {types}.txt", [("email", ["Art. 5"])])],
                               "name string, findings array<struct<category:string,gdpr_articles:array<string>>>")
    assert "“a {n} {types}.txt” was flagged" in df.select(explanation(F.col("name"), F.col("findings"))).first()[0]


def test_many_marks_take_linear_time(spark):
    text = " ".join(f"user{i}@mail.org" for i in range(20_000))
    found = spark.createDataFrame([(text, [("email", w) for w in text.split()])],
                                  "text string, findings array<struct<category:string,snippet:string>>")
    assert with_preview(found).first().preview.count("<mark ") == 20_000


def test_redaction_covers_overlapping_findings(spark):
    df = spark.createDataFrame(
        [("call Ann on 12345 now", [("name", 5, 8), ("phone", 12, 17)]), ("abcdef", [("x", 1, 5), ("y", 2, 3)]),
         ("abcdef", [("x", 0, 3), ("y", 2, 6)]), ("none", [])],
        "text string, findings array<struct<category:string,start:int,end:int>>")
    assert [r[0] for r in df.select(redacted(F.col("text"), F.col("findings"))).collect()] == [
        "call [name] on [phone] now", "a[x]f", "[x]", "none"]


def test_adaptive_execution_splits_a_hot_key(spark):
    """One key holds a third of the rows; the plain join must be dealt to several tasks."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
             "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("-1", "16k", "8k", "1.5", "16"), strict=True):
            spark.conf.set(n, v)
        rows = spark.range(60_000).select(
            F.concat(F.lit("id"), "id").alias("id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("file_id"))
        ids = spark.range(0, 60_000, 2).select(F.concat(F.lit("f"), "id").alias("file_id"))
        joined = rows.join(ids, "file_id", "left_anti")
        assert joined.count() == 20_000 + sum(1 for i in range(60_000) if i % 3 and i % 2)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_unknown_actions_change_nothing(spark):
    from sievemark.operators import registry
    files = spark.createDataFrame([("a", "keep"), ("b", None)], "file_id string, user_action string")
    log = spark.createDataFrame([("a", "keep", 1), ("a", "archive", 2), ("b", "burn", 1)],
                                "file_id string, action string, ts int")
    after = registry.apply_decisions(files, log, "file_id", "user_action")
    assert sorted(map(tuple, after.collect()), key=str) == [("a", "keep"), ("b", None)]
    assert [tuple(r) for r in registry.decision_outcomes(files, log, "file_id").collect()] == [("a", "keep", True)]
    assert {r.action for r in registry.rejected_decisions(log).collect()} == {"archive", "burn"}
    assert [tuple(r) for r in review.latest_decisions(log).collect()] == [("a", "extended")]


def test_review_figures(spark):
    files = spark.createDataFrame(
        [("a", "p/Apple.txt", 1.0, "u", None), ("b", "p/pear.txt", 2.0, "u", "v"),
         ("c", "p/fig.txt", 3.0, "v", None)],
        "id string, path string, last_modified double, owner_user_id string, "
        "master_of_data_user_id string")
    findings = spark.createDataFrame(
        [("a", "passport", "keep"), ("a", "name", "open"), ("b", "name", "delete")],
        "file_id string, category string, status string")
    decisions = spark.createDataFrame(
        [("a", "keep", 1), ("a", "confirm_delete", 2), ("b", "keep", 5), ("zz", "keep", 1)],
        "file_id string, action string, ts int")
    counts = review.decision_counts(review.with_decision(files, decisions)).first().asDict()
    assert counts == {"total": 3, "pending": 1, "deleted": 1, "cancelled": 0, "extended": 1,
                      "decided": 1}
    row = review.files_fully_reviewed(files, findings).first()
    assert (row.files, row.reviewed, row.left, row.percent) == (3, 2, 1, 66)
    assert review.files_fully_reviewed(files.limit(0), findings).first().percent == 100
    risk = {r.file_id: r.priority for r in review.file_risk(findings).collect()}
    assert risk == {"a": "high", "b": "low"}
    still_open = {r.file_id: r.priority for r in review.file_risk(findings, True).collect()}
    assert still_open == {"a": "low", "b": "low"}
    assert [r.id for r in review.file_list(files, findings, query=" PEAR").collect()] == ["b"]
    assert [r.id for r in review.file_list(files, findings, hide_low_risk=True).collect()] == ["a"]
    assert [r.id for r in review.file_list(files, findings, sort="recent").collect()] == ["b", "a"]
    stats = {r.user_id: r.total for r in review.user_stats(files, findings, decisions, 1e9).collect()}
    assert stats == {"u": 2, "v": 1}
    assert re.fullmatch(r"[0-9a-f]{16}", _one(spark, "/x", gov.file_id))


def timed(run):
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def _many(n):
    text = " ".join(f"value{i:06d} <{i}>" for i in range(n))
    findings = [{"snippet": f"value{i:06d}", "category": "name"} for i in reversed(range(n))]
    spans = [(i * 10, i * 10 + 15, "name" if i % 2 else "email") for i in range(n)]
    return text, findings, spans


def test_marks_and_redaction_take_linear_time():
    small, large = _many(4000), _many(8000)
    for work in (lambda m: preview._marked(*m[:2]), lambda m: preview._cut_out(m[0], m[2])):
        assert min(timed(lambda w=work: w(large)) for _ in range(3)) < 3 * min(timed(lambda w=work: w(small)) for _ in range(3))
    assert preview._marked(*large[:2]).count("<mark ") == 8000


def test_many_snippets_are_placed_like_few(monkeypatch):
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("aab ") for _ in range(60))
        findings = [{"snippet": "".join(r.choice("ab ") for _ in range(r.randrange(1, 6))), "category": c} for c in "cdefghijklmnopqr"]
        few = preview._place(text, findings)
        monkeypatch.setattr(preview, "FEW", -1)
        many = preview._place(text, findings)
        monkeypatch.undo()
        assert few == many


def test_null_texts_and_findings(spark):
    schema = "text string, findings array<struct<category string, start int, end int, snippet string>>"
    rows = [(None, []), ("a<b", None), ("a<b", []), ("x", [("name", 0, 1, None)])]
    df = spark.createDataFrame(rows, schema)
    assert [r.preview for r in with_preview(df).collect()] == [None, "a&lt;b", "a&lt;b", "x"]
    assert [r[0] for r in df.select(redacted(F.col("text"), F.col("findings"))).collect()] == [None, None, "a<b", "[name]"]
