import json

from pyspark.sql import functions as F
from sievemark.operators import cascade

CLEAN = "nothing personal in here"


def _entities(*items):
    return json.dumps({"results": {"documents": [{"id": "1", "entities": [
        {"text": t, "category": c, "confidenceScore": s} for t, c, s in items]}]}})


def _answers(spark, rows, column):
    return spark.createDataFrame(rows, f"file_id string, {column} string")


def _run(spark, ner=None, verify=None, detect=None, text=CLEAN, **options):
    texts = spark.createDataFrame([("f", text)], "file_id string, text string")
    tables = [None if v is None else _answers(spark, [("f", v)] if v != "missing" else [], c)
              for v, c in ((ner, "response"), (verify, "content"), (detect, "content"))]
    row = cascade.scan_texts(texts, *tables, **options).first()
    return row.stage, [(f.category, f.snippet, f.source, f.confidence) for f in row.findings], \
        row.category, row.status_flag


def test_rules_win_and_name_the_first_category(spark):
    stage, found, category, flag = _run(
        spark, _entities(("X", "Person", 0.99)), text="call 0171 2345678, mail a@b.cc")
    assert (stage, category, flag) == ("regex", "email", "flagged")
    assert [f[0] for f in found] == ["email", "phone"]


def test_sure_entities_need_no_verification(spark):
    assert _run(spark, _entities(("Ann", "Person", 0.95), ("7", "Quantity", 0.99)), "[]", "[]") == (
        "ner", [("name", "Ann", "ner", 0.95)], "name", "flagged")


def test_unsure_entities_are_verified(spark):
    ner = _entities(("Ann", "Person", 0.95), ("Rd 1", "Address", 0.86), ("x@y", "Email", 0.87))
    verdict = json.dumps([{"index": 0, "is_pii": True, "category": "national_id"},
                          {"index": 1, "is_pii": False}])
    stage, found, category, _ = _run(spark, ner, verdict)
    assert stage == "ner+llm_verify" and category == "name"
    assert found == [("name", "Ann", "ner", 0.95), ("national_id", "Rd 1", "ner+llm", 0.86)]


def test_unreadable_verdicts_keep_candidates(spark):
    ner = _entities(("Rd 1", "Address", 0.86))
    kept = [("home_address", "Rd 1", "ner", 0.86)]
    for answer in ("not json", '{"index": 0}', "missing", "[1", ""):
        assert _run(spark, ner, answer)[:2] == ("ner+llm_verify", kept), answer
    for answer in ("[]", "[1, null]", '[{"index": 0, "is_pii": "true"}]'):
        assert _run(spark, ner, answer)[:2] == ("llm_detect", []), answer
    assert _run(spark, ner, None)[:2] == ("llm_detect", [])


def test_verdict_details(spark):
    ner = _entities(("Rd 1", "Address", 0.86))
    shown = json.dumps([{"index": 0, "is_pii": True, "category": "", "confidence": None}])
    assert _run(spark, ner, shown)[1] == [("home_address", "Rd 1", "ner+llm", None)]
    twice = json.dumps([{"index": 0, "is_pii": False, "category": "email", "confidence": 0.2},
                        {"index": 0, "is_pii": True, "category": "phone", "confidence": 0.9}])
    assert _run(spark, ner, twice)[1] == [("email", "Rd 1", "ner+llm", 0.2)]


def test_model_findings_once_per_category(spark):
    answer = json.dumps([{"category": "name", "confidence": 0.5}, {"category": "name"},
                         {"confidence": 1}, "x", {"category": "health_data", "confidence": 0.9}])
    assert _run(spark, _entities(), "[]", answer) == (
        "llm_detect", [("name", None, "llm", 0.5), ("health_data", None, "llm", 0.9)],
        "health_data", "flagged")
    for answer in ("not json", "{}", "[]", "missing", None):
        assert _run(spark, _entities(), "[]", answer) == ("llm_detect", [], None, "not_flagged")


def test_skipping_models_keeps_all_entities(spark):
    ner = _entities(("Rd 1", "Address", 0.86), ("Q", "Person", 0.3))
    assert _run(spark, ner, skip_models=True)[:2] == (
        "ner", [("home_address", "Rd 1", "ner", 0.86)])
    assert _run(spark, "{broken", skip_models=True)[:2] == ("regex", [])
    assert _run(spark, "missing", skip_models=True)[:2] == ("regex", [])
    assert _run(spark, "{broken", "[]", '[{"category": "name"}]')[0] == "llm_detect"


def test_entity_modes(spark):
    row = spark.createDataFrame([(_entities(("a", "Email", 0.9), ("b", "Person", 0.9)),)], "r string")
    kept = lambda mode: [e.category for e in row.select(cascade.answered_entities(
        F.col("r"), mode).alias("e")).first().e]
    assert kept(None) == ["Email", "Person"]
    assert kept("gdpr_full") == kept("unheard of") == ["Person"]


def test_batches_come_back_by_id(spark):
    texts = spark.createDataFrame([(f"f{i}", f"Label: t{i}") for i in range(5)],
                                  "file_id string, text string")
    sent = cascade.entity_requests(texts.coalesce(1), 2).collect()
    assert sorted(len(r.file_ids) for r in sent) == [1, 2, 2]
    answers = []
    for r in sent:
        documents = json.loads(r.request)["analysisInput"]["documents"]
        answers.append((r.file_ids, json.dumps({"results": {"documents": [
            {"id": d["id"], "entities": [
                {"text": d["text"], "category": "Person", "confidenceScore": 0.9}]}
            for d in reversed(documents)]}})))
    got = cascade.batch_entities(spark.createDataFrame(
        answers, "file_ids array<string>, response string")).collect()
    assert {r.file_id: r.entities[0].text for r in got} == {f"f{i}": f"t{i}" for i in range(5)}


def test_scores_and_cache(spark):
    replies = ["0.9", "about 1.7", "0", "no", "1"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [r.s for r in df.select(cascade.parse_score(F.col("r")).alias("s")).collect()] == [
        0.9, 1.0, 0.0, None, 1.0]
    findings = spark.createDataFrame(
        [(1, "name", "A", 0.7, "regex"), (2, "name", "A", 0.7, "regex"),
         (3, "name", "B", 0.7, "regex"), (4, "name", "A", 0.8, "regex")],
        "id int, category string, snippet string, confidence double, detector string")
    empty = spark.createDataFrame([], "key string, verdict double")
    asked = []

    def scorer(pending):
        asked.append(pending.count())
        return pending.withColumn("verdict", F.when(F.col("snippet") == "A", 0.2))

    cache = cascade.updated_cache(findings, empty, scorer)
    again = cascade.updated_cache(findings, cache, scorer)
    assert asked == [2, 1] and again.count() == 1
    rows = {r.id: (r.confidence, r.detector)
            for r in cascade.escalate(findings, cache, ["id"]).collect()}
    assert rows == {1: (0.2, "llm"), 2: (0.2, "llm"), 3: (0.7, "regex"), 4: (0.8, "regex")}


def test_repeated_answers_count_once_and_parts_are_joined(spark):
    texts = spark.createDataFrame([("f", CLEAN), ("g", CLEAN)], "file_id string, text string")
    ner = _answers(spark, [("f", _entities())] * 3 + [("g", _entities())], "response")
    detect = spark.createDataFrame(
        [("f", 1, '[{"category": "phone", "confidence": 0.5}]'), ("f", 0, '[{"category": "name", "confidence": 0.9}]'),
         ("f", 0, '[{"category": "name", "confidence": 0.9}]'), ("g", 0, "no"), ("g", 1, "[]")],
        "file_id string, part int, content string")
    results = cascade.scan_texts(texts, ner, None, detect)
    assert results.count() == 2 and cascade.run_summary(results).first().total == 2
    rows = {r.file_id: [f.category for f in r.findings] for r in results.collect()}
    assert rows == {"f": ["name", "phone"], "g": []}


def test_windows_cover_the_whole_text(spark):
    for size, shared, n in ((10, 0, 35), (10, 3, 35), (10, 3, 10), (10, 3, 11), (10, 3, 0), (10, 0, 40)):
        text = "".join(chr(97 + i % 26) for i in range(n))
        row = spark.createDataFrame([(text,)], "t string").select(cascade.windows(F.col("t"), size, shared)).first()[0]
        assert all(w.text == text[w.start:w.start + size] for w in row)
        assert [w.part for w in row] == list(range(len(row)))
        assert {i for w in row for i in range(w.start, w.start + len(w.text))} == set(range(n))
        assert all(b.start == a.start + size - shared for a, b in zip(row, row[1:], strict=False))


def test_requests_hold_only_what_is_open_and_all_of_it(spark):
    long = "nothing here " * 2000
    texts = spark.createDataFrame([("rules", "mail a@b.cc"), ("long", long + "Rd 77"), ("sure", CLEAN), ("open", CLEAN)],
                                  "file_id string, text string")
    ner = _answers(spark, [("long", _entities(("Rd 77", "Address", 0.86), ("absent", "Person", 0.87))),
                           ("sure", _entities(("Ann", "Person", 0.95))), ("rules", _entities(("x", "Address", 0.86)))],
                   "response")
    sent = [json.loads(r.request) for r in cascade.entity_requests(cascade.residue(texts), 2).collect()]
    assert sum(len(s["analysisInput"]["documents"]) for s in sent) == 3
    asked = cascade.verify_requests(cascade.unsure_candidates(texts, ner)).collect()
    assert {(r.file_id, r.part) for r in asked} == {("long", 0), ("long", 4)}
    last = next(r for r in asked if r.part == 4)
    assert last.request.startswith("Text:\n" + (long + "Rd 77")[last.start:]) and '"index":0' in last.request
    detect = cascade.detect_requests(texts, ner, _answers(spark, [("long", "[]")], "content")).collect()
    parts = {f: "".join(r.request for r in sorted(detect) if r.file_id == f) for f in ("long", "open")}
    assert parts == {"long": long + "Rd 77", "open": CLEAN} and {r.file_id for r in detect} == set(parts)
