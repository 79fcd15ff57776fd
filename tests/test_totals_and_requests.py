"""Totals that follow changes, requests from one scan, page text against a plain splitter."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.operators import cascade, kpis, stored, totals
from sievemark.session import scratch_folder
from sievemark.sources.files import page_texts
from workload.derived import relation, table

SF = "/root/testdata/sf0.001"
REGISTRY = ("file_id string, name string, mime_type string, owner string, google_created_at timestamp, is_deleted boolean, "
            "last_seen_at timestamp, status_flag string, detection_stage string, pii_category string, user_action string")


def registry_rows(spark, rows):
    return spark.createDataFrame([(i, "n", "text/plain", o, None, False, None, s, None, None, None) for i, o, s in rows], REGISTRY)


def now():
    return F.timestamp_seconds(F.lit(1.7e9))


def test_totals_after_ten_batches_equal_a_recount(spark):
    r = random.Random(9)
    states = ["flagged", "not_flagged", "not checked", "not_checked", None]
    owner = lambda: r.choice(["a", "b", "c", "", None, "hub", "hub", "hub"])
    known = registry_rows(spark, [(f"f{i}", owner(), r.choice(states)) for i in range(120)])
    kept = stored.create(known, scratch_folder(spark, "t"), "file_id", 40)
    figures = totals.start_registry_totals(known, scratch_folder(spark, "t"), 16)
    for n in range(10):
        if n % 2:
            batch = spark.createDataFrame([(f"f{r.randrange(140)}", r.choice(states[:3]), "regex", None, k) for k in range(6)],
                                          "file_id string, status_flag string, detection_stage string, pii_category string, seq int")
            done = stored.apply_status(kept, batch, now(), ["seq"])
        else:
            batch = spark.createDataFrame([(f"f{r.randrange(140)}", "n", "text/plain", owner(), False) for _ in range(6)],
                                          "file_id string, name string, mime_type string, owner string, deleted boolean").withColumn(
                "modified_time", now())
            done = stored.upsert_listing(kept, batch, now())
        assert len(totals.fold_registry(figures, done).buckets) <= 12  # owners that changed, not all of the table
    registry = stored.read(spark, kept)
    row, want = totals.registry_figures(spark, figures).first(), kpis.snapshot(registry, None, now()).first()
    for name in ("total_files_registered", "total_files_flagged", "total_files_processed", "owner_count", "flagged_owner_count"):
        assert row[name] == want[name], name
    assert totals.flagged_per_owner(spark, figures).collect() == kpis.flagged_per_owner(registry).collect()
    assert totals.owners(spark, figures).collect() == kpis.owners(registry).collect()
    assert totals.clean_owners(spark, figures).collect() == kpis.clean_owners(registry).collect()
    # A repeated batch changes no total.
    again = stored.upsert_listing(kept, batch, now()) if n % 2 == 0 else stored.apply_status(kept, batch, now(), ["seq"])
    assert totals.fold_registry(figures, again).buckets == []


def test_totals_without_their_base_refuse(spark):
    known = registry_rows(spark, [("f1", "a", "flagged")])
    kept = stored.create(known, scratch_folder(spark, "t"), "file_id", 4)
    empty = totals.start_registry_totals(known.limit(0), scratch_folder(spark, "t"), 4)
    batch = spark.createDataFrame([("f1", "not_flagged", "regex", None, 1)],
                                  "file_id string, status_flag string, detection_stage string, pii_category string, seq int")
    done = stored.apply_status(kept, batch, now(), ["seq"])
    with pytest.raises(ValueError, match="lack"):
        totals.fold_registry(empty, done)
    other = totals.start_finding_totals(spark.createDataFrame([], "category string"), scratch_folder(spark, "t"), "category", 4)
    with pytest.raises(ValueError, match="something else"):
        totals.fold_registry(other, done)


def test_distinct_files_follow_their_findings(spark):
    findings = spark.createDataFrame([("1", "a", "open"), ("2", "a", "open"), ("3", "b", "open")], "id string, file_id string, status string")
    kept = stored.create(findings, scratch_folder(spark, "t"), "file_id", 8)
    per_file = totals.start_finding_totals(findings, scratch_folder(spark, "t"), "file_id", 8)
    ids = lambda *f: spark.createDataFrame([(x,) for x in f], "file_id string")
    new = spark.createDataFrame([("9", "c", "open")], "id string, file_id string, status string").drop("status")
    totals.fold_findings(per_file, stored.replace_findings(kept, new, ids("a", "c")))
    assert tuple(totals.finding_figures(spark, per_file).first()) == (2, 2)
    totals.fold_findings(per_file, stored.replace_findings(kept, new.limit(0), ids("a", "b", "c")))
    assert tuple(totals.finding_figures(spark, per_file).first()) == (0, 0)


def plans(frame):
    frame.collect()  # the plan that ran, not the first guess
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_are_scanned_once_and_not_shuffled_with_the_answers(spark):
    texts = table(spark, SF, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = cascade.model_requests(texts, relation(spark, SF, "entity_answers"), relation(spark, SF, "verify_answers"), 4)
        for frame in (made.verify, made.detect):
            plan = plans(frame)
            assert "regexp_extract_all" not in plan and "SortMergeJoin" in plan
            shuffles = [block for block in re.split(r"\n(?=[ :+-]*(?:\(\d+\) )?\w)", plan) if "Exchange hashpartitioning" in block]
            assert shuffles
            # Below an exchange there are answers only: no scan of the bucketed texts.
            tree = plan.split("== Initial Plan ==")[0]
            for at in [m.start() for m in re.finditer("Exchange hashpartitioning", tree)]:
                line_start = tree.rfind("\n", 0, at) + 1
                depth = at - line_start
                below = [x for x in tree[at:].split("\n")[1:]]
                inside = []
                for x in below:
                    if len(x) - len(x.lstrip(" :+-")) <= depth:
                        break
                    inside.append(x)
                assert not any("residue" in x for x in inside)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_nodes(page):
    page = re.sub(r"(?is)<(script|style|template)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "<i>", page)
    nodes = [html.unescape(n) for n in re.split(r"<[^>]*>", page)]
    return "\n".join(("\n" if "\n" in n else " ") if not n.strip(" \n\t\f\r") else n for n in nodes if n)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_page_text_of_all_given_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in page_texts(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id] == plain_nodes(r.html), r.page_id
