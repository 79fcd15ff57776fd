"""Stored tables: same result as the plain operators, cost in proportion to the batch."""

import os

import pytest
from pyspark.sql import functions as F

from sievemark.operators import registry, stored, totals
from sievemark.session import scratch_folder, shared_folder

def now():
    return F.timestamp_seconds(F.lit(1.7e9))

REGISTRY = ("file_id string, name string, mime_type string, owner string, google_created_at timestamp, is_deleted boolean, "
            "last_seen_at timestamp, status_flag string, detection_stage string, pii_category string, user_action string")


def known(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("f"), "id").alias("file_id"), F.concat(F.lit("name "), "id").alias("name"),
        F.lit("text/plain").alias("mime_type"), F.lit("o").alias("owner"), now().alias("google_created_at"),
        F.lit(False).alias("is_deleted"), now().alias("last_seen_at"), F.lit("not_flagged").alias("status_flag"),
        F.lit("regex").alias("detection_stage"), F.lit(None).cast("string").alias("pii_category"),
        F.lit(None).cast("string").alias("user_action"))


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder)
            for f in names if f.startswith("part-")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def statuses(spark, ids):
    return spark.createDataFrame([(i, "flagged", "llm", "email", s) for s, i in enumerate(ids)],
                                 "file_id string, status_flag string, detection_stage string, pii_category string, seq int")


def test_a_batch_costs_its_buckets_only(spark):
    folder = scratch_folder(spark, "stored")
    table = stored.create(known(spark, 20_000), folder, "file_id", 100)
    before = files_of(folder)
    batch = statuses(spark, ["f17", "f18", "f17"])
    done = stored.apply_status(table, batch, now(), ["seq"])
    assert 1 <= len(done.buckets) <= 2
    after = files_of(folder)
    changed = set(before) ^ set(after)
    assert {f.split("_bucket=")[1].split("/")[0] for f in changed} == {str(b) for b in done.buckets}
    # Read and written: about one bucket in a hundred each.
    read = stored.read(spark, table, done.buckets).inputFiles()
    assert sum(os.path.getsize(f.replace("file://", "")) for f in read) < 0.03 * sum(after.values())
    assert done.before.count() == done.after.count() < 0.03 * 20_000
    assert rows(stored.read(spark, table)) == rows(registry.apply_status(known(spark, 20_000), batch, now(), ["seq"]))
    # A repeated batch changes nothing.
    again = stored.apply_status(table, batch, now(), ["seq"])
    assert rows(again.before) == rows(again.after) == rows(done.after)


def test_new_ids_and_empty_batches(spark):
    table = stored.create(known(spark, 0), scratch_folder(spark, "stored"), "file_id", 7)
    assert stored.read(spark, table).count() == 0
    listing = spark.range(5).select(
        F.concat(F.lit("n"), "id").alias("file_id"), F.lit("x").alias("name"), F.lit("text/plain").alias("mime_type"),
        now().alias("modified_time"), F.lit("o").alias("owner"), F.lit(False).alias("deleted"))
    assert stored.upsert_listing(table, listing.limit(0), now()).buckets == []
    stored.upsert_listing(table, listing, now())
    stored.upsert_listing(table, listing, now())
    assert [r.file_id for r in stored.read(spark, table).orderBy("file_id").collect()] == [f"n{i}" for i in range(5)]
    # More buckets than are named one by one, most of them without a folder.
    wide = stored.create(known(spark, 3), scratch_folder(spark, "stored"), "file_id", 5000)
    stored.upsert_listing(wide, spark.range(900).select(F.concat(F.lit("m"), "id").alias("file_id"), *[
        F.lit("x").alias(c) for c in ("name", "mime_type", "owner")], now().alias("modified_time"), F.lit(False).alias("deleted")), now())
    assert stored.read(spark, wide).count() == 903


def findings(spark, pairs):
    return spark.createDataFrame([(f"{f}-{k}", f, s) for f, k, s in pairs], "id string, file_id string, status string")


def test_findings_that_vanish_leave_their_bucket(spark):
    old = findings(spark, [("a", 1, "keep"), ("a", 2, "delete"), ("b", 1, "keep"), ("c", 1, "open")])
    table = stored.create(old, scratch_folder(spark, "stored"), "file_id", 50)
    rescanned = spark.createDataFrame([("a",), ("c",), ("new",)], "file_id string")
    new = findings(spark, [("a", 1, "open"), ("new", 1, "open"), ("stray", 1, "open")])
    stored.replace_findings(table, new, rescanned)
    assert rows(stored.read(spark, table)) == [("a-1", "a", "keep"), ("b-1", "b", "keep"), ("new-1", "new", "open")]
    # Nothing is left of a and new: their buckets are empty, not old.
    stored.replace_findings(table, new.limit(0), rescanned)
    assert rows(stored.read(spark, table)) == [("b-1", "b", "keep")]


def test_a_file_with_most_findings(spark):
    old = findings(spark, [("big", k, "keep") for k in range(3000)] + [(f"f{k}", 1, "open") for k in range(50)])
    table = stored.create(old, scratch_folder(spark, "stored"), "file_id", 8)
    new = findings(spark, [("big", k, "open") for k in range(1500, 4000)])
    stored.replace_findings(table, new, spark.createDataFrame([("big",)], "file_id string"))
    counts = {r.status: r["count"] for r in stored.read(spark, table).where("file_id = 'big'").groupBy("status").count().collect()}
    assert counts == {"keep": 1500, "open": 1000}
    assert stored.read(spark, table).count() == 2550


def test_a_failed_batch_leaves_the_table(spark):
    table = stored.create(known(spark, 100), scratch_folder(spark, "stored"), "file_id", 10)
    before = rows(stored.read(spark, table))
    batch = statuses(spark, ["f1"])
    with pytest.raises(ValueError, match="buckets"):
        stored.apply(table, batch, lambda part: known(spark, 100))
    with pytest.raises(Exception, match="broken"):
        stored.apply(table, batch, lambda part: part.withColumn("name", F.raise_error(F.lit("broken"))))
    assert rows(stored.read(spark, table)) == before


def test_decisions(spark):
    table = stored.create(known(spark, 30), scratch_folder(spark, "stored"), "file_id", 10)
    decisions = spark.createDataFrame([("f1", 1, "keep"), ("f1", 2, "confirm_delete"), ("f2", 1, "unheard"), ("zz", 1, "keep")],
                                      "file_id string, ts int, action string")
    done = stored.apply_decisions(table, decisions, "user_action")
    assert len(done.buckets) <= 2
    assert {r.file_id: r.user_action for r in stored.read(spark, table).where("user_action IS NOT NULL").collect()} == {"f1": "delete"}


def test_a_repeated_batch_with_ids_that_occur_twice(spark):
    old = findings(spark, [("a", 1, "keep"), ("a", 1, "delete"), ("a", 2, "keep"), ("a", 2, "keep"), ("b", 1, "keep")])
    table = stored.create(old, scratch_folder(spark, "stored"), "file_id", 4)
    rescanned = spark.createDataFrame([("a",)], "file_id string")
    new = old.where("file_id = 'a'").drop("status")
    want = rows(registry.replace_findings(old, new, rescanned))
    for _ in range(3):  # once and delivered twice more
        stored.replace_findings(table, new, rescanned)
        assert rows(stored.read(spark, table)) == want
    # Another batch in between: what comes then is applied.
    stored.replace_findings(table, new.limit(0), rescanned)
    stored.replace_findings(table, new.where("id = 'a-1'").limit(1), rescanned)
    assert rows(stored.read(spark, table)) == [("a-1", "a", "open"), ("b-1", "b", "keep")]


def scratch(spark, *purposes):
    folder = shared_folder(spark)
    return {f for f in os.listdir(folder) if f.rpartition("-")[0] in purposes}


def test_disk_of_a_batch_is_given_back(spark):
    names = ("before", "after", "batch", "change")
    old = findings(spark, [(f"f{k}", n, "keep") for k in range(300) for n in range(3)]).withColumn("category", F.lit("email"))
    table = stored.create(old, scratch_folder(spark, "stored"), "file_id", 8)
    figures = totals.start_finding_totals(old, scratch_folder(spark, "totals"), "category", 4)
    left = scratch(spark, *names)
    rescanned = spark.range(0, 300, 2).select(F.concat(F.lit("f"), "id").alias("file_id"))
    new = old.where("id LIKE '%-1'").join(rescanned, "file_id", "left_semi").withColumn("status", F.lit("open"))
    for n in (0, 1):  # the second time it is known and changes nothing
        done = stored.replace_findings(table, new, rescanned)
        folded = totals.fold_findings(figures, done)
        assert len(scratch(spark, *names) - left) == (4 if n == 0 else 0)  # rows before and after, of the findings and the totals
        stored.release(spark, folded)
        stored.release(spark, done)
        assert scratch(spark, *names) == left
    assert rows(stored.read(spark, table)) == rows(registry.replace_findings(old, new, rescanned))
    assert rows(stored.read(spark, figures)) == [("email", 600)]


def test_a_commit_deals_rows_by_files_and_splits_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(stored, "LEAST_ROWS", 1000)
    old = findings(spark, [("big", k, "keep") for k in range(4000)] + [(f"f{k}", 1, "open") for k in range(50)]).repartition(4)
    table = stored.create(old, scratch_folder(spark, "stored"), "file_id", 8)
    again = old.where("file_id = 'f1'").drop("status")
    done = stored.replace_findings(table, again, spark.createDataFrame([("f1",), ("big",)], "file_id string"))
    assert rows(stored.read(spark, table)) == sorted((f"f{k}-1", f"f{k}", "open") for k in range(50))
    stored.apply(table, done.before.select("file_id"), lambda part: done.before)
    big = stored.bucket_of(F.lit("big"), 8)
    place = spark.range(1).select(big.alias("b")).first().b
    kept = [f for f in files_of(table.folder) if f"_bucket={place}/" in f]
    assert 2 <= len(kept) <= 4
    assert rows(stored.read(spark, table)) == rows(old)
