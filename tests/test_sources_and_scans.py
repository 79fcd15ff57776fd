import json
import os
import zipfile

import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from sievemark.operators import registry
from sievemark.plans import scan
from sievemark.functions import ordering
from sievemark.sources import files as source_files
from sievemark.sources import media
from sievemark.sources.files import page_texts, read_texts, split_errors, texts_of
from sievemark.sources.listing import read_listing
from sievemark.sources.parsers import html_text
from sievemark.streaming import consumers
from workload import changes
from workload.derived import FILES, FINDINGS, relation

SENTENCE = "Contact: jane.doe@example.com"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


@pytest.fixture()
def folder(tmp_path):
    sub = tmp_path / "in" / "deep"
    sub.mkdir(parents=True)
    (sub / "note.TXT").write_bytes("a\r\nb\xff ".encode("latin-1") + SENTENCE.encode())
    (sub / "table.csv").write_text('Name,Mail\n"Doe, Jane",jane.doe@example.com\n')
    (sub / "page.html").write_text(f"<p>{SENTENCE}</p><script>x</script>")
    (sub / "odd.xyz").write_text("?")
    (sub / "broken.docx").write_text("not a zip")
    _zip(sub / "letter.docx", {"word/document.xml": (
        f"<w:document {_W}><w:body><w:p><w:r><w:t>{SENTENCE}</w:t><w:tab/><w:t>x</w:t></w:r>"
        "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:r><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p></w:body></w:document>")})
    slide = (f"<p:sld {_P} {_A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{{0}}</a:t></a:r>"
             "<a:br/><a:r><a:t>x</a:t></a:r></a:p><a:p/></p:txBody></p:sp></p:spTree></p:cSld>"
             "</p:sld>")
    _zip(sub / "deck.pptx", {
        "ppt/presentation.xml": f'<p:presentation {_P} {_R}><p:sldIdLst><p:sldId r:id="b"/>'
                                '<p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _RELS + '<Relationship Id="a" Target="slides/s1.xml"/>'
                                           '<Relationship Id="b" Target="slides/s2.xml"/>'
                                           "</Relationships>",
        "ppt/slides/s1.xml": slide.format("one"), "ppt/slides/s2.xml": slide.format(SENTENCE)})
    _zip(sub / "book.xlsx", {
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="A" r:id="r1"/></sheets>'
                           "</workbook>",
        "xl/_rels/workbook.xml.rels": _RELS + '<Relationship Id="r1" Target="worksheets/s.xml"/>'
                                      "</Relationships>",
        "xl/sharedStrings.xml": f"<sst {_S}><si><t>Name</t></si><si><r><t>Ja</t></r><r><t>ne</t>"
                                "</r></si></sst>",
        "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
                         "</cellXfs></styleSheet>",
        "xl/worksheets/s.xml": f'<worksheet {_S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
                               '<c r="C1"><v>1.5</v></c></row><row r="2"><c r="A2" t="s"><v>1</v>'
                               '</c><c r="B2"><v>7</v></c><c r="C2" s="1"><v>45000</v></c></row>'
                               '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" t="inlineStr"><is>'
                               "<t>in</t></is></c></row></sheetData></worksheet>"})
    return str(tmp_path / "in")


WANT = {
    "note.TXT": "a\nb� " + SENTENCE,
    "table.csv": "Name\tMail\nDoe, Jane\tjane.doe@example.com",
    "page.html": SENTENCE,
    "letter.docx": SENTENCE + "\txlink\ntwo\nthree",
    "deck.pptx": SENTENCE + "\vx\n\none\vx\n",
    "book.xlsx": "Name\t\t1.5\nJane\t7\t2023-03-15 00:00:00\nTrue\tin\t",
}


def test_every_format_and_every_failure(spark, folder):
    for texts in (read_texts(spark, folder),
                  texts_of(read_texts(spark, folder).drop("text", "error"))):
        good, bad = split_errors(texts)
        assert {os.path.basename(r.path): r.text for r in good.collect()} == WANT
        errors = {os.path.basename(r.path): r.error for r in bad.collect()}
        assert set(errors) == {"odd.xyz", "broken.docx"}
        assert "unsupported file type: .xyz" in errors["odd.xyz"]


def test_html_text_nodes():
    page = ("<!DOCTYPE html><html><head><title>T&amp;t</title><style>p{}</style></head><body>"
            "<p>a<b>b</b>c<!--x-->d</p>\n \n<pre>  </pre><br>e&nbsp;<template><i>h</i></template>"
            "<textarea> \n</textarea></body></html>")
    assert html_text(page).split("\n") == (
        "T&t|a|b|c|d|||  |e\xa0| |".split("|"))


def test_pages_as_table(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>y"), (2, None)], "page_id bigint, html string")
    assert {r.page_id: r.text for r in page_texts(pages).collect()} == {1: "x\ny", 2: None}


def test_listing(spark, tmp_path):
    rows = [{"id": "1", "name": "a.TXT", "mimeType": "text/plain", "owners": [
                {"emailAddress": "x@y.z"}, {"emailAddress": "q"}], "trashed": True},
            {"id": "2", "name": "b", "mimeType": "video/new", "owners": []},
            {"id": "3", "name": "c", "mimeType": "application/zip"},
            {"id": "4", "name": "d.tar.GZ", "mimeType": "video/odd", "owners": [{}]}]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in rows))
    listing = registry.with_file_type(read_listing(spark, str(tmp_path / "l.json")))
    got = {r.file_id: (r.owner, r.deleted, r.extension) for r in listing.collect()}
    assert got == {"1": ("x@y.z", True, ".txt"), "2": ("admin@admin.com", False, ""),
                   "4": (None, False, ".gz")}


def test_media_answers(spark):
    video = json.dumps({"response": {"annotationResults": [
        {"speechTranscriptions": [{"alternatives": [{"transcript": " hi "}, {"transcript": "no"}]},
                                  {"alternatives": []}, {}],
         "textAnnotations": [{"text": "sign"}, {"text": " "}]},
        {"textAnnotations": [{"text": "hi"}, {"text": "end"}]}, {}]}})
    df = spark.createDataFrame([(video,), ("{}",), ("junk",)], "a string")
    assert [r.t for r in df.select(media.video_text(F.col("a")).alias("t")).collect()] == [
        "hi\n\nsign\n\nend", "", ""]
    images = [({"fullTextAnnotation": {"text": "full"}, "textAnnotations": [{"description": "x"}]},
               "full"), ({"textAnnotations": [{"description": "first"}, {"description": "n"}]},
                         "first"), ({"fullTextAnnotation": {"text": ""}}, ""), ({}, "")]
    df = spark.createDataFrame([(json.dumps(a),) for a, _ in images], "a string")
    assert [r.t for r in df.select(media.image_text(F.col("a")).alias("t")).collect()] == [
        w for _, w in images]
    pages = spark.createDataFrame([("f", n, json.dumps({"fullTextAnnotation": {"text": t}}))
                                   for n, t in ((2, " two "), (1, "one"), (3, " "))],
                                  "file_id string, page_no int, answer string")
    files = spark.createDataFrame(
        [("f", "application/pdf", "  short "), ("g", "application/pdf", None),
         ("h", "text/plain", "s"), ("i", "application/pdf", "x" * 80)],
        "file_id string, mime_type string, text string")
    got = {r.file_id: r.text for r in media.choose_text(files, media.pdf_page_texts(pages)).collect()}
    assert got == {"f": "one\n\ntwo", "g": "", "h": "s", "i": "x" * 80}


def _users(spark):
    return spark.createDataFrame(
        [("e2", "Bob Stone", "b", "employee"), ("e1", "Ann Miller", "a", "employee"),
         ("steward_comp", "Comp", "c", "admin")], "id string, name string, email string, role string")


def _empty(spark):
    sf = "/root/testdata/sf0.001"
    assert FILES and FINDINGS
    findings = relation(spark, sf, "findings").limit(0).withColumn(
        "gdpr_articles", F.array().cast("array<string>"))
    return relation(spark, sf, "files").limit(0), findings


def test_full_then_delta_scan(spark, tmp_path):
    root = tmp_path / "drive"
    root.mkdir()
    (root / "expense_1.txt").write_text("Name: Bob Stone\nEmail: bob@x.com")
    (root / "training_2.txt").write_text("Name: Unknown Person")
    (root / "incident_3.txt").write_text("nothing")
    (root / "supplier_4.docx").write_text("broken")
    for f in root.iterdir():
        os.utime(f, (1000, 1000))
    users = _users(spark)
    first = scan.scan_folder(spark, str(root), *_empty(spark), users, "r1", 5000, 5010)
    run = first.run.first()
    assert (run.files_scanned, run.files_flagged, run.files_skipped) == (3, 2, 0)
    files = {os.path.basename(r.path): r for r in first.files.collect()}
    assert files["expense_1.txt"].owner_user_id == "e2"
    assert files["training_2.txt"].owner_user_id == "e1"
    assert files["incident_3.txt"].master_of_data_user_id == "steward_comp"
    assert files["incident_3.txt"].last_scanned_at == 5010

    reviewed = first.findings.withColumn("status", F.when(
        F.col("category") == "email", "keep").otherwise(F.col("status")))
    (root / "expense_1.txt").write_text("Name: Bob Stone\nEmail: bob@x.com\nFax: 123")
    os.utime(root / "expense_1.txt", (6000, 6000))
    second = scan.scan_folder(spark, str(root), first.files, reviewed, users, "r2", 7000, 7010,
                              "delta")
    run = second.run.first()
    assert (run.files_scanned, run.files_skipped, run.type) == (1, 2, "delta")
    status = {(r.category, r.snippet): r.status for r in second.findings.collect()}
    assert status == {("name", "Bob Stone"): "open", ("email", "bob@x.com"): "keep",
                      ("fax", "123"): "open", ("name", "Unknown Person"): "open"}
    third = scan.scan_folder(spark, str(root), second.files, second.findings, users, "r3", 8000,
                             8010, "delta")
    assert third.run.first().files_scanned == 0
    assert sorted(third.findings.collect()) == sorted(second.findings.collect())


def test_upsert_is_idempotent_and_keeps_insert_only_columns(spark):
    known = spark.createDataFrame(
        [("1", "old", "text/plain", "o", None, False, None, "flagged", "regex", "email", "keep")],
        "file_id string, name string, mime_type string, owner string, google_created_at timestamp,"
        "is_deleted boolean, last_seen_at timestamp, status_flag string, detection_stage string,"
        "pii_category string, user_action string")
    listing = spark.sql("""SELECT * FROM VALUES
        ('1', 'new', 'text/csv', TIMESTAMP '2024-01-01', CAST(NULL AS STRING), true),
        ('2', 'b', 'text/csv', TIMESTAMP '2024-01-02', 'p', false)
        AS t(file_id, name, mime_type, modified_time, owner, deleted)""")
    now = F.timestamp_seconds(F.lit(99))
    once = registry.upsert_listing(known, listing, now)
    rows = {r.file_id: r for r in once.collect()}
    assert (rows["1"].name, rows["1"].owner, rows["1"].is_deleted) == ("new", None, True)
    assert (rows["1"].google_created_at, rows["1"].status_flag, rows["1"].user_action) == (
        None, "flagged", "keep")
    assert rows["2"].google_created_at is not None and rows["2"].status_flag is None
    twice = registry.upsert_listing(once, listing, now)
    assert sorted(twice.collect(), key=str) == sorted(once.collect(), key=str)
    assert [r.file_id for r in registry.unchecked_files(once, listing).collect()] == ["2"]


def test_reports_and_snapshots(spark, tmp_path):
    known = relation(spark, "/root/testdata/sf0.001", "registry")
    for second in (1, 2):
        scan.append_snapshot(known, str(tmp_path / "h"), None, F.timestamp_seconds(F.lit(second)))
    history = spark.read.parquet(str(tmp_path / "h" / "snapshots"))
    assert history.count() == 2 and history.first().run_label == "manual"
    assert str(history.schema["percentage_files_flagged"].dataType) == "DecimalType(7,2)"
    scan.write_report(known.select("file_id"), history.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "per_file")).count() == known.count()


def test_scanner_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    lines = [json.dumps({"file_id": "a", "name": "n", "text": "mail a@b.cc"}),
             json.dumps({"file_id": "b", "text": "clean"}), "garbage",
             json.dumps({"file_id": "c"}), json.dumps({"file_id": "zz", "text": "x@y.zz"})]
    (inbox / "1.json").write_text("\n".join(lines))

    def run():
        stream = consumers.message_stream(spark, str(inbox), 1)
        consumers.start_scanner(stream, out, str(tmp_path / "cp")).awaitTermination()

    run()
    # The same file is delivered again, now clean.
    (inbox / "2.json").write_text(json.dumps({"file_id": "a", "name": "n", "text": "clean"}))
    run()
    run()
    status = consumers.read_status(spark, out)
    assert sorted((r.file_id, r.name, r.status_flag, r.pii_category, r.batch_id)
                  for r in status.collect()) == [
        ("a", "n", "flagged", "email", 0), ("a", "n", "not_flagged", None, 1),
        ("b", "b", "not_flagged", None, 0), ("zz", "zz", "flagged", "email", 0)]
    bad = spark.read.option("recursiveFileLookup", "true").text(f"{out}/bad")
    assert sorted(r.value for r in bad.collect()) == sorted(["garbage", lines[3]])
    known = spark.createDataFrame(
        [(i,) + (None,) * 10 for i in ("a", "b", "d")],
        ", ".join(f"{c} string" for c in registry.REGISTRY_COLUMNS))
    rows = {r.file_id: (r.status_flag, r.pii_category)
            for r in consumers.current_registry(known, status, F.lit("now")).collect()}
    assert rows == {"a": ("not_flagged", None), "b": ("not_flagged", None), "d": (None, None)}


def test_extraction_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    good = json.dumps({"file_id": "a", "name": "n", "mime_type": "text/plain"})
    lost = json.dumps({"file_id": "b", "name": "n", "mime_type": "text/plain"})
    (inbox / "1.json").write_text("\n".join([good, lost, "garbage"]))
    contents = spark.createDataFrame([("a", "hello")], "file_id string, text string")
    stream = consumers.message_stream(spark, str(inbox))
    consumers.start_extraction(stream, lambda m: m.join(contents, "file_id", "left"), out,
                               str(tmp_path / "cp")).awaitTermination()
    read = spark.read.option("recursiveFileLookup", "true")
    assert [json.loads(r.value) for r in read.text(f"{out}/text").collect()] == [
        {"file_id": "a", "name": "n", "text": "hello"}]
    assert sorted(r.value for r in read.text(f"{out}/bad").collect()) == sorted([lost, "garbage"])


def test_small_rows_of_large_texts_are_dealt_for_all_tasks(spark):
    setting = spark.conf.get("spark.sievemark.partitions")
    spark.conf.unset("spark.sievemark.partitions")
    try:
        forms = relation(spark, "/root/testdata/sf0.001", "forms")
        assert forms.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert ordering.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sievemark.partitions", setting)


def test_a_report_takes_rows_and_summary_from_one_scan(spark, monkeypatch):
    given = []
    monkeypatch.setattr(changes.scan, "write_report", lambda rows, summary, folder: given.append(rows))
    changes._report(spark, "/root/testdata/sf0.001")
    assert all("judged-" in path for path in given[0].inputFiles())


def test_contents_leave_a_batch_one_by_one():
    taken = []

    class Column(list):
        def __getitem__(self, i):
            taken.append(i)
            return pa.scalar(list.__getitem__(self, i))

    class Batch:
        num_rows = 3
        columns = [Column(["a.csv", "b.csv", "c.docx"]), Column([".csv", ".csv", ".docx"]), Column([b"x,1\n", b"y" * 20_000_000, b"?"])]

    made = source_files._parse_contents(iter([Batch()]))
    first = next(made)
    assert first.num_rows == 2 and max(taken) == 1  # the third is not touched before the first two have left
    rest = next(made)
    assert first.column(1)[0].as_py() == "x\t1" and rest.column(1)[0].as_py() is None and rest.column(2)[0].as_py()
