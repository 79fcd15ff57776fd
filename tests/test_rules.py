import pytest

from pyspark.sql import functions as F
from sievemark.functions.rules import DETECTORS, explode_findings, with_document_findings
from sievemark.functions.spans import Span, resolved, with_form_findings
from tests import plain
from workload.derived import relation, table

SF = "/root/testdata/sf0.001"

#: Category, values that must be found, values that must not; each is tried inside several sentences.
VALUES = {
    "email": (["kim.o-neill%x@sub.firm-9.museum", "q_1@a.io"], ["kim@", "@firm.io", "kim@firm"]),
    "ip_address": (["10.20.30.40", "fe80:1:2:3:4:5:6:7"], ["300.1.1.1", "7.8.9", "1.2.3.4567"]),
    "credit_card": (["4929 0000 1111 2222", "5105-1051-0510-5100", "378282246310005"], ["4929 0000 11", "9999 0000 1111 2222"]),
    "iban": (["AT611904300234573201", "CH9300762011623852957"], ["AT6119043", "at611904300234573201"]),
    "ssn": (["219-09-9999", "457 55 5462"], ["000-09-9999", "666-09-9999", "931-09-9999", "21909-9999"]),
}
LABELLED = {
    "fax": ["Fax number: 0800 77 88", "TELEFAX - 22 33 44"],
    "phone": ["Cell: 0660/998877", "Telefon - 99 88 77 66"],
    "username": ["User ID: zoe77", "account - root2", "(K-445566)"],
    "signature": ["Signed by: Q. Tester", "signature block - /s/ Q"],
    "passport": ["Passport number P7654321X", "reisepass: L0001"],
    "drivers_license": ["driver's licence number B-072", "Führerschein: N0704"],
    "id_card": ["VAT ID: U12345678", "Personalausweis T220"],
    "date_of_birth": ["dob 7.8.69", "Birthdate: 2001-12-24"],
}
FRAMES = ("{}", "see {} today", "a line\n{}\nanother line", "({})")


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def test_values_are_found_in_any_frame_and_lookalikes_are_not(spark):
    cases = [(frame.format(value), category, found) for category, lists in VALUES.items()
             for found, values in zip((True, False), lists, strict=True) for value in values for frame in FRAMES]
    cases += [(f"{lead}{value}\nend", category, True) for category, values in LABELLED.items()
              for value in values for lead in ("", "intro\n")]
    rows = with_document_findings(_texts(spark, [c[0] for c in cases])).orderBy("i").collect()
    for (text, category, found), row in zip(cases, rows, strict=True):
        assert (category in {f.category for f in row.findings}) == found, (text, category)


def _same_as_plain(df):
    scanned = with_form_findings(with_document_findings(df, out="a"), out="raw", resolve=False)
    rows = with_form_findings(scanned, out="b").collect()
    for row in rows:
        assert [tuple(f) for f in row.a] == plain.document_findings(row.text), row.text
        assert [tuple(f)[:5] for f in row.raw] == plain.form_spans(row.text), row.text
        _well_resolved([Span(*tuple(f)[:5]) for f in row.raw], [Span(*tuple(f)[:5]) for f in row.b])
    return rows


def _overlap(a, b):
    return a.category == b.category and a.start < b.end and b.start < a.end


def _well_resolved(found, kept):
    """What overlap resolution promises, whatever way it takes."""
    assert kept == sorted(kept, key=lambda s: (s.start, s.category)) and set(kept) <= set(found)
    for i, span in enumerate(kept):
        assert not any(_overlap(span, other) for other in kept[i + 1:] if other.start >= span.start
                       and other.start < span.end)
    for span in set(found) - set(kept):
        # Dropped in favour of a span it overlaps that starts no later or is surer.
        assert any(_overlap(span, other) and (other.start <= span.start or other.confidence > span.confidence)
                   for other in found if other != span)
    for span in found:
        if not any(_overlap(span, other) for other in found if other != span):
            assert span in kept


def test_tricky_texts_match_plain_patterns(spark):
    _same_as_plain(_texts(spark, plain.TRICKY))


def test_given_texts_match_plain_patterns(spark):
    texts = table(spark, SF, "documents").select("text").unionByName(
        table(spark, SF, "conversations").select("text")).unionByName(
        table(spark, SF, "pages").select(F.col("html").alias("text"))).unionByName(
        relation(spark, SF, "forms").select("text"))
    assert len(_same_as_plain(texts)) == texts.count()


def test_null_text_has_no_findings(spark):
    row = with_form_findings(with_document_findings(_texts(spark, [None]), out="a"), out="b").first()
    assert row.a == [] and row.b == []


def test_detectors_can_be_switched_off(spark):
    text = "Email: john@smith.com\nSSN: 123-45-6789\nPhone: +1 555-123-4567\nhost 192.168.1.1"
    df = _texts(spark, [text])
    only = with_document_findings(df, detectors=["emails"])
    assert [f.category for f in only.first().findings] == ["email"]
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert "_raw1" not in plan
    assert with_document_findings(df, detectors=[]).first().findings == []
    for name in DETECTORS:
        rest = with_document_findings(df, detectors=[d for d in DETECTORS if d != name])
        gone = {"emails": "email", "ssn": "ssn", "ip_addresses": "ip_address",
                "phones": "phone"}.get(name)
        assert gone not in {f.category for f in rest.first().findings}
    with pytest.raises(ValueError):
        with_document_findings(df, detectors=["names"])


def test_repeated_values_are_kept_once_in_order(spark):
    text = "Email: user@x.com\nContact: user@x.com\nPhone: 0171-234-5678\ncall 0171-234-5678"
    found = with_document_findings(_texts(spark, [text])).first().findings
    assert [(f.category, f.snippet) for f in found] == [
        ("email", "user@x.com"), ("phone", "0171-234-5678")]
    assert "telefon" in found[1].pattern


def test_patterns_run_once_when_findings_are_filtered(spark):
    found = with_document_findings(_texts(spark, ["a@b.cc"]))
    plan = explode_findings(found.filter(F.size("findings") > 0), ["i"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("\\.[A-Za-z]{2,}, 0)") == 1


@pytest.mark.parametrize("found,kept", [
    ([("a", 0, 5, .7), ("a", 3, 8, .7)], [0]),  # as sure: the first stays
    ([("a", 0, 5, .7), ("a", 3, 8, .9)], [1]),  # surer: it replaces
    ([("a", 0, 5, .7), ("b", 3, 8, .9)], [0, 1]),  # other category: both
    ([("a", 0, 5, .7), ("a", 5, 8, .7)], [0, 1]),  # they only touch
    ([("a", 0, 9, .7), ("a", 2, 4, .9), ("a", 5, 8, .7)], [1, 2]),  # the end of the surer one counts
    ([("a", 4, 6, .8), ("a", 4, 9, .9)], [1]),  # same start: the surer first
    ([("a", 4, 6, .8), ("a", 4, 9, .8)], [0]),  # same start, as sure: as found
    ([], []),
])
def test_overlap_resolution_by_hand(found, kept):
    spans = [Span(c, s, e, "x", p) for c, s, e, p in found]
    assert resolved(spans) == [spans[i] for i in kept]


def test_overlap_resolution_keeps_its_promises():
    random = __import__("random").Random(7)
    for _ in range(500):
        spans = [Span(random.choice("ab"), start := random.randrange(20), start + random.randrange(1, 8), str(i),
                      random.choice([0.7, 0.8, 0.9])) for i in range(random.randrange(9))]
        _well_resolved(spans, resolved(spans))


def test_many_matches_take_linear_time(spark):
    import time
    seconds = []
    for n in (20_000, 80_000):
        df = _texts(spark, ["\n".join(f"user{i}@mail.org" for i in range(n)) + "\n" + "q" * 200_000])
        started = time.perf_counter()
        assert len(with_form_findings(df).first().findings) == n
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 8 * seconds[0] + 2
