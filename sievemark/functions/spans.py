"""Form rules: thirteen categories with offsets, fixed confidences and overlap resolution.

Offsets of matches have no linear form in the built-in functions, so the rules run as one Arrow
function: each pattern walks a text once, and only where a word it needs occurs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.governance import articles
from sievemark.functions.strings import ODD_LETTERS, computed_once, linear_email

SPAN = "struct<category:string,start:int,end:int,snippet:string,confidence:double,detector:string>"
FORM_FINDING = SPAN[:-1] + ",gdpr_articles:array<string>>"
_ARROW_SPANS = pa.list_(pa.struct([
    ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("snippet", pa.string()),
    ("confidence", pa.float64()), ("detector", pa.string())]))


def _has_digit(value: str) -> bool:
    return any(c.isdecimal() for c in value)


def _is_person(value: str) -> bool:
    """Neither an address nor a number, and not made of role words only."""
    if "@" in value or _has_digit(value):
        return False
    return not {w.strip(".") for w in value.lower().split()} <= set(V.ROLE_WORDS)


@dataclass(frozen=True)
class FormRule:
    """A pattern with its category and confidence; ``hints``: words of which a match has one."""

    category: str
    pattern: str
    confidence: float
    hints: tuple[str, ...] = ()
    keep: Callable[[str], bool] | None = None


def _line(labels: str) -> str:
    return V.LINE_VALUE.format(labels=labels)


def _id(labels: str) -> str:
    return V.ID_VALUE.replace("{labels}", labels).replace("{token}", V.ID_TOKEN_FORM)


FORM_RULES = (
    FormRule("name", V.NAME.format(labels=V.NAME_LABELS), 0.95, keep=_is_person),
    FormRule("email", V.EMAIL, 0.98, hints=("@",)),
    FormRule("fax", _line(V.FAX_LABELS), 0.95, hints=("fax",), keep=_has_digit),
    FormRule("phone", _line(V.PHONE_LABELS), 0.95,
             hints=("phone", "tel", "mobil", "cell"), keep=_has_digit),
    FormRule("signature", _line(V.SIGNATURE_LABELS_FORM), 0.9,
             hints=("signature", "signed", "unterschrift")),
    FormRule("photo_video", V.PHOTO_VIDEO, 0.8,
             hints=("photo", "headshot", "profile", "picture", "image", "video",
                    ".jpg", ".jpeg", ".png", ".mp4", ".mov")),
    FormRule("passport", _id(V.PASSPORT_LABELS), 0.95, hints=("passport", "reisepass"), keep=_has_digit),
    FormRule("drivers_license", _id(V.LICENSE_LABELS), 0.95, hints=("driver", "hrerschein"), keep=_has_digit),
    FormRule("id_card", _id(V.ID_CARD_LABELS), 0.9,
             hints=("card", "ausweis", "tax", "vat"), keep=_has_digit),
    FormRule("username", _line(V.USERNAME_LABELS), 0.9, hints=("user", "login", "account")),
    FormRule("username", V.EMPLOYEE_ID, 0.85),
    FormRule("billing_shipping_address", _line(V.BILLING_LABELS), 0.9,
             hints=("billing", "shipping", "invoice", "delivery")),
    FormRule("home_address", _line(V.ADDRESS_LABELS), 0.88,
             hints=("address", "anschrift", "adresse", "residence")),
    FormRule("home_address", V.STREET, 0.7, hints=("str", "gasse", "weg", "allee", "platz")),
    FormRule("home_address", V.POSTAL, 0.7),
    FormRule("travel_history", V.TRAVEL, 0.7,
             hints=("trip", "way", "itinerary", "boarding", "flight", "travel", "->", "→")),
)


@dataclass(frozen=True)
class Span:
    category: str
    start: int
    end: int
    snippet: str
    confidence: float
    detector: str = "regex"


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[FormRule, re.Pattern, int | str]]:
    """Rules with their patterns and the group that holds the value."""
    made = []
    for rule in FORM_RULES:
        pattern = regex.compile(linear_email(rule.pattern)) if rule.category == "email" else re.compile(rule.pattern)
        made.append((rule, pattern, "val" if "val" in pattern.groupindex else 0))
    return made


def spans_in(text: str | None) -> Iterator[Span]:
    """All usable matches of all rules, rule by rule, each in the order of the text."""
    if not text or text.isspace():
        return
    low = text.lower()
    hidden = any(c in text for c in ODD_LETTERS)  # lower-casing may hide a label then
    for rule, pattern, group in _compiled():
        if rule.hints and not hidden and not any(h in low for h in rule.hints):
            continue
        for match in pattern.finditer(text):
            value = match[group]
            snippet = value.strip()
            if not 0 < len(snippet) <= V.MAX_SNIPPET_CHARS or not V.USABLE.search(snippet):
                continue
            if rule.keep is None or rule.keep(value):
                start, end = match.span(group)
                yield Span(rule.category, start, end, snippet, rule.confidence)


def resolved(spans: list[Span]) -> list[Span]:
    """One finding per stretch of text and category, ordered by start, then category.

    In the order of their starts (the surer first, then as found), a span is dropped if it begins
    inside the standing one of its category and is no surer, and replaces it if it is.
    """
    standing: dict[str, int] = {}
    kept: list[Span | None] = []
    for span in sorted(spans, key=lambda s: (s.start, -s.confidence)):
        place = standing.get(span.category)
        rival = kept[place] if place is not None else None
        if rival is not None and span.start < rival.end:
            if span.confidence <= rival.confidence:
                continue
            kept[place] = None
        standing[span.category] = len(kept)
        kept.append(span)
    return sorted((s for s in kept if s), key=lambda s: (s.start, s.category))


def _scanner(resolve: bool) -> Callable[[pa.Array], pa.Array]:
    def scan(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts:
            spans = list(spans_in(text.as_py()))
            found.append([vars(s) for s in (resolved(spans) if resolve and len(spans) > 1 else spans)])
        return pa.array(found, _ARROW_SPANS)

    return scan


def with_form_findings(df: DataFrame, text: str = "text", out: str = "findings",
                       resolve: bool = True) -> DataFrame:
    """Add the form findings of every text; ``resolve=False`` stops before overlap resolution."""
    scan = F.arrow_udf(_scanner(resolve), f"array<{SPAN}>")
    work = computed_once(df.withColumn("_spans", scan(F.col(text))), "_found", F.col("_spans")).drop("_spans")
    final = F.transform("_found", lambda f: f.withField("gdpr_articles", articles(f["category"])))
    return computed_once(work.drop(out), out, final).drop("_found")
