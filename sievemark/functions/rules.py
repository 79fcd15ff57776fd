"""Document rules: ten detector switches, fourteen categories, exact duplicates dropped.

One text column becomes one array of findings with built-in regex and array functions, so the
scan stays a narrow map over the text table: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.strings import (
    computed_once, contains_any, digits_in, has_digit, has_odd_letters, is_ascii, is_blank,
    is_usable, java_email, jvm_of, strip, to_java,
)

FINDING = "struct<category:string,snippet:string,pattern:string,source:string>"


@dataclass(frozen=True)
class Rule:
    detector: str
    category: str
    pattern: str
    hints: tuple[str, ...] = ()
    shape: str = ""
    first: str = ""
    keep: Callable[[Column], Column] | None = None

    @property
    def group(self) -> int:
        return 1 if "(?P<val>" in self.pattern else 0

    def java(self, ascii_only: bool) -> str:
        if self.category == "email":
            return java_email(self.pattern)
        return to_java(self.pattern, self.first, ascii_only=ascii_only)


def _line(labels: str) -> str:
    return V.LINE_VALUE.format(labels=labels)


def _id(labels: str) -> str:
    return V.ID_VALUE.replace("{labels}", labels).replace("{token}", V.ID_TOKEN_DOCUMENT)


# The order is part of the meaning: it numbers the findings, and the first one of a text
# without confidences names its category. ``hints`` and ``shape`` are necessary conditions,
# checked first because they cost far less than the pattern, most of all where they begin with a fixed
# character; ``first`` holds the characters that
# can start a match.
RULES = (
    Rule("emails", "email", V.EMAIL, hints=("@",)),
    Rule("phones", "fax", _line(V.FAX_LABELS), hints=("fax",), first="ft", keep=has_digit),
    Rule("phones", "phone", _line(V.PHONE_LABELS),
         hints=("phone", "tel", "mobil", "cell"), first="ptmc", keep=has_digit),
    Rule("phones", "phone", V.PHONE_FREE, shape=r"(?U)\d\d[^\p{L}]{0,3}\d\d", first=r"+(\d",
         keep=lambda s: digits_in(s) >= V.PHONE_MIN_DIGITS),
    Rule("usernames", "username", _line(V.USERNAME_LABELS),
         hints=("user", "login", "account"), first="ula"),
    Rule("usernames", "username", V.EMPLOYEE_ID, shape=r"(?U)[A-Z]-\d\d\d\d", first="A-Z"),
    Rule("signatures", "signature", _line(V.SIGNATURE_LABELS_DOCUMENT),
         hints=("signature", "signed", "unterschrift"), first="su"),
    Rule("id_documents", "passport", _id(V.PASSPORT_LABELS), hints=("passport", "reisepass"), first="pr",
         keep=has_digit),
    Rule("id_documents", "drivers_license", _id(V.LICENSE_LABELS), hints=("driver", "hrerschein"), first="df",
         keep=has_digit),
    Rule("id_documents", "id_card", _id(V.ID_CARD_LABELS),
         hints=("card", "ausweis", "tax", "vat"), first="ipatv", keep=has_digit),
    Rule("ip_addresses", "ip_address", V.IPV4, shape=r"(?U)\.\d{1,3}\.\d{1,3}\.\d", first=r"\d"),
    Rule("ip_addresses", "ip_address", V.IPV6, shape=r":(?::|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:)"),
    Rule("credit_cards", "credit_card", V.CREDIT_CARD, shape=r"(?U)\d{4}[\s\x1c-\x1f\-]?\d{4}",
         first="3-6",
         keep=lambda s: digits_in(s).isin(*V.CARD_DIGIT_COUNTS)),
    Rule("iban", "iban", V.IBAN, shape=r"(?U)[A-Z]{2}\d{2}[A-Z0-9]{11}", first="A-Z",
         keep=lambda s: F.length(s) >= V.IBAN_MIN_CHARS),
    Rule("ssn", "ssn", V.SSN, shape=r"(?U)\d{3}[\s\x1c-\x1f\-]\d{2}[\s\x1c-\x1f\-]\d{4}",
         first=r"\d"),
    Rule("dob", "date_of_birth", V.DATE_OF_BIRTH, hints=("dob", "birth", "born", "geburtsdatum"), first="dbg"),
)
DETECTORS = tuple(dict.fromkeys(rule.detector for rule in RULES))


def _snippets(rule: Rule, text: Column, low: Column, odd: Column) -> Column:
    def matches(ascii_only: bool) -> Column:
        return F.regexp_extract_all(text, F.lit(rule.java(ascii_only)), F.lit(rule.group))

    found = F.when(F.col("_ascii"), matches(True)).otherwise(matches(False))
    if rule.keep is not None:
        found = F.filter(found, rule.keep)
    found = F.filter(F.transform(found, strip), is_usable)
    if rule.hints:
        possible = contains_any(low, rule.hints) | odd
    else:
        possible = text.rlike(rule.shape)
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def _as_finding(rule: Rule) -> Callable[[Column], Column]:
    return lambda snippet: F.struct(
        F.lit(rule.category).alias("category"), snippet.alias("snippet"),
        F.lit(rule.pattern).alias("pattern"), F.lit("regex").alias("source"))


@lru_cache(maxsize=64)
def _columns(text: str, chosen: tuple[str, ...], jvm: object) -> tuple[dict[str, Column], Column]:
    """Per-rule snippet arrays and the final list; kept, because building them is not free."""
    rules = [rule for rule in RULES if rule.detector in chosen]
    raw = {f"_raw{i}": _snippets(rule, F.col(text), F.col("_low"), F.col("_odd"))
           for i, rule in enumerate(rules)}
    parts, earlier = [], {}
    for i, rule in enumerate(rules):
        snippets = F.array_distinct(F.col(f"_raw{i}"))
        for j in earlier.get(rule.category, ()):
            snippets = F.array_except(snippets, F.col(f"_raw{j}"))
        earlier.setdefault(rule.category, []).append(i)
        parts.append(F.transform(snippets, _as_finding(rule)))
    empty = F.array().cast(f"array<{FINDING}>")
    if not parts:
        return {}, empty
    return raw, F.when(is_blank(F.col(text)), empty).otherwise(F.concat(*parts))


def with_document_findings(
    df: DataFrame, text: str = "text", detectors: Iterable[str] | None = None,
    out: str = "findings",
) -> DataFrame:
    """Add the ordered findings of every text; switched-off detectors are not in the plan."""
    chosen = set(DETECTORS if detectors is None else detectors)
    unknown = chosen - set(DETECTORS)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    raw, findings = _columns(text, tuple(sorted(chosen)), jvm_of(df))
    work = df.withColumns({"_low": F.lower(text), "_odd": has_odd_letters(F.col(text)),
                           "_ascii": is_ascii(F.col(text))})
    if raw:
        work = work.withColumns(raw)
    return computed_once(work.drop(out), out, findings).drop("_low", "_odd", "_ascii", *raw)


def explode_findings(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding; ``ord`` is its position in the text's list.

    The outer form keeps the optimizer from deriving a filter on the array, which would run
    every pattern a second time below the projection.
    """
    rows = df.select(*keys, F.posexplode_outer(findings).alias("ord", "_finding"))
    return rows.filter(F.col("ord").isNotNull()).select(*keys, "ord", "_finding.*")
