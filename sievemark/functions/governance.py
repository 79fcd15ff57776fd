"""Governance scalars: risk priority, legal articles, labels, bands, masks, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark import fixed_values as V


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def priority(category: Column) -> Column:
    return _lookup(category, {k: v[2] for k, v in V.CATEGORIES.items()}, F.lit("low"))


def priority_rank(level: Column) -> Column:
    """0 high, 1 medium, 2 low."""
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def priority_name(rank: Column) -> Column:
    return F.when(rank == 0, "high").when(rank == 1, "medium").otherwise("low")


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def articles(category: Column) -> Column:
    return (
        F.when(priority(category) == "high", _words(V.ARTICLES_HIGH))
        .when(category.isin(*V.CONTACT_CATEGORIES), _words(V.ARTICLES_CONTACT))
        .otherwise(_words(V.ARTICLES_ALL)))


def label(category: Column) -> Column:
    return _lookup(category, {k: v[0] for k, v in V.CATEGORIES.items()}, category)


def icon(category: Column) -> Column:
    return _lookup(category, {k: v[1] for k, v in V.CATEGORIES.items()}, F.lit(V.DEFAULT_ICON))


def reason(category: Column) -> Column:
    return _lookup(category, {k: v[4] for k, v in V.CATEGORIES.items()}, F.lit(""))


def pretty_label(category: Column) -> Column:
    """The label, or an unknown key with spaces and each word capitalised."""
    table = {k: v[0] for k, v in V.CATEGORIES.items()}
    spaced = F.regexp_replace(category, "_", " ")
    # Only first letters change; the rest of an unknown key stays as it is.
    words = F.transform(F.split(spaced, r"\b(?=\w)"), lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return _lookup(category, table, F.array_join(words, ""))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "likely").when(confidence >= 0.5, "possible").otherwise("low")


def confidence_percent(confidence: Column, rounded: bool = False) -> Column:
    """Whole percent: cut off as in the review list, or rounded as in the browser."""
    scaled = confidence * 100
    return (F.floor(scaled + 0.5) if rounded else F.floor(scaled)).cast("int")


def mask(snippet: Column) -> Column:
    """Hide every token of three or more characters behind its first one and up to six dots."""
    token = r"[A-Za-z0-9][A-Za-z0-9.@+/_-]{2,}"
    tokens = F.regexp_extract_all(snippet, F.lit(token), F.lit(0))
    gaps = F.split(snippet, token, -1)
    hidden = F.transform(tokens, lambda t: F.when(F.length(t) <= 3, t).otherwise(F.concat(
        F.substring(t, 1, 1),
        F.repeat(F.lit("•"), F.least(F.length(t) - 1, F.lit(6))))))
    return F.array_join(F.zip_with(
        gaps, hidden, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def percent(value: Column, total: Column) -> Column:
    return F.when(total > 0, value / total * 100).otherwise(F.lit(0.0))


def grouped_int(value: Column) -> Column:
    """Thousands-grouped whole number, halves rounded up."""
    return F.format_number(F.floor(value + 0.5), 0)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def file_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def finding_id(file: Column, category: Column, start: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file, category, start), 256), 1, 16)


def to_epoch(value: Column) -> Column:
    """Seconds since 1970 of a timestamp or ISO text; missing or unreadable becomes 0."""
    return F.coalesce(F.unix_micros(value.try_cast("timestamp")) / 1e6, F.lit(0.0))


def is_past_retention(modified: Column, now: float, years: int = V.RETENTION_YEARS) -> Column:
    return (F.lit(float(now)) - modified) > F.lit(years * V.SECONDS_PER_YEAR)
