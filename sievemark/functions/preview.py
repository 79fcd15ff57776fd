"""Texts shown to reviewers: highlighted preview, explanation, prompt."""

from __future__ import annotations

import bisect
import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.governance import confidence_percent, label

_MARKS = "array<struct<start:int,end:int,category:string>>"
#: Up to so many snippets are looked for one by one, more by one automaton.
FEW = 12


def _occurrences(text: str, snippets: set[str]) -> dict[str, list[int]]:
    """Where each snippet starts, ascending; many snippets are found in one walk over the text."""
    found: dict[str, list[int]] = {snippet: [] for snippet in snippets}
    if len(snippets) > FEW:
        machine = ahocorasick.Automaton()
        for snippet in snippets:
            machine.add_word(snippet, snippet)
        machine.make_automaton()
        for end, snippet in machine.iter(text):
            found[snippet].append(end - len(snippet) + 1)
        return found
    for snippet, starts in found.items():
        at = text.find(snippet)
        while at >= 0:
            starts.append(at)
            at = text.find(snippet, at + 1)
    return found


def _place(text: str, findings: list[dict]) -> list[tuple[int, int, str]]:
    """Non-overlapping marks (start, end, category), one per finding whose snippet still has a free occurrence.

    Marks are kept sorted, so a clash is found by bisection; a repeated snippet goes on where its
    last search ended.
    """
    wanted = [((f["snippet"] or "").strip(), f["category"]) for f in findings]
    places = _occurrences(text, {snippet for snippet, _ in wanted if len(snippet) > 1})
    reached = dict.fromkeys(places, 0)
    starts: list[int] = []
    placed: dict[int, tuple[int, str]] = {}
    for snippet, category in wanted:
        if len(snippet) < 2:
            continue
        here, size = places[snippet], len(snippet)
        n = reached[snippet]
        while n < len(here):
            i = bisect.bisect_left(starts, here[n] + size)
            if not i or placed[starts[i - 1]][0] <= here[n]:
                break
            n = bisect.bisect_left(here, placed[starts[i - 1]][0], n + 1)
        if n < len(here):
            bisect.insort(starts, here[n])
            placed[here[n]] = (here[n] + size, category)
            n = bisect.bisect_left(here, here[n] + size, n + 1)
        reached[snippet] = n
    return [(s, *placed[s]) for s in starts]


def _placed(texts: pa.Array, findings: pa.Array) -> pa.Array:
    rows = [[{"start": start + 1, "end": end + 1, "category": category}
             for start, end, category in _place(t.as_py() or "", f.as_py() or [])]
            for t, f in zip(texts, findings, strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string())])))


def _wanted(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.struct(f["snippet"].alias("snippet"), f["category"].alias("category")))


def marks(text: Column, findings: Column) -> Column:
    """Marks (1-based, end exclusive) of the findings in a text, ordered by start."""
    return F.arrow_udf(_placed, _MARKS)(text, _wanted(findings))


def _escaped(text: str) -> str:
    return reduce(lambda t, pair: t.replace(*pair), V.HTML_ESCAPES, text)


def _marked(text: str, findings: list[dict]) -> str:
    pieces, reached = [], 0
    for start, end, category in _place(text, findings):
        pieces += [_escaped(text[reached:start]), f'<mark data-category="{category}">', _escaped(text[start:end]), "</mark>"]
        reached = end
    return "".join([*pieces, _escaped(text[reached:])])


def _previews(texts: pa.Array, findings: pa.Array) -> pa.Array:
    return pa.array([None if t.as_py() is None else _marked(t.as_py(), f.as_py() or [])
                     for t, f in zip(texts, findings, strict=True)], pa.string())


def with_preview(df: DataFrame, text: str = "text", findings: str = "findings",
                 out: str = "preview") -> DataFrame:
    """Add the escaped text with every marked snippet named by its category.

    Marks are placed and the text is spliced in one Arrow pass, in time linear in text and findings.
    """
    return df.withColumn(out, F.arrow_udf(_previews, "string")(F.col(text), _wanted(F.col(findings))))


def _cut_out(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text without its spans (sorted); ``until`` is the furthest end so far."""
    pieces, until = [], 0
    for start, end, category in spans:
        if start >= until:
            pieces += [text[until:start], f"[{category}]"]
        until = max(until, end)
    return "".join([*pieces, text[until:]])


def _redacted(texts: pa.Array, findings: pa.Array) -> pa.Array:
    return pa.array([None if t is None or f is None else _cut_out(t, sorted((s["start"], s["end"], s["category"]) for s in f))
                     for t, f in zip(texts.to_pylist(), findings.to_pylist(), strict=True)], pa.string())


def redacted(text: Column, findings: Column) -> Column:
    """The text with every finding (offsets from 0) replaced by its category in brackets.

    Where findings of different categories overlap, the first that starts is shown and the stretch
    up to the last end is taken out. One pass per text, in time linear in text and findings.
    """
    spans = F.transform(findings, lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["category"].alias("category")))
    return F.arrow_udf(_redacted, "string")(text, spans)


def explanation(name: Column, findings: Column) -> Column:
    """Why a flagged file was flagged, in fixed wording."""
    types = F.transform(F.array_distinct(F.transform(findings, lambda f: label(f["category"]))),
                        F.lower)
    n = F.size(types)
    listed = F.when(n == 1, F.element_at(types, 1)).otherwise(F.concat(
        F.array_join(F.slice(types, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
        F.lit(" and "), F.try_element_at(types, F.lit(-1))))
    laws = F.sort_array(F.array_distinct(F.flatten(
        F.transform(findings, lambda f: f["gdpr_articles"]))))
    values = {
        "{name}": name, "{n}": F.size(findings).cast("string"),
        "{items}": F.when(F.size(findings) == 1, "item").otherwise("items"), "{types}": listed,
    }
    # The places are cut out of the wording, so braces in a value stay as they are.
    pieces = re.split(r"(\{\w+\})", V.EXPLAIN_FLAGGED)
    first = F.concat(*[values.get(piece, F.lit(piece)) for piece in pieces])
    duty = F.replace(F.lit(V.EXPLAIN_DUTY), F.lit("{articles}"), F.array_join(laws, ", "))
    return F.concat(first, duty, F.lit(V.EXPLAIN_REVIEW))


def prompt(name: Column, source_type: Column, findings: Column, excerpt: Column) -> Column:
    """The request text for a language model that explains a flagged file, for one window of its text."""
    lines = F.array_join(F.transform(findings, lambda f: F.concat(
        F.lit("- "), label(f["category"]), F.lit(" ("),
        confidence_percent(f["confidence"], rounded=True).cast("string"),
        F.lit('% confidence): "'), f["snippet"], F.lit('"'))), "\n")
    return F.concat_ws(
        "\n", *[F.lit(line) for line in V.PROMPT_HEAD], F.concat(F.lit("File name: "), name),
        F.concat(F.lit("Source: "), source_type), F.lit(""), F.lit("Detected personal data:"),
        lines, F.lit(""), F.lit("File excerpt:"), F.concat(F.lit('"""'), excerpt, F.lit('"""')), F.lit(""),
        F.lit("Explanation:"))
