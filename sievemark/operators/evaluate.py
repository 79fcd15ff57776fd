"""Accuracy and latency reports."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.strings import base_name, suffix


def is_clean_name(path: Column) -> Column:
    return base_name(path).startswith(V.CLEAN_STEM_PREFIX)


def corpus_files(files: DataFrame) -> DataFrame:
    """Files of the evaluated types with their truth taken from the name."""
    name = base_name(F.col("path"))
    return files.filter(suffix(name).isin(*V.BENCHMARK_EXTENSIONS)).withColumn(
        "is_pii", ~is_clean_name(F.col("path")))


def sample_files(files: DataFrame, n: int, seed: int = 99) -> DataFrame:
    """``n`` files chosen by a seeded hash of the path, the same ones on every run."""
    return files.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "path"), 256), "path").limit(n)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def _scores(row: DataFrame, digits: int | None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    row = row.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    row = row.withColumn("f1", _ratio(2 * p * r, p + r))
    if digits is None:
        return row
    return row.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def file_confusion(results: DataFrame, detector: str) -> DataFrame:
    """File-level scores over (is_pii, n_findings, error); one pass, errors counted apart.

    The false positive rate divides by all clean files, also the failed ones.
    """
    ok, has = F.col("error").isNull(), F.coalesce(F.col("n_findings") > 0, F.lit(False))
    row = results.agg(
        F.count_if(ok).alias("files_processed"), F.count_if(~ok).alias("errors"),
        F.count_if(ok & F.col("is_pii") & has).alias("tp"),
        F.count_if(ok & ~F.col("is_pii") & has).alias("fp"),
        F.count_if(ok & F.col("is_pii") & ~has).alias("fn"),
        F.count_if(~F.col("is_pii")).alias("_clean"))
    row = row.withColumn("false_positive_rate", F.round(_ratio(F.col("fp"), F.col("_clean")), 4))
    return _scores(row, 4).drop("_clean").withColumn("detector", F.lit(detector))


def compare_detectors(variants: dict[str, DataFrame]) -> DataFrame:
    """File-level scores of several detector set-ups, one row each."""
    rows = [file_confusion(frame, name) for name, frame in variants.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def _matched(findings: list[dict], labels: list[dict]) -> tuple[int, int, int]:
    """Greedy matching inside one file with one automaton per category.

    An automaton names every expected text inside a snippet in one walk over the snippet; each expected text keeps its
    labels in order, so the first label left over is the smallest head among them.
    """
    left: dict[tuple[str, str], list[int]] = {}
    for place in range(len(labels) - 1, -1, -1):
        category, expected = labels[place]["category"], labels[place]["expected"]
        if category is not None and expected is not None:
            left.setdefault((category, expected), []).append(place)  # the first label is the last entry
    machines: dict[str, ahocorasick.Automaton] = {}
    for category, expected in left:
        if expected:
            machines.setdefault(category, ahocorasick.Automaton()).add_word(expected, expected)
    for machine in machines.values():
        machine.make_automaton()
    hits = 0
    for finding in findings:
        category, snippet = finding["category"], finding["snippet"]
        if category is None or snippet is None:
            continue
        inside = {""} | ({text for _, text in machines[category].iter(snippet)} if category in machines else set())
        heads = [(left[category, text][-1], text) for text in inside if left.get((category, text))]
        if heads:
            left[category, min(heads)[1]].pop()
            hits += 1
    return hits, len(findings) - hits, len(labels) - hits


def _match_rows(findings: pa.Array, labels: pa.Array) -> pa.Array:
    rows = [None if f is None or x is None else dict(zip(("tp", "fp", "fn"), _matched(f, x), strict=True))
            for f, x in zip(findings.to_pylist(), labels.to_pylist(), strict=True)]
    return pa.array(rows, pa.struct([("tp", pa.int32()), ("fp", pa.int32()), ("fn", pa.int32())]))


def match_labels(findings: Column, labels: Column) -> Column:
    """Greedy matching inside one file: a finding takes the first label left over of its category
    whose text it contains. Returns counts of hits, false alarms and misses."""
    said = F.transform(findings, lambda f: F.struct(f["category"].alias("category"), f["snippet"].alias("snippet")))
    wanted = F.transform(labels, lambda x: F.struct(x["category"].alias("category"), x["expected"].alias("expected")))
    return F.arrow_udf(_match_rows, "struct<tp:int,fp:int,fn:int>")(said, wanted)


def label_scores(files: DataFrame) -> DataFrame:
    """Instance-level scores over (findings, labels) rows, one row per labelled file."""
    matched = files.select(match_labels(F.col("findings"), F.col("labels")).alias("_m"),
                           F.size("labels").alias("_labels"))
    row = matched.agg(
        *[F.coalesce(F.sum(f"_m.{c}"), F.lit(0)).cast("bigint").alias(c)
          for c in ("tp", "fp", "fn")],
        F.count("*").alias("files"), F.coalesce(F.sum("_labels"), F.lit(0)).alias("labels"))
    return _scores(row, None)


#: Bits a pass of the selection decides, and passes for the 64 bits of a key.
_DIGIT, _PASSES = 16, 4


def order_key(value: Column) -> Column:
    """A long that orders doubles as the engine does: null, negative, zero, positive, infinite, NaN.

    Exponent and fraction are taken apart by exact scaling with powers of two, so no two values share a key. Numbers
    below the smallest normal one count as their multiples of the smallest double.
    """
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    size = F.when(odd, F.lit(1.0)).otherwise(F.abs(value))
    power = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    # The logarithm may round across a power of two.
    power = power + F.when(size / F.pow(F.lit(2.0), power) >= 2, 1).when(
        (size / F.pow(F.lit(2.0), power) < 1) & (power > -1022), -1).otherwise(0)
    fraction = size / F.pow(F.lit(2.0), power)
    normal = (power + 1023) * F.lit(1 << 52) + ((fraction - 1) * F.lit(float(1 << 52))).cast("long")
    small = (fraction * F.lit(float(1 << 52))).cast("long")
    bits = F.when(fraction >= 1, normal).otherwise(small).cast("long")
    bits = F.when(size == 0, F.lit(0)).when(F.abs(value) == float("inf"), F.lit(0x7FF0 << 48)).otherwise(bits)
    signed = F.when(value < 0, -bits).otherwise(bits)
    return F.when(value.isNull(), F.lit(-(1 << 63))).when(F.isnan(value), F.lit(0x7FF8 << 48)).otherwise(signed)


def at_positions(rows: DataFrame, column: str, positions: dict[str, int], counts: dict[int, int]) -> dict[str, float | None]:
    """The sorted elements at some positions (from 0), by refining a histogram of the order keys.

    ``counts`` is the histogram of the highest digit. Each further pass is one aggregate over the rows that
    still share their leading digits with a wanted position; at most 65 536 counts a position come back.
    """
    keyed = rows.select(order_key(F.col(column)).alias("_key"), F.col(column).alias("_value"))

    def refined(counts: dict[int, int], rest: int) -> tuple[int, int]:
        for prefix in sorted(counts):
            if rest < counts[prefix]:
                return prefix, rest
            rest -= counts[prefix]
        raise ValueError("position behind the last row")

    found = {name: refined(counts, at) for name, at in positions.items()}
    for level in range(1, _PASSES):
        shift = 64 - _DIGIT * (level + 1)
        prefix = F.shiftright("_key", shift + _DIGIT)
        row = keyed.where(prefix.isin([p for p, _ in found.values()])).groupBy(
            prefix.alias("prefix"), F.shiftright("_key", shift).alias("next")).agg(
            F.count("*").alias("n"), F.max("_value").alias("value")).collect()
        inside: dict[int, dict[int, int]] = {}
        for r in row:
            inside.setdefault(r["prefix"], {})[r["next"]] = r["n"]
        found = {name: refined(inside[p], rest) for name, (p, rest) in found.items()}
    values = {r["next"]: r["value"] for r in row}
    return {name: values[p] for name, (p, _) in found.items()}


def latency(times: DataFrame, column: str = "time_s") -> DataFrame:
    """Total, mean and exact percentiles (the sorted element at ``int(n * q)``).

    The elements are selected by four aggregates; nothing is sorted or written. The first of them also gives number and sum.
    """
    at = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    top = times.select(F.col(column).cast("double").alias(column))
    first = top.groupBy(F.shiftright(order_key(F.col(column)), 64 - _DIGIT).alias("prefix")).agg(
        F.count("*").alias("n"), F.sum(column).alias("sum")).collect()
    n = sum(r["n"] for r in first)
    total = float(sum(r["sum"] for r in sorted(first, key=lambda r: r["prefix"]) if r["sum"] is not None))
    values = at_positions(top, column, {name: int(n * q) for name, q in at.items()}, {r["prefix"]: r["n"] for r in first}) if n else {}
    row = times.sparkSession.createDataFrame(
        [(n, total, *[values.get(name) for name in at])], f"files bigint, _sum double, {', '.join(f'{p} double' for p in at)}")
    return row.select(
        "files", F.round(F.coalesce("_sum", F.lit(0.0)), 2).alias("total_s"),
        F.round(F.coalesce(F.col("_sum") / F.nullif("files", F.lit(0)), F.lit(0.0)) * 1000,
                1).alias("mean_ms"),
        *[F.round(F.coalesce(F.col(p), F.lit(0.0)) * 1000, 1).alias(p) for p in at])


def tier_check(results: DataFrame) -> DataFrame:
    """Per file the source most findings came from (the earlier one on ties), and whether the expected
    tier answered. Sources are counted once each; there are as many as tiers."""
    sources = F.array_distinct(F.transform("findings", lambda f: f["source"]))
    counted = F.transform(sources, lambda s, i: F.struct(
        F.size(F.filter("findings", lambda f: f["source"] == s)).alias("n"), (-i).alias("early"), s.alias("source")))
    source = F.array_max(counted)["source"]
    return results.withColumn("dominant_source", source).withColumn(
        "outcome", F.when(F.size("findings") == 0, "MISS").when(
            F.contains("expected", "dominant_source") | F.contains("dominant_source", "expected"),
            "PASS").otherwise("WARN"))
