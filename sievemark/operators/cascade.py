"""Detection cascade: rules first, then recogniser and language-model answers for the rest.

Model calls happen outside. Requests leave as tables, answers come back as tables keyed by file,
and everything in between is a row-wise expression. The text is dropped right after the rules, so
the joins with the answer tables move only ids and short arrays, and all share one partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.governance import clamp
from sievemark.functions.rules import with_document_findings
from sievemark.functions.strings import to_java
from sievemark.session import scratch_folder

FINDING = ("struct<category:string,snippet:string,pattern:string,source:string,"
           "confidence:double>")
FINDINGS = f"array<{FINDING}>"
_ENTITIES = ("results struct<documents: array<struct<id: string, entities: array<struct<"
             "text: string, category: string, confidenceScore: double>>>>>")
_ITEM = "index INT, is_pii BOOLEAN, category STRING, confidence DOUBLE"
Scorer = Callable[[DataFrame], DataFrame]


def strip_form_labels(text: Column) -> Column:
    return F.regexp_replace(text, to_java(V.FORM_LABEL), "")


def _no_findings() -> Column:
    return F.array().cast(FINDINGS)


def _finding(category: Column, snippet: Column, source: str, confidence: Column) -> Column:
    return F.struct(
        category.alias("category"), snippet.alias("snippet"),
        F.lit(None).cast("string").alias("pattern"), F.lit(source).alias("source"),
        confidence.alias("confidence"))


def entity_filter(entities: Column, mode: str | None = None,
                  threshold: float = V.ENTITY_MIN_CONFIDENCE) -> Column:
    """Entities of the mode's types with enough confidence; an unknown mode means the minimal one."""
    kept = entities
    if mode is not None:
        types = V.ENTITY_MODES.get(mode, V.ENTITY_MODES[V.FALLBACK_ENTITY_MODE])
        kept = F.filter(kept, lambda e: e["category"].isin(*types))
    if threshold > 0:
        kept = F.filter(kept, lambda e: e["confidenceScore"] >= threshold)
    return kept


def entity_findings(entities: Column) -> Column:
    """Map entity types to categories; types without one are dropped."""
    table = F.create_map(*[F.lit(x) for kv in V.ENTITY_CATEGORY.items() for x in kv])
    mapped = F.transform(entities, lambda e: _finding(
        F.try_element_at(table, e["category"]), e["text"], "ner", e["confidenceScore"]))
    return F.filter(mapped, lambda f: f["category"].isNotNull())


def answered_entities(response: Column, mode: str | None = None,
                      threshold: float = V.ENTITY_MIN_CONFIDENCE) -> Column:
    """Entities of a single-document answer; NULL when there is no readable answer."""
    parsed = F.from_json(response, _ENTITIES)
    first = F.try_element_at(parsed["results"]["documents"], F.lit(1))["entities"]
    empty = F.array().cast("array<struct<text:string,category:string,confidenceScore:double>>")
    readable = F.try_parse_json(response).isNotNull()
    return F.when(readable, entity_filter(F.coalesce(first, empty), mode, threshold))


def windows(text: Column, size: int, shared: int = 0) -> Column:
    """The whole text in pieces ``(part, start, text)`` of ``size`` characters; neighbours share ``shared``."""
    step = size - shared
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("part"), (i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("text")))


def residue(texts: DataFrame, detectors: Iterable[str] | None = None) -> DataFrame:
    """The (file_id, text) in which the rules find nothing, straight from the scanning pass."""
    found = rule_findings(texts, "text", detectors)
    return found.filter(F.size("findings") == 0).select("file_id", "text")


def entity_requests(texts: DataFrame, batch_size: int) -> DataFrame:
    """Batches of label-free texts, one request body per batch; ids count from 1 in a batch.

    Rows are numbered inside their partition, so batches are cut without a global order; ``texts``
    is the residue of the rules.
    """
    row = F.monotonically_increasing_id()
    numbered = texts.select("file_id", row.alias("_row"), strip_form_labels(F.col("text")).alias("text"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.select(
        "file_id", F.shiftright("_row", 33).alias("_part"), F.floor(inside / batch_size).alias("_cut"),
        (inside % batch_size + 1).alias("n"), "text")
    entry = F.struct("n", F.struct(F.col("n").cast("string").alias("id"), "text").alias("doc"))
    batches = numbered.groupBy("_part", "_cut").agg(  # at most batch_size rows each
        F.array_sort(F.collect_list(entry)).alias("_docs"),
        F.array_sort(F.collect_list(F.struct("n", "file_id"))).alias("_ids"))
    body = F.struct(
        F.lit("EntityRecognition").alias("kind"),
        F.struct(F.transform("_docs", lambda d: d["doc"]).alias("documents")).alias(
            "analysisInput"),
        F.struct(F.lit("latest").alias("modelVersion")).alias("parameters"))
    return batches.select(F.concat_ws("-", "_part", "_cut").alias("batch"),
                          F.transform("_ids", lambda d: d["file_id"]).alias("file_ids"),
                          F.to_json(body).alias("request"))


def batch_entities(answers: DataFrame, mode: str | None = None,
                   threshold: float = V.ENTITY_MIN_CONFIDENCE) -> DataFrame:
    """(file_ids, response) batches to one entity array per file, whatever the answer order."""
    documents = F.from_json("response", _ENTITIES)["results"]["documents"]
    found = answers.select("file_ids", F.explode(documents).alias("_doc"))
    at = F.col("_doc.id").try_cast("int")
    return found.select(
        F.try_element_at("file_ids", at).alias("file_id"),
        F.transform(entity_filter(F.col("_doc.entities"), mode, threshold), lambda e: F.struct(
            e["text"].alias("text"), e["category"].alias("category"),
            e["confidenceScore"].alias("confidence"))).alias("entities"))


def _items(content: Column) -> Column:
    """The objects of a JSON array as raw JSON, NULL unless the whole answer is an array."""
    whole = F.try_parse_json(content)
    is_array = F.schema_of_variant(whole).startswith("ARRAY")
    items = F.from_json(content, "array<string>")
    return F.when(is_array, F.filter(items, lambda i: F.ltrim(i).startswith("{")))


def _has_key(item: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(item), key)


def apply_verdicts(candidates: Column, content: Column, enabled: bool = True) -> Column:
    """Keep the confirmed candidates; a missing or unreadable answer keeps them all unchanged."""
    if not enabled:
        return _no_findings()
    items = F.transform(_items(content), lambda i: F.struct(
        F.from_json(i, _ITEM).alias("v"), _has_key(i, "confidence").alias("scored")))

    def judged(candidate: Column, i: Column) -> Column:
        mine = F.filter(items, lambda x: x["v"]["index"] == i)
        first = F.try_element_at(mine, F.lit(1))
        confirmed = F.exists(mine, lambda x: F.coalesce(x["v"]["is_pii"], F.lit(False)))
        category = F.coalesce(F.nullif(first["v"]["category"], F.lit("")), candidate["category"])
        confidence = F.when(first["scored"], first["v"]["confidence"]).otherwise(
            candidate["confidence"])
        return F.when(confirmed, _finding(category, candidate["snippet"], "ner+llm", confidence))

    kept = F.filter(F.transform(candidates, judged), lambda f: f.isNotNull())
    return F.when(items.isNull(), candidates).otherwise(kept)


def model_findings(content: Column) -> Column:
    """Categories named by the model, the first mention of each, without snippets."""
    named = F.filter(_items(content), lambda i: _has_key(i, "category"))
    parsed = F.transform(named, lambda i: F.from_json(i, _ITEM))
    keys = F.transform(parsed, lambda p: F.coalesce(p["category"], F.lit("\x00")))
    first = F.filter(
        F.transform(parsed, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: F.array_position(keys, F.coalesce(x["p"]["category"], F.lit("\x00")))
        == x["i"] + 1)
    found = F.transform(first, lambda x: _finding(
        x["p"]["category"], F.lit(None).cast("string"), "llm", x["p"]["confidence"]))
    return F.coalesce(found, _no_findings())


def primary_category(findings: Column) -> Column:
    """Category of the surest finding, the earliest on ties; NULL without findings."""
    ranked = F.transform(findings, lambda f, i: F.struct(
        F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"), (-i).alias("early"),
        f["category"].alias("category")))
    return F.array_max(ranked)["category"]


def rule_findings(df: DataFrame, text: str = "text",
                  detectors: Iterable[str] | None = None) -> DataFrame:
    """Document rules in the shape that all tiers share."""
    scanned = with_document_findings(df, text, detectors)
    return scanned.withColumn("findings", F.transform("findings", lambda f: F.struct(
        f["category"].alias("category"), f["snippet"].alias("snippet"),
        f["pattern"].alias("pattern"), f["source"].alias("source"),
        F.lit(None).cast("double").alias("confidence"))))


def scan_texts(
    texts: DataFrame, entity_answers: DataFrame | None = None,
    verify_answers: DataFrame | None = None, detect_answers: DataFrame | None = None,
    skip_models: bool = False, detectors: Iterable[str] | None = None,
) -> DataFrame:
    """Run the cascade over (file_id, text).

    Answer tables are (file_id, response) for the recogniser and (file_id, content) for the
    model; a missing table means that service has no key. Returns file_id, findings, stage,
    category, status_flag.
    """
    rows = rule_findings(texts, "text", detectors).select("file_id", "findings")
    return settle(rows, entity_answers, verify_answers, detect_answers, skip_models).drop("_carried")


def one_answer(answers: DataFrame, column: str) -> DataFrame:
    """One answer per file: deliveries may repeat, and a file may have been asked in parts.

    Answers to parts are arrays; their items are joined in the order of the parts.
    """
    if "part" not in answers.columns:
        return answers.groupBy("file_id").agg(F.max(column).alias(column))
    each = answers.groupBy("file_id", "part").agg(F.max(column).alias(column))
    parts = F.array_sort(F.collect_list(F.struct("part", _items(F.col(column)).alias("items"))))
    items = F.flatten(F.filter(F.transform(parts, lambda p: p["items"]), lambda i: i.isNotNull()))
    readable = F.max(_items(F.col(column)).isNotNull())
    joined = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    return each.groupBy("file_id").agg(F.when(readable, joined).otherwise(F.max(column)).alias(column))


def settle(rows: DataFrame, entity_answers: DataFrame | None, verify_answers: DataFrame | None,
            detect_answers: DataFrame | None, skip_models: bool) -> DataFrame:
    """The answer tables joined to (file_id, findings) and settled; a column ``_carried`` goes along."""
    if "_carried" not in rows.columns:
        rows = rows.withColumn("_carried", F.lit(None).cast("string"))

    def joined(frame: DataFrame, table: DataFrame | None, column: str, out: str) -> DataFrame:
        if table is None:
            return frame.withColumn(out, F.lit(None).cast("string"))
        answers = one_answer(table, column).withColumnRenamed(column, out)
        return frame.join(answers, "file_id", "left")

    rows = joined(rows, entity_answers, "response", "_ner")
    rows = joined(rows, None if skip_models else verify_answers, "content", "_verify")
    rows = joined(rows, None if skip_models else detect_answers, "content", "_detect")

    by_rules = F.size("findings") > 0
    rows = rows.withColumn("_found", F.when(
        ~by_rules, entity_findings(answered_entities(F.col("_ner")))))
    answered = F.col("_found").isNotNull()
    if skip_models:
        result = F.when(by_rules, F.col("findings")).otherwise(
            F.coalesce("_found", _no_findings()))
        stage = F.when(answered, "ner").otherwise("regex")
    else:
        sure = F.filter("_found", lambda f: f["confidence"] >= V.VERIFY_BELOW)
        unsure = F.filter("_found", lambda f: F.coalesce(f["confidence"], F.lit(0.0))
                          < V.VERIFY_BELOW)
        rows = rows.withColumn("_unsure", unsure).withColumn("_kept", F.concat(
            sure, F.when(F.size("_unsure") > 0, apply_verdicts(
                F.col("_unsure"), F.col("_verify"), verify_answers is not None)).otherwise(
                _no_findings())))
        by_entities = F.coalesce(F.size("_kept") > 0, F.lit(False))
        result = F.when(by_rules, F.col("findings")).when(
            by_entities, F.col("_kept")).otherwise(model_findings(F.col("_detect")))
        stage = F.when(by_rules, "regex").when(
            by_entities & (F.size("_unsure") > 0), "ner+llm_verify").when(
            by_entities, "ner").otherwise("llm_detect")
    rows = rows.select("file_id", result.alias("findings"), stage.alias("stage"), "_carried")
    return rows.select(
        "file_id", "findings", "stage", "_carried", primary_category(F.col("findings")).alias("category"),
        F.when(F.size("findings") > 0, "flagged").otherwise("not_flagged").alias("status_flag"))


def unsure_in(left: DataFrame, entity_answers: DataFrame) -> DataFrame:
    """(file_id, text, candidates) of the residue ``left`` whose entities need to be verified."""
    found = F.filter(entity_findings(answered_entities(F.col("response"))),
                     lambda f: F.coalesce(f["confidence"], F.lit(0.0)) < V.VERIFY_BELOW)
    asked = one_answer(entity_answers, "response").select("file_id", found.alias("candidates"))
    return left.join(asked.filter(F.size("candidates") > 0), "file_id")


def unsure_candidates(texts: DataFrame, entity_answers: DataFrame,
                      detectors: Iterable[str] | None = None) -> DataFrame:
    """(file_id, text, candidates) of the texts' residue whose entities need to be verified."""
    return unsure_in(residue(texts, detectors), entity_answers)


def verify_requests(asked: DataFrame, size: int = V.VERIFY_TEXT_CHARS) -> DataFrame:
    """Questions per file, ``(file_id, part, start, request)``: windows of its text that hold unsure candidates.

    ``asked`` holds file_id, text and candidates (see ``unsure_candidates``). A candidate is asked
    about in the window of its first occurrence, one that does not occur in the first window; windows
    share the length of the longest snippet, so none is cut in two. ``index`` counts in the file.
    """
    step = size - V.MAX_SNIPPET_CHARS
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step))
    place = lambda c: F.greatest(F.call_function("locate", c["snippet"], F.col("text"), F.lit(1)) - 1, F.lit(0))
    placed = F.transform("candidates", lambda c, i: F.struct(
        F.least(F.floor(place(c) / step), last).cast("int").alias("part"), i.alias("index"),
        c["snippet"].alias("snippet")))
    rows = asked.withColumn("_placed", placed).withColumn(
        "part", F.explode(F.array_distinct(F.transform("_placed", lambda p: p["part"]))))
    snippets = F.to_json(F.transform(
        F.filter("_placed", lambda p: p["part"] == F.col("part")),
        lambda p: F.struct(p["index"].alias("index"), p["snippet"].alias("snippet"))))
    start = F.col("part") * step
    body = F.concat(F.lit("Text:\n"), F.substr("text", start + 1, F.lit(size)),
                    F.lit("\n\nSnippets to verify:\n"), snippets)
    return rows.select("file_id", "part", start.alias("start"), body.alias("request"))


def undetected_in(left: DataFrame, entity_answers: DataFrame | None = None, verify_answers: DataFrame | None = None,
                  size: int = V.DETECT_TEXT_CHARS) -> DataFrame:
    """Windows ``(file_id, part, start, request)`` over the residue ``left`` in which no tier found anything."""
    rows = left.select("file_id", _no_findings().alias("findings"), F.col("text").alias("_carried"))
    open_rows = settle(rows, entity_answers, verify_answers, None, False).filter(F.col("stage") == "llm_detect")
    return open_rows.select("file_id", F.inline(windows(F.col("_carried"), size))).withColumnRenamed("text", "request")


def detect_requests(texts: DataFrame, entity_answers: DataFrame | None = None,
                    verify_answers: DataFrame | None = None, detectors: Iterable[str] | None = None,
                    size: int = V.DETECT_TEXT_CHARS) -> DataFrame:
    """Windows ``(file_id, part, start, request)`` over the texts in which no tier found anything."""
    return undetected_in(residue(texts, detectors), entity_answers, verify_answers, size)


def stored_residue(texts: DataFrame, buckets: int, detectors: Iterable[str] | None = None) -> DataFrame:
    """The residue, written once as a table bucketed by ``file_id``.

    The rules run for the write and never again. All requests read this table, and where answers meet
    the texts only the answers are shuffled: the table's buckets are its partitioning. The write is the one place where text
    is shuffled. The table belongs to the session's catalog, its files to the shared folder.
    """
    spark = texts.sparkSession
    name = f"residue_{uuid.uuid4().hex}"
    (residue(texts, detectors).repartition(buckets, "file_id").write.bucketBy(buckets, "file_id").sortBy("file_id")
     .option("path", scratch_folder(spark, "residue")).saveAsTable(name))
    return spark.table(name)


class ModelRequests(NamedTuple):
    entities: DataFrame
    verify: DataFrame
    detect: DataFrame


def model_requests(texts: DataFrame, entity_answers: DataFrame, verify_answers: DataFrame | None, buckets: int,
                   batch_size: int = 25, detectors: Iterable[str] | None = None) -> ModelRequests:
    """All three request tables from one scan of the texts; see ``stored_residue``."""
    left = stored_residue(texts, buckets, detectors)
    return ModelRequests(entity_requests(left, batch_size), verify_requests(unsure_in(left, entity_answers)),
                         undetected_in(left, entity_answers, verify_answers))


def run_summary(results: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("status_flag") == "flagged")
    return results.agg(F.count("*").alias("total"), flagged.alias("with_pii"),
                       (F.count("*") - flagged).alias("clean"))


def stage_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(
        F.count("*").alias("files"), F.sum(F.size("findings")).alias("findings"))


def verdict_key(category: Column, snippet: Column) -> Column:
    return F.sha2(F.concat(category, F.lit(":"), snippet), 256)


def parse_score(reply: Column) -> Column:
    """The first 0..1 number in a model's reply, clamped; NULL without one."""
    number = F.nullif(F.regexp_extract(reply, r"[01](?:\.\d+)?", 0), F.lit("")).try_cast("double")
    return F.when(number.isNotNull(), clamp(number, F.lit(0.0), F.lit(1.0)))


def unscored(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct low-confidence (key, category, snippet) not yet in the verdict cache."""
    low = findings.filter(F.col("confidence") < V.ESCALATE_BELOW)
    keys = low.select("category", "snippet").distinct().withColumn(
        "key", verdict_key(F.col("category"), F.col("snippet")))
    return keys.join(cache.select("key"), "key", "left_anti")


def updated_cache(findings: DataFrame, cache: DataFrame, scorer: Scorer) -> DataFrame:
    """The cache with every new key scored once; ``scorer`` adds a ``verdict`` column."""
    scored = scorer(unscored(findings, cache)).filter(F.col("verdict").isNotNull())
    return cache.select("key", "verdict").unionByName(scored.select("key", "verdict"))


def escalate(findings: DataFrame, cache: DataFrame, spread_by: list[str]) -> DataFrame:
    """Replace the confidence of low findings that have a verdict and mark them ``llm``.

    The same snippet may occur in a third of all rows: adaptive execution splits such a key, and
    findings that are sure get keys of their own.
    """
    low = F.col("confidence") < V.ESCALATE_BELOW
    keyed = findings.withColumn("key", F.when(
        low, verdict_key(F.col("category"), F.col("snippet"))).otherwise(F.concat(
            F.lit("-"), F.xxhash64(*spread_by).cast("string"))))
    joined = keyed.join(cache.select("key", "verdict"), "key", "left")
    hit = F.col("verdict").isNotNull()
    return joined.withColumns({
        "confidence": F.coalesce("verdict", "confidence"),
        "detector": F.when(hit, "llm").otherwise(F.col("detector"))}).drop("key", "verdict")
