"""Answers of the OCR and video services as text, and the choice between OCR and local text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.fixed_values import OCR_MIN_CHARS
from sievemark.functions.strings import strip

_IMAGE = "fullTextAnnotation struct<text: string>, textAnnotations array<struct<description: string>>"
_VIDEO = ("response struct<annotationResults: array<struct<"
          "speechTranscriptions: array<struct<alternatives: array<struct<transcript: string>>>>,"
          "textAnnotations: array<struct<text: string>>>>>")


def image_text(answer: Column) -> Column:
    """Full text of an image answer, else its first annotation, else nothing."""
    parsed = F.from_json(answer, _IMAGE)
    full = F.nullif(parsed["fullTextAnnotation"]["text"], F.lit(""))
    first = F.try_element_at(parsed["textAnnotations"], F.lit(1))["description"]
    return F.coalesce(full, first, F.lit(""))


def video_text(answer: Column) -> Column:
    """Best transcripts and on-screen texts in order, each once, parted by blank lines."""
    results = F.from_json(answer, _VIDEO)["response"]["annotationResults"]
    empty = F.array().cast("array<string>")

    def texts(result: Column) -> Column:
        spoken = F.transform(result["speechTranscriptions"], lambda s: F.try_element_at(
            s["alternatives"], F.lit(1))["transcript"])
        shown = F.transform(result["textAnnotations"], lambda t: t["text"])
        return F.concat(F.coalesce(spoken, empty), F.coalesce(shown, empty))

    parts = F.transform(F.flatten(F.transform(results, texts)), strip)
    kept = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return F.coalesce(F.array_join(kept, "\n\n"), F.lit(""))


def pdf_page_texts(pages: DataFrame) -> DataFrame:
    """(file_id, page_no, answer) rows to one text per file: non-blank pages in page order.

    The pages of one file are its own content, so the group is as large as the file.
    """
    text = strip(image_text(F.col("answer")))
    rows = pages.select("file_id", "page_no", text.alias("text"))
    kept = F.collect_list(F.when(F.col("text") != "", F.struct("page_no", "text")))
    return rows.groupBy("file_id").agg(F.array_join(
        F.transform(F.array_sort(kept), lambda p: p["text"]), "\n\n").alias("ocr_text"))


def needs_ocr(mime: Column, text: Column) -> Column:
    return (mime == "application/pdf") & (
        F.length(strip(F.coalesce(text, F.lit("")))) < OCR_MIN_CHARS)


def choose_text(files: DataFrame, ocr_texts: DataFrame) -> DataFrame:
    """Replace the text of short PDFs by their OCR text where that is not blank."""
    joined = files.join(ocr_texts.select("file_id", "ocr_text"), "file_id", "left")
    ocr = F.when(strip(F.col("ocr_text")) != "", F.col("ocr_text"))
    local = F.coalesce("text", F.lit(""))
    chosen = F.when(needs_ocr(F.col("mime_type"), F.col("text")), F.coalesce(ocr, local))
    return joined.withColumn("text", chosen.otherwise(F.col("text"))).drop("ocr_text")
