"""Files of a folder tree as (path, size_bytes, last_modified, text, error) rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.fixed_values import TEXT_EXTENSIONS
from sievemark.functions.strings import base_name, suffix
from sievemark.sources.parsers import PARSERS, html_text
from sievemark.sources.tree import by_bytes, list_tree, open_system

PARSED_EXTENSIONS = tuple(PARSERS)
_BATCH_CHARS = 16_000_000
_TEXT = "path string, size_bytes bigint, last_modified double, text string, error string"


def _glob(extensions: Iterable[str]) -> str:
    """A name filter that ignores case, so that each file is read by one branch only."""
    endings = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(endings) + "}"


def _metadata() -> list[Column]:
    return ["path", F.col("length").alias("size_bytes"),
            (F.unix_micros("modificationTime") / 1e6).alias("last_modified")]


def list_files(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """Path, size and time of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions is not None:
        files = files.option("pathGlobFilter", _glob(extensions))
    return files.load(root).select(*_metadata())


def decode_text(content: Column) -> Column:
    """UTF-8 with unreadable bytes replaced and line ends unified."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def read_texts(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """Text of every file below ``root``; unsupported and broken files carry an error instead.

    The tree is listed once, by tasks; folders that cannot be listed are rows with an error.
    """
    listing = list_tree(spark, root, extensions)
    closed = listing.where(F.col("error").isNotNull()).withColumn("text", F.lit(None).cast("string"))
    return texts_of(listing.where(F.col("error").isNull()).drop("error")).unionByName(closed)


def _open_and_parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def load(path: str) -> bytes:
        system, place = open_system(path)
        with system.open_input_stream(place) as stream:
            return stream.read()

    def text_of(path: str, ending: str) -> str:
        if ending in TEXT_EXTENSIONS:
            text = load(path).decode("utf-8", errors="replace")
            return text.replace("\r\n", "\n").replace("\r", "\n")
        return PARSERS[ending](load(path))

    def flush(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            rows, columns=["path", "size_bytes", "last_modified", "text", "error"])

    for frame in frames:
        rows, held = [], 0
        for path, size, modified, ending in frame.itertuples(index=False):
            text = error = None
            try:
                if ending in TEXT_EXTENSIONS or ending in PARSERS:
                    text = text_of(path, ending)
                else:
                    error = f"unsupported file type: {ending}"
            except Exception as problem:  # a bad file must not end the run
                error = f"{type(problem).__name__}: {problem}"
            rows.append((path, size, modified, text, error))
            held += len(text or "")
            if held > _BATCH_CHARS:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)


def texts_of(files: DataFrame) -> DataFrame:
    """Text of chosen files only, opened by the executors.

    Only paths are shuffled, dealt so that each task opens about as many bytes; a worker hands texts
    back in pieces of bounded size. ``files`` is a written table: it is counted before.
    """
    rows = files.select("path", "size_bytes", "last_modified",
                        suffix(base_name(F.col("path"))).alias("ending"))
    return by_bytes(rows).mapInPandas(_open_and_parse, _TEXT)


def _parse_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents leave the Arrow batch one by one, so a worker holds it once and not again as Python objects."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "text", "error"])

    for batch in batches:
        rows, held = [], 0
        for i in range(batch.num_rows):
            path, ending, content = (column[i].as_py() for column in batch.columns)
            text = error = None
            try:
                text = PARSERS[ending](bytes(content))
            except Exception as problem:  # a bad file must not end the run
                error = f"{type(problem).__name__}: {problem}"
            rows.append((path, text, error))
            held += len(text or "")
            if held > _BATCH_CHARS:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)


def texts_of_contents(files: DataFrame) -> DataFrame:
    """(path, content) rows, from a table or a reader, to (path, text, error); nothing is opened here."""
    rows = files.select("path", suffix(base_name(F.col("path"))).alias("ending"), "content")
    none = F.lit(None).cast("string")
    plain = rows.filter(F.col("ending").isin(*TEXT_EXTENSIONS)).select(
        "path", decode_text(F.col("content")).alias("text"), none.alias("error"))
    parsed = rows.filter(F.col("ending").isin(*PARSED_EXTENSIONS)).mapInArrow(
        _parse_contents, "path string, text string, error string")
    other = rows.filter(~F.col("ending").isin(*TEXT_EXTENSIONS, *PARSED_EXTENSIONS)).select(
        "path", none.alias("text"), F.concat(F.lit("unsupported file type: "), "ending").alias("error"))
    return plain.unionByName(parsed).unionByName(other)


def split_errors(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the failed ones with their error."""
    return (texts.filter(F.col("error").isNull()).drop("error"),
            texts.filter(F.col("error").isNotNull()).drop("text"))


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows, held = [], 0
        for page, html in frame.itertuples(index=False):
            rows.append((page, None if html is None else html_text(html)))
            held += len(rows[-1][1] or "")
            if held > _BATCH_CHARS:
                yield pd.DataFrame(rows, columns=["page_id", "text"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "text"])


def page_texts(pages: DataFrame) -> DataFrame:
    """Text nodes of every (page_id, html) row, joined by newlines."""
    return pages.select("page_id", "html").mapInPandas(_pages, "page_id bigint, text string")
