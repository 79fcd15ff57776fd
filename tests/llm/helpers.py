"""Small inputs for the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a caller's columns of these names must not disturb them.
CLASHES = {"_key": "a", "_row": "b", "_id": "c", "_text": "d", "_copy": "e", "kept": "f", "x": "g", "value": "h"}


def documents(spark: SparkSession, rows: list[tuple], clashes: bool = False, parts: int = 3) -> DataFrame:
    """``rows``: id, text and perhaps source."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    schema = SCHEMA
    if clashes:
        full = [r + tuple(CLASHES.values()) for r in full]
        schema += "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame(full, schema).repartition(parts)


def words(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


#: Texts that no operator may stumble over.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "word"), (5, "word"), (None, "no id"), (None, None),
       (6, "x" * 30_000), (7, "a b c d e f " * 4000), (8, "É ß 日本 🙂 \x00 \x85 <|endoftext|> </s> ▁")]
