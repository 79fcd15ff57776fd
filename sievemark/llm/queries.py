"""The registered queries of the dealt operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import (
    bpe, exact_dedup, id_blocks, language_model, lexical, near_dedup, quality_forest, source_mix, spelling, token_counts,
    top_k, toxicity, url_filter)
from sievemark.llm.frames import crc_of, small_batches, table
from sievemark.session import scratch_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labels of ids that are not held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_of("doc_id") % 4 != 2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of("doc_id") % 5 == 1
    scored = language_model.score_texts(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "perplexity")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(documents(spark, sf_dir)).drop("in_history")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op7_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "ids")
    id_blocks.write_ids(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return id_blocks.read_ids(spark, folder).drop("ids")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The rules of the registered query: action, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group_near_copies(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_bpe_round_trip, op4_language_model, op5_exact_dedup, op6_source_mix, op7_id_blocks,
    op8_top_k, op9_url_filter, op10_near_dedup, op11_lexical_search, op12_quality_forest,
    op13_spelling_variants)}
#: Terms of the lexical search, as a pattern of the SQL engine.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_lexical_search": rf"""
        WITH t AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id AS id, text FROM documents
            UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
        s AS (SELECT side, row, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM t),
        p AS (SELECT side, row, id, term, count(*) AS tf FROM s GROUP BY ALL),
        n AS (SELECT row, sum(tf)::BIGINT AS n FROM p WHERE side = 'd' GROUP BY row),
        c AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM p WHERE side = 'd' GROUP BY term), c),
        r AS (SELECT i.row, i.id AS item_id, d.row AS d_row, d.id AS doc_id, CAST(sum(i.tf * w * ((1000000000 * d.tf)
                // (1000 * d.tf + 8 * (100 - 75 + (75 * n * documents) // length)))) AS BIGINT) AS score
            FROM p i JOIN p d ON d.side = 'd' AND i.side = 'i' AND d.term = i.term JOIN w ON w.term = i.term
            JOIN n ON n.row = d.row, c GROUP BY ALL),
        o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id, d_row) AS INTEGER) AS rank,
            doc_id, score FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
