"""Inputs derived from the given tables.

Files are orders, findings are line items, people are customers, decisions and scan runs are
events. The SQL below is read alike by Spark and DuckDB, so both sides start from the same rows.
One owner and one person hold a third of all files on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.functions.ordering import spread
from workload.forms_sql import COLUMNS, FIRST, FORMS, LAST, SOURCES, _pick

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CATEGORY = _pick(
    "name,username,email,signature,photo_video,phone,fax,home_address,"
    "billing_shipping_address,passport,id_card,drivers_license,travel_history", "{key}")

STATUS = """CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 3 <> 0 THEN 'not_flagged'
    WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'not checked'
    WHEN o_orderkey % 7 = 2 THEN 'not_checked' WHEN o_orderkey % 7 = 3 THEN 'not_flagged'
    ELSE 'flagged' END"""
REGISTRY = f"""
SELECT file_id, name, mime_type, owner, google_created_at, is_deleted, last_seen_at, status_flag,
       CASE WHEN status_flag IN ('flagged', 'not_flagged') THEN 'regex' END AS detection_stage,
       CASE WHEN status_flag = 'flagged' AND k % 5 <> 0 THEN {CATEGORY.format(key='k')} END
           AS pii_category,
       CAST(NULL AS STRING) AS user_action
FROM (SELECT o_orderkey AS k, 'f' || o_orderkey AS file_id, 'file ' || o_orderkey AS name,
             CASE o_orderkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain'
                 ELSE 'text/csv' END AS mime_type,
             CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN ''
                 WHEN o_orderkey % 3 = 0 THEN 'hub@example.com'
                 ELSE 'user' || o_custkey || '@example.com' END AS owner,
             o_orderdate AS google_created_at, o_orderkey % 50 = 0 AS is_deleted,
             o_orderdate AS last_seen_at, {STATUS} AS status_flag
      FROM orders) AS r"""
# Files of open orders are listed again under a new name; customers add unknown files.
LISTING = """
SELECT 'f' || o_orderkey AS id, 'renamed ' || o_orderkey AS name,
       CASE o_orderkey % 5 WHEN 0 THEN 'video/x-custom' WHEN 1 THEN 'application/zip'
           WHEN 2 THEN 'application/vnd.google-apps.document' ELSE 'text/plain' END AS mime,
       o_orderdate AS created, CAST(o_orderkey % 20 = 0 AS BOOLEAN) AS trashed,
       CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'no mail' ELSE 'mail' END AS owners,
       'new' || o_custkey || '@example.com' AS email
FROM orders WHERE o_orderstatus <> 'F'
UNION ALL
SELECT 'n' || c_custkey, 'note' || c_custkey || '.TXT', 'text/plain', TIMESTAMP '2024-02-01 00:00:00',
       CAST(NULL AS BOOLEAN), 'mail', 'user' || c_custkey || '@example.com' FROM customer"""
KIND = _pick("expense,training,it_access,supplier,incident,notes", "o_orderkey")
FILES = f"""
SELECT 'f' || k AS id, '/share/' || kind || '/' || kind || '_' || k || '.txt' AS path,
       CASE WHEN personal THEN 'onedrive' WHEN kind IN ('it_access', 'supplier') THEN 'sharepoint'
           ELSE 'fileshare' END AS source_type,
       CAST(k % 100000 + 10 AS BIGINT) AS size_bytes,
       CAST(1500000000 + k % 100000 * 3000 AS DOUBLE) AS last_modified,
       CASE WHEN personal THEN person END AS owner_user_id,
       CASE WHEN NOT personal THEN person END AS master_of_data_user_id,
       CASE WHEN k % 9 <> 0 THEN CAST(1600000000 AS DOUBLE) END AS last_scanned_at
FROM (SELECT o_orderkey AS k, {KIND} AS kind, o_orderkey % 6 < 2 AS personal,
             CASE WHEN o_orderkey % 3 = 0 THEN 'u0' ELSE 'u' || o_custkey END AS person
      FROM orders) AS o"""
USERS = f"""
SELECT 'u' || k AS id, {FIRST} || ' ' || {LAST} AS name, 'u' || k || '@example.com' AS email,
       CASE WHEN k % 10 = 9 THEN 'admin' ELSE 'employee' END AS role
FROM (SELECT c_custkey AS k FROM customer) AS c
UNION ALL
SELECT CASE r_regionkey WHEN 0 THEN 'steward_it' ELSE 'steward_comp' END, r_name,
       'steward@example.com', 'admin' FROM region WHERE r_regionkey < 2"""
FINDINGS = f"""
SELECT 'd' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, 'f' || l_orderkey AS file_id,
       {CATEGORY.format(key='l_partkey')} AS category, 'value ' || l_partkey AS snippet,
       CAST(l_partkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS confidence,
       'regex' AS detector, 'Art. 5' AS gdpr_articles,
       CASE WHEN l_returnflag = 'A' THEN 'keep' WHEN l_returnflag = 'R' THEN 'delete'
           WHEN l_linestatus = 'F' THEN 'false_positive' ELSE 'open' END AS status,
       CAST(1600000000 AS DOUBLE) AS created_at
FROM lineitem"""
DECISIONS = """
SELECT 'f' || (event_id % 20000) AS file_id, ts,
       CASE event_type WHEN 'purchase' THEN 'confirm_delete' WHEN 'error' THEN 'false_positive'
           WHEN 'view' THEN 'archive' ELSE 'keep' END AS action
FROM events WHERE event_type <> 'view' OR event_id % 3 = 0"""
RUNS = """
SELECT 'run' || d AS id, CASE WHEN d % 2 = 0 THEN 'full' ELSE 'delta' END AS type,
       CAST(1700000000 + d * 86400 AS DOUBLE) AS started_at,
       CAST(1700000000 + d * 86400 + n AS DOUBLE) AS finished_at,
       n AS files_scanned, n * 100 AS bytes_scanned, flagged AS files_flagged,
       skipped AS files_skipped, 'done' AS status, CAST(100 AS DOUBLE) AS progress_pct
FROM (SELECT CAST(dayofyear(ts) AS BIGINT) AS d, CAST(COUNT(*) AS BIGINT) AS n,
             CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
             CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS skipped
      FROM events GROUP BY dayofyear(ts)) AS e"""

# Answers of the recogniser and the model, one shape per remainder of the document id; one
# language has no answer, as when a request fails. Every seventh model answer is delivered twice.
# Every third view is a review action outside the vocabulary.
ENTITY_ANSWERS = """
SELECT CAST(doc_id AS STRING) AS file_id, CASE doc_id % 8 WHEN 7 THEN '{oops' ELSE
    '{"results":{"documents":[{"id":"1","entities":[' || CASE doc_id % 8
        WHEN 0 THEN '{"text":"P' || doc_id || '","category":"Person","confidenceScore":0.95}'
        WHEN 1 THEN '{"text":"A' || doc_id || '","category":"Address","confidenceScore":0.87}'
        WHEN 2 THEN '{"text":"7","category":"Quantity","confidenceScore":0.99}'
        WHEN 3 THEN '{"text":"Q","category":"Person","confidenceScore":0.5}'
        WHEN 4 THEN '{"text":"M' || doc_id || '","category":"Email","confidenceScore":0.86},'
            || '{"text":"R","category":"PersonType","confidenceScore":0.97}'
        ELSE '' END || ']}]}}' END AS response
FROM documents WHERE lang <> 'es'"""
VERIFY_ANSWERS = """
SELECT CAST(doc_id AS STRING) AS file_id, CASE doc_id % 5
    WHEN 0 THEN '[{"index":0,"is_pii":true,"category":"email","confidence":0.7}]'
    WHEN 1 THEN '[{"index":0,"is_pii":false},{"index":9,"is_pii":true}]'
    WHEN 2 THEN 'no idea' ELSE '[{"index":0,"is_pii":true,"category":null}]' END AS content
FROM documents CROSS JOIN (SELECT 0 AS delivery UNION ALL SELECT 1) AS twice
WHERE lang <> 'fr' AND (delivery = 0 OR doc_id % 7 = 0)"""
DETECT_ANSWERS = """
SELECT CAST(doc_id AS STRING) AS file_id, CASE doc_id % 4
    WHEN 0 THEN '[{"category":"name","confidence":0.6},{"category":"name"},{"x":1},'
        || '{"category":"health_data","confidence":0.8}]'
    WHEN 1 THEN '[]' ELSE '{"category":"name"}' END AS content
FROM documents CROSS JOIN (SELECT 0 AS delivery UNION ALL SELECT 1) AS twice
WHERE lang <> 'de' AND (delivery = 0 OR doc_id % 7 = 0)"""

RELATIONS = {
    "forms": FORMS, "registry": REGISTRY, "listing": LISTING, "files": FILES, "users": USERS,
    "findings": FINDINGS, "decisions": DECISIONS, "runs": RUNS,
    "entity_answers": ENTITY_ANSWERS, "verify_answers": VERIFY_ANSWERS,
    "detect_answers": DETECT_ANSWERS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream. It may be one file or a folder of files: a pattern stands for either, while
    the stream source takes a plain path for a folder with other folders below."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a lazy DataFrame over the given tables."""
    sql = RELATIONS[name]
    for given in TABLES:
        if given in sql:
            table(spark, sf_dir, given).createOrReplaceTempView(given)
    if name == "forms":
        # The keys are spread before the texts are built from them.
        return spread(spark.sql(SOURCES), small=True).selectExpr(*COLUMNS)
    return spark.sql(sql)
