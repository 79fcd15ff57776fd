"""SQL twins of the queries over stored tables, streams with state, and ingest from folders."""

from __future__ import annotations

from sievemark.fixed_values import HTML_ESCAPES
from workload.changes import LANES
from workload.oracle import _DOC_ROWS, _FORM_ROWS, _confusion, _resolved, _with
from workload.oracle import ORACLE as PLAIN

# A stored table that is read back holds what the plain operator gives.
ORACLE: dict[str, str] = {
    "stored_registry_upsert": PLAIN["registry_upsert"],
    "stored_status_update": PLAIN["batch_status_update"],
    "stored_file_decisions": PLAIN["file_decisions_applied"],
    "stored_file_upsert": PLAIN["file_upsert"],
    "stored_status_carryover": PLAIN["status_carryover"],
}
_LAST_STATUS = """last AS (SELECT file_id, arg_max(action, (ts, action)) AS action FROM decisions GROUP BY file_id),
now AS (SELECT owner, CASE WHEN l.action IS NULL THEN status_flag WHEN action = 'keep' THEN 'not_flagged' ELSE 'flagged' END
    AS status_flag FROM registry AS r LEFT JOIN last AS l ON r.file_id = l.file_id)"""
ORACLE["live_owner_totals"] = _with("registry decisions", f"""
, {_LAST_STATUS} SELECT owner, count(*) AS files, count(*) FILTER (WHERE status_flag = 'flagged') AS flagged,
    count(*) FILTER (WHERE status_flag IS DISTINCT FROM 'not checked') AS processed FROM now GROUP BY owner""")
ORACLE["live_finding_totals"] = _with("findings", """
, open_files AS (SELECT 'f' || o_orderkey AS file_id FROM orders WHERE o_orderstatus = 'O'),
now AS (SELECT DISTINCT id, file_id, category FROM findings WHERE confidence > 0.6 OR file_id NOT IN (SELECT file_id FROM open_files))
SELECT category, count(*) AS n FROM now GROUP BY category
UNION ALL SELECT 'files with findings', count(DISTINCT file_id) FROM now UNION ALL SELECT 'all findings', count(*) FROM now""")
ORACLE["verify_requests_of_one_scan"] = PLAIN["verify_requests"]
ORACLE["detect_requests_of_one_scan"] = PLAIN["detect_requests"]
# A line of blanks only is a node of one blank; an empty line is no node.
ORACLE["html_page_texts"] = """
SELECT doc_id AS page_id, md5(array_to_string(list_concat(['Page & ' || doc_id], list_transform(list_filter(
    string_split(text, chr(10)), lambda x: x <> ''), lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(12) || chr(13)) = ''
    THEN ' ' ELSE x END)), chr(10))) AS digest
FROM documents"""


def _escaped(text: str) -> str:
    for plain, entity in HTML_ESCAPES:
        quoted = plain.replace("'", "''")
        text = f"replace({text}, '{quoted}', '{entity}')"
    return text


# One step a finding: its first occurrence that no mark so far overlaps.
ORACLE["highlighted_previews"] = _with("forms", f"""
, f AS (SELECT path, category, trim(snippet) AS snippet, row_number() OVER (PARTITION BY path ORDER BY start, category) AS i
    FROM ({_resolved('forms', 'path')}) AS s WHERE length(trim(snippet)) > 1),
step(path, i, marks) AS (
    SELECT path, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT, c VARCHAR)[]) FROM forms
    UNION ALL
    SELECT path, i, CASE WHEN place IS NULL THEN marks ELSE list_append(marks, {{'s': place, 'e': place + size, 'c': category}}) END
    FROM (SELECT step.path, f.i, marks, category, CAST(length(snippet) AS BIGINT) AS size, list_min(list_filter(
            range(CAST(1 AS BIGINT), CAST(length(text) - length(snippet) + 2 AS BIGINT)),
            lambda p: substring(text, p, length(snippet)) = snippet AND len(list_filter(
                marks, lambda m: p < m.e AND m.s < p + length(snippet))) = 0)) AS place
        FROM step JOIN f ON f.path = step.path AND f.i = step.i + 1 JOIN forms ON forms.path = step.path) AS n),
placed AS (SELECT path, list_sort(arg_max(marks, i)) AS marks FROM step GROUP BY path),
each AS (SELECT path, unnest(marks) AS m, unnest(list_prepend(1, list_transform(marks, lambda m: m.e))) AS begin FROM placed),
joined AS (SELECT each.path, string_agg({_escaped('substring(text, begin, m.s - begin)')} || '<mark data-category="' || m.c
        || '">' || {_escaped('substring(text, m.s, m.e - m.s)')} || '</mark>', '' ORDER BY m.s) AS head, max(m.e) AS rest
    FROM each JOIN forms ON forms.path = each.path WHERE m IS NOT NULL GROUP BY each.path)
SELECT forms.path, coalesce(head, '') || {_escaped('substring(text, coalesce(rest, 1))')} AS preview
FROM forms LEFT JOIN joined ON joined.path = forms.path""").replace("WITH ", "WITH RECURSIVE ", 1)
_FLAGGED = f"(SELECT DISTINCT doc_id FROM ({_DOC_ROWS}) AS g)"
ORACLE["stream_flush"] = f"""
SELECT lane, rows // 50 AS full_flushes, rows // 50 * 50 AS rows_in_full_flushes, rows % 50 AS rows_in_timed_flushes, flagged
FROM (SELECT d.doc_id % {LANES} AS lane, count(*) AS rows, count(f.doc_id) AS flagged
      FROM documents AS d LEFT JOIN {_FLAGGED} AS f ON f.doc_id = d.doc_id GROUP BY 1) AS n"""
ORACLE["stream_dead_letters"] = f"""
SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'dead' ELSE 'done' END AS outcome,
    CAST(CASE WHEN d.doc_id % 7 = 0 THEN 4 WHEN d.doc_id % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempt,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN f.doc_id IS NULL THEN 'not_flagged' ELSE 'flagged' END AS status_flag
FROM documents AS d LEFT JOIN {_FLAGGED} AS f ON f.doc_id = d.doc_id"""
ORACLE["tree_texts"] = """
SELECT lang, source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
FROM documents GROUP BY lang, source"""
ORACLE["ranged_findings"] = _with("forms", f"""
SELECT kind, category, snippet, count(*) AS n FROM ({_resolved('forms', 'path')}) AS s
CROSS JOIN (VALUES ('plain'), ('table')) AS kinds(kind) GROUP BY kind, category, snippet""")
_SNAPSHOT = PLAIN["kpi_snapshot"]
ORACLE["scan_snapshot"] = f"""
SELECT s.* REPLACE (captured_at + n AS captured_at, label AS run_label) FROM ({_SNAPSHOT}) AS s
CROSS JOIN (VALUES (0, 'full:run0'), (1, 'delta:run1')) AS runs(n, label)"""
ORACLE["report_rows"] = _with("forms", f"""
SELECT forms.path, NOT contains(forms.path, '/internal_memo_') AS is_pii, coalesce(n, 0) AS n_findings
FROM forms LEFT JOIN (SELECT path, count(*) AS n FROM ({_FORM_ROWS}) AS g GROUP BY path) AS f ON f.path = forms.path""")
ORACLE["report_summary"] = _with("forms", f"""
SELECT unnest(['files_processed', 'errors', 'tp', 'fp', 'fn', 'detector']) AS name,
    unnest([CAST(files_processed AS VARCHAR), CAST(errors AS VARCHAR), CAST(tp AS VARCHAR), CAST(fp AS VARCHAR),
            CAST(fn AS VARCHAR), detector]) AS figure
FROM ({_confusion(_FORM_ROWS, 'rules')}) AS c""")

ORACLE = {name: sql.replace(") \n,", "),").replace(") ,", "),") for name, sql in ORACLE.items()}
