"""The SQL twins of the queries, for DuckDB on the same tables.

DuckDB's patterns know no look-around, so guards become consumed characters around a group.
"""

from __future__ import annotations

from sievemark import fixed_values as V
from workload.derived import RELATIONS

ORACLE: dict[str, str] = {}
NOW = 1_700_000_000.0
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(names: str, body: str) -> str:
    """The body with the named relations in front."""
    ctes = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names.split())
    return f"WITH {ctes} {body}"


def _store(part: int, default: str | None) -> str:
    name = "lower(regexp_extract(path, '[^/]*$'))"
    whens = " ".join(
        f"WHEN contains({name}, {_q(rule[0])}) THEN "
        + ("NULL" if rule[part] is None else _q(rule[part])) for rule in V.STORE_RULES)
    return f"CASE {whens} ELSE {_q(default)} END"


_SOURCE, _STEWARD = _store(1, V.DEFAULT_STORE[0]), _store(2, V.DEFAULT_STORE[1])
# ---- document rules -------------------------------------------------------------------------

_DIGIT = "regexp_matches(x, '[0-9]')"


def _digits(low: str) -> str:
    return f"length(regexp_replace(x, '[^0-9]', '', 'g')) {low}"


def _line(labels: str) -> str:
    return V.LINE_VALUE.format(labels=labels)


def _id(labels: str, token: str) -> str:
    return V.ID_VALUE.replace("{labels}", labels).replace("{token}", token)


_PHONE = r"(?:^|[^0-9_\pL])((?:\+\d{1,3}[\s.\-/]?)?(?:\(?\d{2,5}\)?[\s.\-/]?){2,5}\d{2,})(?:[^0-9_\pL]|$)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_IPV4 = rf"(?:^|[^0-9])((?:{_OCTET}\.){{3}}{_OCTET})(?:[^0-9]|$)"
_IPV6 = V.IPV6.replace(r"(?<![:\w])", "")
_CARD = V.CREDIT_CARD.replace(r"(?<!\d)", r"(?:^|[^0-9])(").replace(r"(?!\d)", r")(?:[^0-9]|$)")
_SSN = (r"(?:^|[^0-9])((?:0(?:0[1-9]|[1-9]\d)|[1-578]\d\d|6(?:[0-57-9]\d|6[0-57-9]))"
        r"[\s\-]\d{2}[\s\-]\d{4})(?:[^0-9]|$)")

# detector, category, pattern, group, condition
_RULES = (
    ("emails", "email", V.EMAIL, 0, "true"),
    ("phones", "fax", _line(V.FAX_LABELS), 1, _DIGIT),
    ("phones", "phone", _line(V.PHONE_LABELS), 1, _DIGIT),
    ("phones", "phone", _PHONE, 1, _digits(">= 7")),
    ("usernames", "username", _line(V.USERNAME_LABELS), 1, "true"),
    ("usernames", "username", V.EMPLOYEE_ID, 0, "true"),
    ("signatures", "signature", _line(V.SIGNATURE_LABELS_DOCUMENT), 1, "true"),
    ("id_documents", "passport", _id(V.PASSPORT_LABELS, V.ID_TOKEN_DOCUMENT), 1, _DIGIT),
    ("id_documents", "drivers_license", _id(V.LICENSE_LABELS, V.ID_TOKEN_DOCUMENT), 1, _DIGIT),
    ("id_documents", "id_card", _id(V.ID_CARD_LABELS, V.ID_TOKEN_DOCUMENT), 1, _DIGIT),
    ("ip_addresses", "ip_address", _IPV4, 1, "true"),
    ("ip_addresses", "ip_address", _IPV6, 0, "true"),
    ("credit_cards", "credit_card", _CARD, 1, _digits("IN (13, 15, 16)")),
    ("iban", "iban", V.IBAN, 0, "length(x) >= 15"),
    ("ssn", "ssn", _SSN, 1, "true"),
    ("dob", "date_of_birth", V.DATE_OF_BIRTH, 1, "true"),
)


def _rule_rows(source: str, key: str, text: str, detectors: tuple[str, ...] | None = None) -> str:
    """Distinct (key, ord, category, snippet) of the chosen rules over a table."""
    parts = [
        f"SELECT {key}, {i} AS rule, '{category}' AS category, unnest(list_filter("
        f"regexp_extract_all({text}, {_q(pattern)}, {group}), lambda x: {keep})) AS raw FROM {source}"
        for i, (detector, category, pattern, group, keep) in enumerate(_RULES)
        if detectors is None or detector in detectors]
    union = " UNION ALL ".join(parts)
    return (f"SELECT {key}, category, snippet, min(rule) AS rule FROM ("
            f"SELECT {key}, rule, category, trim(raw, {_WS}) AS snippet FROM ({union}) AS u) AS s "
            f"WHERE length(snippet) BETWEEN 1 AND 200 AND regexp_matches(snippet, '[A-Za-z0-9]') "
            f"GROUP BY {key}, category, snippet")


_DOC_ROWS = _rule_rows("documents", "doc_id", "text")
_FORM_ROWS = _rule_rows("forms", "path", "text")
ORACLE["findings_by_category"] = (
    f"SELECT category, count(*) AS n FROM ({_DOC_ROWS}) AS f GROUP BY category")
ORACLE["document_findings"] = (
    f"SELECT doc_id, category, snippet, 'regex' AS source FROM ({_DOC_ROWS}) AS f")
for _name in ("emails", "phones", "ip_addresses", "credit_cards"):
    ORACLE[f"documents_{_name}"] = (
        "SELECT doc_id, category, snippet FROM "
        f"({_rule_rows('documents', 'doc_id', 'text', (_name,))}) AS f")
for _name in dict.fromkeys(r[0] for r in _RULES):
    ORACLE[f"forms_{_name}"] = _with(
        "forms", "SELECT path, category, snippet FROM "
                 f"({_rule_rows('forms', 'path', 'text', (_name,))}) AS f")
ORACLE["forms_findings_by_category"] = _with(
    "forms", "SELECT category, count(*) AS n, count(DISTINCT path) AS files "
             f"FROM ({_FORM_ROWS}) AS f GROUP BY category")
ORACLE["primary_category"] = _with(
    "forms", f"""SELECT forms.path, f.category FROM forms LEFT JOIN (
    SELECT path, arg_min(category, rule) AS category FROM ({_FORM_ROWS}) AS g GROUP BY path) AS f
    ON forms.path = f.path""")
ORACLE["flag_status"] = _with(
    "forms", f"""SELECT CASE WHEN f.path IS NULL THEN 'not_flagged' ELSE 'flagged' END
    AS status_flag, count(*) AS files FROM forms LEFT JOIN (
    SELECT DISTINCT path FROM ({_FORM_ROWS}) AS g) AS f ON forms.path = f.path GROUP BY 1""")
ORACLE["page_source_findings"] = (
    "SELECT page_id, category, snippet FROM "
    f"({_rule_rows('pages', 'page_id', 'html')}) AS f")
_TURN_ROWS = _rule_rows(
    "(SELECT conv_id * 100000 + turn AS turn_id, text FROM conversations) AS c", "turn_id", "text")
ORACLE["conversation_exposure"] = f"""
SELECT role, count(*) AS turns, count(f.turn_id) AS flagged FROM conversations
LEFT JOIN (SELECT DISTINCT turn_id FROM ({_TURN_ROWS}) AS g) AS f
ON conv_id * 100000 + turn = f.turn_id GROUP BY role"""

# ---- form rules -----------------------------------------------------------------------------

_ROLES = ", ".join(_q(w) for w in V.ROLE_WORDS)
_PERSON = ("NOT contains(x, '@') AND NOT regexp_matches(x, '[0-9]') AND len(list_filter("
           f"regexp_split_to_array(lower(trim(x, {_WS})), '\\s+'), "
           f"lambda w: trim(w, '.') NOT IN ({_ROLES}))) > 0")
# category, pattern, value group, confidence
_FORM_RULES = (
    ("name", V.NAME.format(labels=V.NAME_LABELS), 1, 0.95),
    ("email", V.EMAIL, 0, 0.98),
    ("fax", _line(V.FAX_LABELS), 1, 0.95),
    ("phone", _line(V.PHONE_LABELS), 1, 0.95),
    ("signature", _line(V.SIGNATURE_LABELS_FORM), 1, 0.9),
    ("photo_video", V.PHOTO_VIDEO, 0, 0.8),
    ("passport", _id(V.PASSPORT_LABELS, V.ID_TOKEN_FORM), 1, 0.95),
    ("drivers_license", _id(V.LICENSE_LABELS, V.ID_TOKEN_FORM), 1, 0.95),
    ("id_card", _id(V.ID_CARD_LABELS, V.ID_TOKEN_FORM), 1, 0.9),
    ("username", _line(V.USERNAME_LABELS), 1, 0.9),
    ("username", V.EMPLOYEE_ID, 0, 0.85),
    ("billing_shipping_address", _line(V.BILLING_LABELS), 1, 0.9),
    ("home_address", _line(V.ADDRESS_LABELS), 1, 0.88),
    ("home_address", V.STREET, 0, 0.7),
    ("home_address", V.POSTAL, 0, 0.7),
    ("travel_history", V.TRAVEL, 0, 0.7),
)


def _span_rows(source: str, key: str) -> str:
    """Offsets from the gaps and matches of each pattern, as one row per usable match."""
    parts = []
    for i, (category, pattern, group, confidence) in enumerate(_FORM_RULES):
        before = "0"
        if group:
            head = pattern.split("(?P<val>", 1)[0]
            flags, rest = head.split(")", 1)
            before = f"length(regexp_extract(m, {_q(flags + ')^' + rest)}))"
            value = f"regexp_extract(m, {_q(pattern)}, 1)"
        else:
            value = "m"
        parts.append(f"""
        SELECT {key}, {i} AS rule, '{category}' AS category, pos + {before} AS start,
               {value} AS x, CAST({confidence} AS DOUBLE) AS confidence
        FROM (SELECT {key}, ms[i] AS m,
                     list_sum(list_transform(gs[1:i], lambda g: length(g)))
                     + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS pos
              FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i
                    FROM (SELECT {key}, regexp_extract_all(text, {_q(pattern)}) AS ms,
                                 regexp_split_to_array(text, {_q(pattern)}) AS gs
                          FROM {source}) AS a) AS b) AS c""")
    union = " UNION ALL ".join(parts)
    return f"""SELECT {key}, rule, category, CAST(start AS INTEGER) AS start,
        CAST(start + length(x) AS INTEGER) AS "end", trim(x, {_WS}) AS snippet, confidence
        FROM ({union}) AS u WHERE (category <> 'name' OR ({_PERSON}))
        AND (category NOT IN ('fax', 'phone', 'passport', 'drivers_license', 'id_card')
             OR {_DIGIT})
        AND length(trim(x, {_WS})) BETWEEN 1 AND 200 AND regexp_matches(x, '[A-Za-z0-9]')"""


def _resolved(source: str, key: str) -> str:
    """Drop a span that overlaps a surer one of its category, or an equal one in front of it.

    Overlaps in these texts are one label value around free matches, for which this equals the
    stepwise rule; the stepwise rule itself is checked against brute force in the tests.
    """
    rows = _span_rows(source, key)
    return f"""SELECT a.* FROM ({rows}) AS a WHERE NOT EXISTS (
        SELECT 1 FROM ({rows}) AS b WHERE a.{key} = b.{key} AND a.category = b.category
        AND a.start < b."end" AND b.start < a."end" AND (b.confidence > a.confidence OR (
            b.confidence = a.confidence AND (b.start < a.start OR (
                b.start = a.start AND b.rule < a.rule)))))"""


def _case(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


_PRIORITY = _case("category", {k: v[2] for k, v in V.CATEGORIES.items()}, "'low'")
_RANK = f"CASE {_PRIORITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_LABEL = _case("category", {k: v[0] for k, v in V.CATEGORIES.items()}, "category")


def _articles(separator: str) -> str:
    contact = ", ".join(_q(c) for c in V.CONTACT_CATEGORIES)
    return (f"CASE WHEN {_PRIORITY} = 'high' THEN {_q(separator.join(V.ARTICLES_HIGH))} "
            f"WHEN category IN ({contact}) THEN {_q(separator.join(V.ARTICLES_CONTACT))} "
            f"ELSE {_q(separator.join(V.ARTICLES_ALL))} END")


_SPANS = 'category, start, "end", snippet, confidence'
ORACLE["form_spans"] = _with(
    "forms", f"SELECT path, {_SPANS} FROM ({_span_rows('forms', 'path')}) AS s")
ORACLE["form_findings"] = _with(
    "forms", f"""SELECT path, {_SPANS}, 'regex' AS detector, {_articles('|')} AS articles
    FROM ({_resolved('forms', 'path')}) AS s""")
ORACLE["form_categories"] = _with(
    "forms", f"""SELECT category, count(*) AS n, {_PRIORITY} AS priority
    FROM ({_resolved('forms', 'path')}) AS s GROUP BY category""")
ORACLE["document_form_findings"] = (
    f"SELECT doc_id, {_SPANS} FROM ({_resolved('documents', 'doc_id')}) AS s")
_STORED = f"""
SELECT substring(sha256(file_id || ':' || category || ':' || start), 1, 16) AS id, file_id,
       category, snippet, 'open' AS status
FROM (SELECT substring(sha256(path), 1, 16) AS file_id, * FROM
      ({_resolved('forms', 'path')}) AS s) AS t"""
ORACLE["finding_ids"] = _with("forms", _STORED)
ORACLE["full_scan_findings"] = _with(
    "forms", f"SELECT id, file_id, category, status FROM ({_STORED}) AS t")
_TOKEN = "[A-Za-z0-9][A-Za-z0-9.@+/_-]{2,}"
ORACLE["masked_snippets"] = _with("forms", f"""
SELECT path, category, snippet, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i]
    || coalesce(CASE WHEN length(ts[i]) <= 3 THEN ts[i] ELSE substring(ts[i], 1, 1)
       || repeat('•', least(length(ts[i]) - 1, 6)) END, '')), '') AS masked
FROM (SELECT path, category, snippet, regexp_extract_all(snippet, '{_TOKEN}') AS ts,
             regexp_split_to_array(snippet, '{_TOKEN}') AS gs FROM ({_FORM_ROWS}) AS f) AS g""")

_SHOWN_ROWS = f"SELECT *, {_LABEL} AS label, {_articles('|')} AS laws FROM (" + _resolved(
    "forms", "path") + ") AS s"
ORACLE["explanations"] = _with("forms", f"""
, f AS ({_SHOWN_ROWS}),
types AS (SELECT path, list(lower(label) ORDER BY seen) AS ts FROM (
    SELECT path, label, min((start, category)) AS seen FROM f GROUP BY path, label) AS t
    GROUP BY path),
laws AS (SELECT path, string_agg(DISTINCT law, ', ' ORDER BY law) AS ls FROM (
    SELECT path, unnest(string_split(laws, '|')) AS law FROM f) AS l GROUP BY path),
n AS (SELECT path, count(*) AS n FROM f GROUP BY path)
SELECT n.path, '“' || regexp_extract(n.path, '[^/]*$') || '” was flagged because the scanner detected '
    || n || CASE n WHEN 1 THEN ' item' ELSE ' items' END || ' of personal data — '
    || CASE len(ts) WHEN 1 THEN ts[1] ELSE array_to_string(ts[1:len(ts) - 1], ', ') || ' and '
       || ts[len(ts)] END || '. ' || replace({_q(V.EXPLAIN_DUTY)}, '{{articles}}', ls)
    || {_q(V.EXPLAIN_REVIEW)} AS explanation
FROM n JOIN types ON types.path = n.path JOIN laws ON laws.path = n.path""")
ORACLE["explanation_prompts"] = _with("forms", f"""
, f AS ({_SHOWN_ROWS}),
lines AS (SELECT path, string_agg('- ' || label || ' (' || CAST(floor(confidence * 100 + 0.5)
    AS INTEGER) || '% confidence): "' || snippet || '"', chr(10) ORDER BY start, category) AS ls
    FROM f GROUP BY path)
SELECT forms.path, CAST(w.part AS INTEGER) AS part, array_to_string([{', '.join(_q(x) for x in V.PROMPT_HEAD)},
    'File name: ' || regexp_extract(forms.path, '[^/]*$'), 'Source: '
    || {_SOURCE.replace('path', 'forms.path')}, '', 'Detected personal data:', ls, '',
    'File excerpt:', repeat('"', 3)
    || substring(w.text, CAST(w.part * 1200 + 1 AS BIGINT), 1200) || repeat('"', 3), '', 'Explanation:'], chr(10)) AS prompt
FROM lines JOIN (SELECT path, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1200.0) AS BIGINT)))) AS part
    FROM forms) AS w ON w.path = lines.path JOIN forms ON forms.path = lines.path""")
_PRETTY = "array_to_string(list_transform(string_split(replace(category || '_x y', '_', ' '), ' '), " \
          "lambda w: upper(w[1]) || w[2:]), ' ')"
ORACLE["category_guide"] = _with("findings", f"""
SELECT category, {_LABEL} AS label, {_PRETTY} AS unknown_label,
    {_case('category', {k: v[1] for k, v in V.CATEGORIES.items()}, _q(V.DEFAULT_ICON))} AS icon,
    {_case('category', {k: v[4] for k, v in V.CATEGORIES.items()}, "''")} AS reason
FROM (SELECT DISTINCT category FROM findings) AS c""")
ORACLE["redacted_texts"] = _with("forms", f"""
, r AS ({_resolved('forms', 'path')}),
o AS (SELECT path, category, start, "end", max("end") OVER w AS until,
        lead(start) OVER (PARTITION BY path ORDER BY start, "end", category) AS next,
        coalesce(max("end") OVER (PARTITION BY path ORDER BY start, "end", category
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM r WINDOW w AS (PARTITION BY path ORDER BY start, "end", category
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
j AS (SELECT forms.path, min(o.start) AS first, string_agg(
        CASE WHEN o.start >= before THEN '[' || category || ']' ELSE '' END || CASE
            WHEN coalesce(next, length(text)) > until
            THEN substring(text, until + 1, coalesce(next, length(text)) - until) ELSE '' END,
        '' ORDER BY o.start, o."end", category) AS rest
    FROM o JOIN forms ON forms.path = o.path GROUP BY forms.path)
SELECT forms.path, CASE WHEN rest IS NULL THEN text ELSE substring(text, 1, first) || rest END AS text
FROM forms LEFT JOIN j ON j.path = forms.path""")

# ---- registry figures -----------------------------------------------------------------------

_PROCESSED = "status_flag IS DISTINCT FROM 'not checked'"
_PCT = ("CASE WHEN count(*) FILTER (WHERE {p}) > 0 THEN CAST(count(*) FILTER (WHERE "
        "status_flag = 'flagged') AS DOUBLE) / count(*) FILTER (WHERE {p}) * 100 ELSE 0 END"
        ).replace("{p}", _PROCESSED)
_OWNED = "owner IS NOT NULL AND owner <> ''"
_TOTALS = f"""count(*) AS total_files_registered,
    count(*) FILTER (WHERE status_flag = 'flagged') AS total_files_flagged,
    count(*) FILTER (WHERE {_PROCESSED}) AS total_files_processed"""
ORACLE["kpi_total_files_registered"] = _with("registry", "SELECT count(*) AS value FROM registry")
ORACLE["kpi_total_files_flagged"] = _with(
    "registry", "SELECT count(*) AS value FROM registry WHERE status_flag = 'flagged'")
ORACLE["kpi_total_files_processed"] = _with(
    "registry", f"SELECT count(*) AS value FROM registry WHERE {_PROCESSED}")
ORACLE["kpi_percentage_files_flagged"] = _with(
    "registry", f"SELECT round({_PCT}, 6) AS value FROM registry")
ORACLE["kpi_totals"] = _with(
    "registry", f"SELECT {_TOTALS}, round({_PCT}, 6) AS percentage_files_flagged FROM registry")
ORACLE["kpi_owners"] = _with("registry", f"SELECT DISTINCT owner FROM registry WHERE {_OWNED}")
ORACLE["kpi_flagged_per_owner"] = _with(
    "registry", f"""SELECT owner, count(*) AS flagged_files FROM registry
    WHERE status_flag = 'flagged' AND {_OWNED} GROUP BY owner""")
_OWNER_FILES = """SELECT owner, file_id AS id, name AS path, 'gdrive' AS source_type,
    CAST(0 AS BIGINT) AS size_bytes, CAST(epoch(google_created_at) AS DOUBLE) AS last_modified,
    nullif(CAST(epoch(last_seen_at) AS DOUBLE), 0) AS last_scanned_at,
    CAST(1 AS BIGINT) AS n_findings, coalesce(pii_category, '') AS finding_categories
    FROM registry WHERE status_flag = 'flagged'"""
ORACLE["owner_flagged_files"] = _with("registry", f"{_OWNER_FILES} AND {_OWNED}")
ORACLE["one_owner_flagged_files"] = _with(
    "registry", f"{_OWNER_FILES} AND owner = 'hub@example.com'")
ORACLE["clean_owners"] = _with(
    "registry", f"""SELECT DISTINCT owner FROM registry WHERE {_OWNED} AND owner NOT IN (
    SELECT owner FROM registry WHERE status_flag = 'flagged' AND owner IS NOT NULL)""")
ORACLE["kpi_snapshot"] = _with("registry", f"""
SELECT CAST({NOW} AS DOUBLE) AS captured_at, 'manual' AS run_label, {_TOTALS},
       CAST(CAST({_PCT} AS DECIMAL(7, 2)) AS DOUBLE) AS percentage_files_flagged,
       (SELECT count(DISTINCT owner) FROM registry WHERE {_OWNED}) AS owner_count,
       (SELECT count(DISTINCT owner) FROM registry WHERE {_OWNED} AND status_flag = 'flagged')
           AS flagged_owner_count
FROM registry""")
ORACLE["kpi_snapshot_owners"] = _with("registry", f"""
SELECT 'full:1' AS run_label, owner,
       count(*) FILTER (WHERE status_flag = 'flagged') AS flagged_files
FROM registry WHERE {_OWNED} GROUP BY owner""")
ORACLE["snapshot_latest"] = _with("runs", """
SELECT started_at AS captured_at, type || ':' || id AS run_label,
       files_scanned AS total_files_registered, files_flagged AS total_files_flagged
FROM runs ORDER BY started_at DESC LIMIT 20""")
ORACLE["outcome_split"] = _with("registry", f"""
, t AS (SELECT {_TOTALS} FROM registry), o AS (
SELECT 'Flagged (contains PII)' AS outcome, total_files_flagged AS files FROM t
UNION ALL SELECT 'Not flagged', greatest(0, total_files_processed - total_files_flagged) FROM t
UNION ALL SELECT 'Not yet processed', total_files_registered - total_files_processed FROM t
    WHERE total_files_registered > total_files_processed)
SELECT outcome, CAST(files AS BIGINT) AS files, (SELECT round(CAST(total_files_processed AS DOUBLE)
    / total_files_registered * 100, 6) FROM t) AS processed_percent FROM o""")
ORACLE["owner_share_rank"] = _with("registry", f"""
, c AS (SELECT owner, count(*) AS flagged_files FROM registry
        WHERE status_flag = 'flagged' AND {_OWNED} GROUP BY owner)
SELECT row_number() OVER (ORDER BY flagged_files DESC, owner) AS rank, owner, flagged_files,
       round(CAST(flagged_files AS DOUBLE) / sum(flagged_files) OVER () * 100, 6) AS share FROM c""")

# ---- listing, upserts, status ---------------------------------------------------------------

_MIMES = ", ".join(_q(m) for m in (*V.EXPORT_TYPES, *V.STORED_TYPES))
_LISTED = f"""SELECT id AS file_id, name, mime AS mime_type, created AS modified_time,
    CASE owners WHEN 'none' THEN 'admin@admin.com' WHEN 'mail' THEN email END AS owner,
    coalesce(trashed, false) AS deleted
    FROM listing WHERE mime IN ({_MIMES}) OR starts_with(mime, 'video/')"""
ORACLE["listing_ingest"] = _with(
    "listing", f"SELECT * REPLACE (CAST(epoch(modified_time) AS DOUBLE) AS modified_time) "
               f"FROM ({_LISTED}) AS l")
_EXT = {**V.STORED_TYPES, **{k: v[1] for k, v in V.EXPORT_TYPES.items()}}
ORACLE["file_types"] = _with("listing", f"""
SELECT id, mime, {_case('mime', {k: v[0] for k, v in V.EXPORT_TYPES.items()}, 'NULL')}
    AS export_type, {_case('mime', _EXT, "lower(regexp_extract(name, '[.][^.]+$'))")} AS extension
FROM listing""")
_UPSERTED = f"""SELECT coalesce(r.file_id, l.file_id) AS file_id,
    CASE WHEN l.file_id IS NOT NULL THEN l.name ELSE r.name END AS name,
    CASE WHEN l.file_id IS NOT NULL THEN l.mime_type ELSE r.mime_type END AS mime_type,
    CASE WHEN l.file_id IS NOT NULL THEN l.owner ELSE r.owner END AS owner,
    CAST(epoch(CASE WHEN r.file_id IS NOT NULL THEN r.google_created_at ELSE l.modified_time END)
        AS DOUBLE) AS google_created_at,
    CASE WHEN l.file_id IS NOT NULL THEN l.deleted ELSE r.is_deleted END AS is_deleted,
    CASE WHEN l.file_id IS NOT NULL THEN CAST({NOW} AS DOUBLE)
        ELSE CAST(epoch(r.last_seen_at) AS DOUBLE) END AS last_seen_at,
    r.status_flag, r.detection_stage, r.pii_category, r.user_action
    FROM registry AS r FULL JOIN ({_LISTED}) AS l ON r.file_id = l.file_id"""
ORACLE["registry_upsert"] = _with("registry listing", _UPSERTED)
ORACLE["owner_states"] = _with("registry listing", f"""
, asked AS (SELECT owner FROM ({_LISTED}) AS l UNION SELECT owner FROM registry),
n AS (SELECT owner, count(*) FILTER (WHERE status_flag = 'flagged') AS n FROM registry GROUP BY owner)
SELECT asked.owner, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 0 THEN 'empty' ELSE 'flagged' END AS state
FROM asked LEFT JOIN n ON n.owner = asked.owner WHERE asked.owner <> ''""")
ORACLE["unchecked_files"] = _with("registry listing", f"""
SELECT l.file_id, '{{"file_id":"' || l.file_id || '","name":"' || l.name || '","mime_type":"'
    || l.mime_type || '"}}' AS value
FROM ({_LISTED}) AS l LEFT JOIN registry AS r ON r.file_id = l.file_id
WHERE r.status_flag IS NULL OR r.status_flag = 'not_checked'""")
_ANY_LAST = """last AS (SELECT file_id, arg_max(action, (ts, action)) AS action FROM decisions
    GROUP BY file_id)"""
_ACTIONS = ", ".join(_q(a) for a in V.ACTION_STATUS)
_LAST = _ANY_LAST.replace("FROM decisions", f"FROM decisions WHERE action IN ({_ACTIONS})")
ORACLE["rejected_decisions"] = _with("decisions", f"""
SELECT action, count(*) AS n FROM decisions WHERE action NOT IN ({_ACTIONS}) GROUP BY action""")
ORACLE["batch_status_update"] = _with("registry decisions", f"""
, {_ANY_LAST} SELECT r.file_id,
    CASE WHEN l.action IS NULL THEN status_flag WHEN action = 'keep' THEN 'not_flagged'
        ELSE 'flagged' END AS status_flag,
    CASE WHEN l.action IS NULL THEN detection_stage ELSE 'regex' END AS detection_stage,
    coalesce(l.action, pii_category) AS pii_category,
    CASE WHEN l.action IS NULL THEN CAST(epoch(last_seen_at) AS DOUBLE)
        ELSE CAST({NOW} AS DOUBLE) END AS last_seen_at
FROM registry AS r LEFT JOIN last AS l ON r.file_id = l.file_id""")
_STATUS = _case("action", V.ACTION_STATUS, "NULL")
ORACLE["file_decisions_applied"] = _with("registry decisions", f"""
, {_LAST} SELECT coalesce({_STATUS}, user_action) AS user_action, count(*) AS files
FROM registry AS r LEFT JOIN last AS l ON r.file_id = l.file_id GROUP BY 1""")
ORACLE["finding_decisions_applied"] = _with("findings decisions", f"""
, {_LAST} SELECT coalesce({_STATUS}, status) AS status, count(*) AS findings
FROM findings AS f LEFT JOIN last AS l ON f.file_id = l.file_id GROUP BY 1""")
ORACLE["decision_outcomes"] = _with("registry decisions", f"""
, {_LAST} SELECT l.file_id, {_STATUS} AS status, r.file_id IS NOT NULL AS updated
FROM last AS l LEFT JOIN registry AS r ON r.file_id = l.file_id""")
_LIST_FILES = """listed AS (SELECT path, size_bytes, last_modified FROM files UNION ALL
    SELECT '/share/new/training_' || c_custkey || '.txt', c_custkey, CAST(1.65e9 AS DOUBLE)
    FROM customer)"""
ORACLE["delta_selection"] = _with("files", f"""
, {_LIST_FILES} SELECT listed.path, substring(sha256(listed.path), 1, 16) AS id,
    coalesce(last_scanned_at IS NOT NULL AND listed.last_modified <= last_scanned_at, false)
        AS skipped
FROM listed LEFT JOIN files ON files.path = listed.path""")


ORACLE["file_upsert"] = _with("files", f"""
, {_LIST_FILES} SELECT substring(sha256(l.path), 1, 16) AS id, l.path,
    CASE WHEN f.path IS NULL THEN {_SOURCE.replace('path', 'l.path')} ELSE f.source_type END
        AS source_type,
    l.size_bytes + 1 AS size_bytes, l.last_modified, 'u1' AS owner_user_id,
    CAST(NULL AS VARCHAR) AS master_of_data_user_id, f.last_scanned_at
FROM listed AS l LEFT JOIN files AS f ON f.path = l.path""")
ORACLE["status_carryover"] = _with("findings", f"""
, open_files AS (SELECT 'f' || o_orderkey AS file_id FROM orders WHERE o_orderstatus = 'O'),
new AS (SELECT id, file_id, created_at FROM findings WHERE confidence > 0.6 AND file_id IN (
            SELECT file_id FROM open_files)
        UNION ALL SELECT 'x' || file_id, file_id, CAST({NOW} AS DOUBLE) FROM open_files)
SELECT id, file_id, status, created_at FROM findings
WHERE file_id NOT IN (SELECT file_id FROM open_files)
UNION ALL
SELECT new.id, new.file_id, coalesce(old.status, 'open'), new.created_at
FROM new LEFT JOIN findings AS old ON old.id = new.id""")

# ---- ownership ------------------------------------------------------------------------------

ORACLE["ownership_resolve"] = _with("files users", f"""
, emp AS (SELECT * FROM users WHERE role = 'employee'),
first AS (SELECT arg_min(id, (name, id)) AS id FROM emp),
subj AS (SELECT lower(name) AS target, arg_min(id, (name, id)) AS id FROM emp GROUP BY 1),
typed AS (SELECT f.id, f.path, upper(u.name) AS named, {_SOURCE} AS source_type,
                 {_STEWARD} AS steward
          FROM files AS f JOIN orders AS o ON f.id = 'f' || o.o_orderkey
          LEFT JOIN users AS u ON u.id = 'u' || o.o_custkey)
SELECT t.id, t.path, t.source_type,
    CASE WHEN source_type = 'onedrive' THEN coalesce(subj.id, (SELECT id FROM first)) END
        AS owner_user_id,
    CASE WHEN source_type <> 'onedrive' THEN coalesce(
        (SELECT id FROM users WHERE users.id = t.steward), (SELECT id FROM first)) END
        AS master_of_data_user_id
FROM typed AS t LEFT JOIN subj ON subj.target = lower(t.named)""")
_PER_FILE = """per_file AS (SELECT file_id, count(*) AS n_findings,
    string_agg(DISTINCT category, ',' ORDER BY category) AS categories
    FROM findings GROUP BY file_id)"""
ORACLE["responsible_files"] = _with("files findings", f"""
, {_PER_FILE} SELECT coalesce(owner_user_id, master_of_data_user_id) AS user_id, id, n_findings,
    categories FROM files JOIN per_file ON id = file_id""")
ORACLE["one_person_files"] = _with("files findings", f"""
, {_PER_FILE} SELECT id, path, last_modified, n_findings, categories
FROM files JOIN per_file ON id = file_id
WHERE owner_user_id = 'u0' OR master_of_data_user_id = 'u0'""")
ORACLE["one_person_files_oldest_first"] = ORACLE["one_person_files"]
ORACLE["source_breakdown"] = _with("files findings", f"""
, {_PER_FILE} SELECT source_type, count(*) AS n_files,
    CAST(coalesce(sum(n_findings), 0) AS BIGINT) AS n_findings,
    CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM files LEFT JOIN per_file ON id = file_id GROUP BY source_type""")
ORACLE["owner_names"] = _with("files findings users", """
, o AS (SELECT coalesce(owner_user_id, master_of_data_user_id) AS user_id,
               count(*) AS flagged_files
        FROM files WHERE id IN (SELECT file_id FROM findings) GROUP BY 1)
SELECT o.user_id, flagged_files, coalesce(u.name, o.user_id) AS user_name
FROM o LEFT JOIN users AS u ON u.id = o.user_id""")

# ---- store figures --------------------------------------------------------------------------

ORACLE["category_breakdown"] = _with(
    "findings", f"SELECT category, count(*) AS n, {_PRIORITY} AS priority FROM findings "
                "GROUP BY category")
ORACLE["category_articles"] = _with(
    "findings", f"SELECT DISTINCT category, {_LABEL} AS label, {_PRIORITY} AS priority, "
                f"{_articles(', ')} AS articles FROM findings")
ORACLE["store_kpis"] = _with("files findings runs", """
, last AS (SELECT * FROM runs ORDER BY started_at DESC LIMIT 1)
SELECT count(*) FILTER (WHERE last_scanned_at IS NOT NULL) AS files_scanned,
    (SELECT count(DISTINCT file_id) FROM findings) AS files_flagged,
    CAST(sum(size_bytes) FILTER (WHERE last_scanned_at IS NOT NULL) AS BIGINT) AS bytes_scanned,
    (SELECT count(*) FROM findings) AS total_findings,
    (SELECT type FROM last) AS last_scan_type,
    (SELECT finished_at - started_at FROM last) AS last_scan_duration,
    (SELECT progress_pct FROM last) AS last_scan_progress,
    (SELECT files_skipped FROM last) AS last_scan_skipped
FROM files""")
ORACLE["corpus_kpis"] = _with("files findings", f"""
, {_PER_FILE} SELECT count(*) AS files_processed, count(n_findings) AS files_flagged,
    CAST(sum(n_findings) AS BIGINT) AS total_findings,
    CAST(sum(size_bytes) AS BIGINT) AS bytes_scanned,
    count(*) - count(n_findings) AS files_not_flagged,
    round(CAST(count(n_findings) AS DOUBLE) / count(*) * 100, 6) AS percent_flagged
FROM files LEFT JOIN per_file ON id = file_id""")
ORACLE["latest_run"] = _with("runs", "SELECT * FROM runs ORDER BY started_at DESC LIMIT 1")
ORACLE["scan_history_trend"] = _with("runs", """
SELECT row_number() OVER w AS position, id, type, started_at, files_scanned, files_flagged,
    files_scanned - files_flagged AS files_not_flagged,
    CAST(floor(CAST(files_flagged AS DOUBLE) / files_scanned * 100 + 0.5) AS BIGINT)
        AS flagged_percent,
    started_at = (SELECT max(started_at) FROM runs) AS is_latest,
    files_flagged - lag(files_flagged) OVER w AS flagged_change
FROM runs WINDOW w AS (ORDER BY started_at, id)""")
ORACLE["confidence_bands"] = _with("findings", """
SELECT CASE WHEN confidence >= 0.8 THEN 'likely' WHEN confidence >= 0.5 THEN 'possible'
           ELSE 'low' END AS band, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent,
       count(*) AS n, format('{:,}', count(*)) AS shown
FROM findings GROUP BY 1, 2""")

# ---- review ---------------------------------------------------------------------------------

_DECIDED = f"""{_LAST}, decided AS (SELECT files.*, coalesce(
    {_case('action', {v: k for k, v in V.DECISION_ACTION.items()}, 'NULL')}, 'pending') AS decision
    FROM files LEFT JOIN last ON id = last.file_id)"""
_COUNTS = """count(*) AS total, count(*) FILTER (WHERE decision = 'pending') AS pending,
    count(*) FILTER (WHERE decision = 'deleted') AS deleted,
    count(*) FILTER (WHERE decision = 'cancelled') AS cancelled,
    count(*) FILTER (WHERE decision = 'extended') AS extended,
    count(*) FILTER (WHERE decision IN ('deleted', 'cancelled')) AS decided"""
_SHARES = """round(CAST(count(*) FILTER (WHERE decision <> 'pending') AS DOUBLE) / count(*) * 100, 6)
    AS handled_percent, round(CAST(count(*) FILTER (WHERE decision IN ('deleted', 'cancelled'))
    AS DOUBLE) / count(*) * 100, 6) AS decided_percent"""
ORACLE["decision_counts"] = _with(
    "files decisions", f", {_DECIDED} SELECT {_COUNTS} FROM decided")
ORACLE["review_progress"] = _with(
    "files decisions", f""", {_DECIDED} SELECT source_type, {_COUNTS}, {_SHARES} FROM decided
    GROUP BY source_type""")
ORACLE["files_fully_reviewed"] = _with("files findings", """
, done AS (SELECT id, coalesce(bool_and(status <> 'open'), true) AS ok
           FROM files LEFT JOIN (SELECT file_id, status FROM findings) AS f ON file_id = id
           GROUP BY id)
SELECT count(*) AS files, count(*) FILTER (WHERE ok) AS reviewed,
    count(*) FILTER (WHERE NOT ok) AS "left",
    CAST(floor(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) * 100) AS BIGINT) AS percent
FROM done""")
_LATE = f"{NOW} - last_modified > {V.RETENTION_YEARS * V.SECONDS_PER_YEAR}"
ORACLE["past_retention"] = _with(
    "files", f"SELECT id, last_modified FROM files WHERE {_LATE}")
_NAME = "CASE {r} WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
_RISK = f"""risk AS (SELECT file_id, min({_RANK}) AS risk_rank, count(*) AS n_findings,
    coalesce(min({_RANK}) FILTER (WHERE status = 'open'), 2) AS open_rank
    FROM findings GROUP BY file_id)"""
ORACLE["file_priority"] = _with("findings", f"""
, {_RISK} SELECT file_id, {_NAME.format(r='risk_rank')} AS priority, n_findings,
    {_NAME.format(r='open_rank')} AS open_priority FROM risk""")
ORACLE["risk_order"] = _with("files findings", f"""
, {_RISK} SELECT id, risk_rank, n_findings, last_modified
FROM files JOIN risk ON id = file_id""")
ORACLE["file_list"] = _with("files findings", f"""
, {_RISK} SELECT id, regexp_extract(path, '[^/]*$') AS name,
    {_NAME.format(r='risk_rank')} AS priority, n_findings
FROM files JOIN risk ON id = file_id
WHERE risk_rank < 2 AND contains(lower(regexp_extract(path, '[^/]*$')), 'it_access')""")
ORACLE["file_list_by_risk"] = ORACLE["file_list_by_findings"] = _with("files findings", f"""
, {_RISK} SELECT id, regexp_extract(path, '[^/]*$') AS name,
    {_NAME.format(r='risk_rank')} AS priority, n_findings FROM files JOIN risk ON id = file_id""")
ORACLE["visible_findings"] = _with(
    "findings", "SELECT id, file_id, category, confidence FROM findings WHERE confidence >= 0.8")
ORACLE["api_findings"] = _with("registry", f"""
SELECT file_id || '__0' AS finding_id, file_id AS id, name, pii_category AS category,
    '' AS snippet, CAST(1 AS DOUBLE) AS confidence, 'regex' AS detector
FROM registry WHERE status_flag = 'flagged' AND {_OWNED} AND pii_category IS NOT NULL""")
ORACLE["review_cycle"] = _with("files decisions", f"""
, {_DECIDED}, c AS (SELECT coalesce(owner_user_id, master_of_data_user_id) AS user_id, id,
                           last_modified
                    FROM decided WHERE decision IN ('pending', 'extended'))
SELECT user_id, id, row_number() OVER w AS position, count(*) OVER (PARTITION BY user_id)
    AS cycle_size,
    coalesce(lag(id) OVER w, last_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND
        UNBOUNDED FOLLOWING)) AS previous_id,
    coalesce(lead(id) OVER w, first_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND
        UNBOUNDED FOLLOWING)) AS next_id
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY last_modified, id)""")
ORACLE["user_stats"] = _with("files findings decisions", f"""
, {_DECIDED} SELECT coalesce(owner_user_id, master_of_data_user_id) AS user_id, {_COUNTS},
    count(*) FILTER (WHERE {_LATE}) AS past_retention, {_SHARES}
FROM decided WHERE id IN (SELECT file_id FROM findings) GROUP BY 1""")
ORACLE["user_categories"] = _with("files findings", f"""
SELECT coalesce(owner_user_id, master_of_data_user_id) AS user_id, category, count(*) AS n,
    {_LABEL} AS label, {_PRIORITY} AS priority
FROM files JOIN (SELECT file_id, category FROM findings) AS f ON file_id = files.id
GROUP BY 1, 2""")

# ---- cascade --------------------------------------------------------------------------------

# By document: what the recogniser's answer holds (m8), and what the model answers, read off the
# answer tables' definitions. ``e`` is the entity tier's outcome, ``r`` whether the rules hit.
_STAGED = f"""
hit AS (SELECT DISTINCT doc_id FROM ({_DOC_ROWS}) AS h),
base AS (SELECT d.doc_id, lang, d.doc_id % 8 AS m8, d.doc_id % 5 AS m5, d.doc_id % 4 AS m4,
                lang <> 'es' AND d.doc_id % 8 <> 7 AS answered, h.doc_id IS NOT NULL AS r
         FROM documents AS d LEFT JOIN hit AS h ON h.doc_id = d.doc_id),
judged AS (SELECT *,
    CASE WHEN lang = 'fr' OR m5 = 2 THEN 'all' WHEN m5 = 0 THEN 'email' WHEN m5 = 1 THEN 'none'
        ELSE 'first' END AS verdict,
    CASE m8 WHEN 0 THEN 'name:ner:0.95' WHEN 4 THEN 'name:ner:0.97' END AS sure,
    CASE m8 WHEN 1 THEN 'home_address' WHEN 4 THEN 'email' END AS unsure,
    CASE m8 WHEN 1 THEN '0.87' WHEN 4 THEN '0.86' END AS unsure_score
    FROM base),
entity AS (SELECT *, CASE WHEN NOT answered THEN '' ELSE array_to_string(list_filter([sure,
    CASE WHEN unsure IS NULL OR verdict = 'none' THEN NULL
         WHEN verdict = 'all' THEN unsure || ':ner:' || unsure_score
         WHEN verdict = 'email' THEN 'email:ner+llm:0.7'
         ELSE unsure || ':ner+llm:' || unsure_score END], lambda x: x IS NOT NULL), '|') END AS e
    FROM judged),
staged AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, r, answered,
    CASE WHEN r THEN 'regex' WHEN e <> '' AND unsure IS NOT NULL THEN 'ner+llm_verify'
         WHEN e <> '' THEN 'ner' ELSE 'llm_detect' END AS stage,
    CASE WHEN e <> '' THEN e WHEN lang <> 'de' AND m4 = 0 THEN 'name:llm:0.6|health_data:llm:0.8'
         ELSE '' END AS findings, m8 FROM entity)"""
ORACLE["cascade_results"] = f"""WITH {_STAGED}
SELECT file_id, stage, CASE WHEN findings = '' THEN 'not_flagged' ELSE 'flagged' END
    AS status_flag, findings,
    CASE WHEN findings = '' THEN NULL WHEN stage = 'llm_detect' THEN 'health_data'
         WHEN contains(findings, 'name:ner') THEN 'name'
         ELSE split_part(findings, ':', 1) END AS category
FROM staged WHERE NOT r"""
_FOUND = ("CASE WHEN findings = '' THEN 0 ELSE len(string_split(findings, '|')) END")
ORACLE["cascade_stage_counts"] = f"""WITH {_STAGED},
n AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, count(*) AS n FROM ({_DOC_ROWS}) AS f GROUP BY 1)
SELECT stage, count(*) AS files, CAST(sum(CASE WHEN r THEN n.n ELSE {_FOUND} END) AS BIGINT)
    AS findings FROM staged LEFT JOIN n ON n.file_id = staged.file_id GROUP BY stage"""
ORACLE["cascade_without_models"] = f"""WITH {_STAGED},
n AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, count(*) AS n FROM ({_DOC_ROWS}) AS f GROUP BY 1)
SELECT CASE WHEN r OR NOT answered THEN 'regex' ELSE 'ner' END AS stage, count(*) AS files,
    CAST(sum(CASE WHEN r THEN n.n WHEN NOT answered THEN 0 WHEN m8 IN (0, 1) THEN 1
        WHEN m8 = 4 THEN 2 ELSE 0 END) AS BIGINT) AS findings
FROM staged LEFT JOIN n ON n.file_id = staged.file_id GROUP BY 1"""
ORACLE["cascade_summary"] = f"""WITH {_STAGED}
SELECT count(*) AS total, count(*) FILTER (WHERE r OR findings <> '') AS with_pii,
    count(*) FILTER (WHERE NOT r AND findings = '') AS clean FROM staged"""
ORACLE["tier_check"] = f"""WITH {_STAGED}
SELECT CASE WHEN r THEN 'WARN' WHEN findings = '' THEN 'MISS' WHEN stage = 'llm_detect' THEN 'WARN'
    ELSE 'PASS' END AS outcome, count(*) AS files FROM staged GROUP BY 1"""
ORACLE["entity_requests"] = f"""WITH {_STAGED}
SELECT file_id, md5(regexp_replace(text, {_q(V.FORM_LABEL)}, '', 'g')) AS digest, true AS well_formed
FROM staged JOIN documents ON CAST(doc_id AS VARCHAR) = file_id WHERE NOT r"""
ORACLE["batch_entities"] = """
SELECT CAST(doc_id AS VARCHAR) AS file_id,
       CASE doc_id % 8 WHEN 0 THEN 'Person:P' || doc_id ELSE '' END AS entities
FROM documents WHERE lang <> 'es' AND doc_id % 8 <> 7"""
_VERIFY_STEP = V.VERIFY_TEXT_CHARS - V.MAX_SNIPPET_CHARS
ORACLE["verify_requests"] = f"""WITH {_STAGED},
a AS (SELECT file_id, text, CASE m8 WHEN 1 THEN 'A' ELSE 'M' END || file_id AS snippet
      FROM staged JOIN documents ON CAST(doc_id AS VARCHAR) = file_id WHERE NOT r AND answered AND m8 IN (1, 4)),
p AS (SELECT *, CAST(least(greatest(strpos(text, snippet) - 1, 0) // {_VERIFY_STEP}, greatest(0, CAST(ceil(
      (length(text) - {V.VERIFY_TEXT_CHARS}) / CAST({_VERIFY_STEP} AS DOUBLE)) AS BIGINT))) AS INTEGER) AS part FROM a)
SELECT file_id, part, part * {_VERIFY_STEP} AS start, 'Text:' || chr(10)
    || substring(text, part * {_VERIFY_STEP} + 1, {V.VERIFY_TEXT_CHARS}) || chr(10) || chr(10)
    || 'Snippets to verify:' || chr(10) || '[{{"index":0,"snippet":"' || snippet || '"}}]' AS request FROM p"""
ORACLE["detect_requests"] = f"""WITH {_STAGED},
w AS (SELECT file_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / {V.DETECT_TEXT_CHARS}.0) AS BIGINT))))
      AS part FROM staged JOIN documents ON CAST(doc_id AS VARCHAR) = file_id WHERE stage = 'llm_detect')
SELECT file_id, CAST(part AS INTEGER) AS part, CAST(part * {V.DETECT_TEXT_CHARS} AS INTEGER) AS start,
    substring(text, CAST(part * {V.DETECT_TEXT_CHARS} + 1 AS BIGINT), {V.DETECT_TEXT_CHARS}) AS request FROM w"""
ORACLE["stripped_labels"] = _with(
    "forms", f"SELECT path, regexp_replace(text, {_q(V.FORM_LABEL)}, '', 'g') AS text FROM forms")
ORACLE["verdict_cache"] = _with("findings", """
SELECT id, file_id, round(CASE WHEN confidence < 0.75 AND length(snippet) > 9 THEN 0.9
    WHEN confidence < 0.75 AND length(snippet) > 8 THEN 1.0 ELSE confidence END, 6) AS confidence,
    CASE WHEN confidence < 0.75 AND length(snippet) > 8 THEN 'llm' ELSE detector END AS detector
FROM findings""")

# ---- evaluation -----------------------------------------------------------------------------


def _scores(judged: str, detector: str) -> str:
    """File-level scores over rows of (pii, has)."""
    return f"""
    SELECT '{detector}' AS detector, n AS files_processed, CAST(0 AS BIGINT) AS errors,
        tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 4)
            AS "precision",
        round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 4) AS recall,
        round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / CAST(tp + fp AS DOUBLE))
            * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE)
            + tp / CAST(tp + fn AS DOUBLE)) END, 4) AS f1,
        round(CASE WHEN clean = 0 THEN 0 ELSE fp / CAST(clean AS DOUBLE) END, 4)
            AS false_positive_rate
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE pii AND has) AS tp,
                 count(*) FILTER (WHERE NOT pii AND has) AS fp,
                 count(*) FILTER (WHERE pii AND NOT has) AS fn,
                 count(*) FILTER (WHERE NOT pii) AS clean
          FROM ({judged}) AS h) AS s"""


def _confusion(rows: str, detector: str) -> str:
    return _scores(f"""SELECT NOT contains(forms.path, '/internal_memo_') AS pii,
        f.path IS NOT NULL AS has FROM forms LEFT JOIN (
        SELECT DISTINCT path FROM ({rows}) AS g) AS f ON forms.path = f.path""", detector)


_EMAIL_ROWS = _rule_rows("forms", "path", "text", ("emails",))
ORACLE["file_confusion"] = _with("forms", _confusion(_FORM_ROWS, "rules"))
ORACLE["detector_comparison"] = _with(
    "forms", f"{_confusion(_FORM_ROWS, 'rules')} UNION ALL {_confusion(_EMAIL_ROWS, 'emails only')}")
_TRUTH = "SELECT d.source <> 'src0' AS pii, {has} AS has FROM staged JOIN documents AS d " \
         "ON CAST(d.doc_id AS VARCHAR) = file_id"
ORACLE["tier_comparison"] = f"WITH {_STAGED} " + " UNION ALL ".join([
    _scores(_TRUTH.format(has="r"), "rules"),
    _scores(_TRUTH.format(has="r OR (answered AND m8 IN (0, 1, 4))"), "rules + entities"),
    _scores(_TRUTH.format(has="r OR findings <> ''"), "full cascade")])
ORACLE["latency_percentiles"] = """
WITH t AS (SELECT value / 1000 AS time_s, event_id FROM events),
p AS (SELECT time_s, row_number() OVER (ORDER BY time_s, event_id) AS position,
             count(*) OVER () AS n FROM t)
SELECT count(*) AS files, round(sum(time_s), 2) AS total_s,
    round(sum(time_s) / count(*) * 1000, 1) AS mean_ms,
    round(max(time_s) FILTER (WHERE position = floor(n * 0.5) + 1) * 1000, 1) AS p50_ms,
    round(max(time_s) FILTER (WHERE position = floor(n * 0.95) + 1) * 1000, 1) AS p95_ms,
    round(max(time_s) FILTER (WHERE position = floor(n * 0.99) + 1) * 1000, 1) AS p99_ms
FROM p"""
ORACLE["corpus_truth"] = _with("forms", """
SELECT NOT contains(path, '/internal_memo_') AS is_pii, count(*) AS files FROM forms GROUP BY 1""")

ORACLE["sampled_files"] = _with(
    "forms", "SELECT path FROM forms ORDER BY sha256('99:' || path) LIMIT 100")
# One label per category and file, so a label is hit when any finding of its category fits.
ORACLE["label_match_scores"] = _with("forms", f"""
, f AS ({_resolved('forms', 'path')}),
l AS (SELECT path, 'name' AS category, regexp_extract(text, 'Name: (\\w+)', 1) AS expected FROM forms
      UNION ALL SELECT path, 'username', regexp_extract(text, '(E-\\d+) issued', 1) FROM forms
      UNION ALL SELECT path, 'passport', 'C00' FROM forms),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE EXISTS (
          SELECT 1 FROM f WHERE f.path = l.path AND f.category = l.category
          AND contains(f.snippet, l.expected))) AS hit
      FROM l WHERE expected <> ''),
s AS (SELECT hit AS tp, (SELECT count(*) FROM f) - hit AS fp, CAST(n - hit AS BIGINT) AS fn,
             CAST(n AS BIGINT) AS labels, hit / CAST((SELECT count(*) FROM f) AS DOUBLE) AS p,
             hit / n AS r FROM m)
SELECT tp, fp, fn, (SELECT count(*) FROM forms) AS files, labels, round(p, 6) AS "precision",
    round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")

# ---- media answers --------------------------------------------------------------------------

ORACLE["image_texts"] = """
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM (
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t FROM documents
    UNION ALL SELECT doc_id, text FROM documents) AS both_shapes"""
ORACLE["video_texts"] = f"""
SELECT conv_id, turn, md5(CASE WHEN t = '' THEN role WHEN t = role THEN role
    ELSE t || chr(10) || chr(10) || role END) AS digest
FROM (SELECT conv_id, turn, role, trim(text, {_WS}) AS t FROM conversations) AS c"""
ORACLE["ocr_choice"] = f"""
SELECT doc_id AS file_id, md5(CASE WHEN length(trim(text, {_WS})) < 80
    THEN trim('scanned ' || text, {_WS}) ELSE text END) AS digest FROM documents"""

# ---- whole jobs -----------------------------------------------------------------------------

ORACLE["full_scan_run"] = _with("forms", f"""
, f AS (SELECT DISTINCT path FROM ({_span_rows('forms', 'path')}) AS s)
SELECT 'run1' AS id, 'full' AS type, CAST({NOW} AS DOUBLE) AS started_at,
    CAST({NOW + 60} AS DOUBLE) AS finished_at, count(*) AS files_scanned,
    CAST(sum(strlen(text)) AS BIGINT) AS bytes_scanned, (SELECT count(*) FROM f) AS files_flagged,
    CAST(0 AS BIGINT) AS files_skipped, (SELECT count(*) FROM customer) AS files_failed,
    'done' AS status, CAST(100 AS DOUBLE) AS progress_pct
FROM forms""")
ORACLE["full_scan_errors"] = "SELECT 'unsupported file type: .pdf' AS error, count(*) AS files FROM customer"
ORACLE["full_scan_escalated"] = _with("forms", f"""
SELECT substring(sha256(substring(sha256(path), 1, 16) || ':' || category || ':' || start), 1, 16) AS id,
    round(CASE WHEN confidence < 0.75 AND length(snippet) > 9 THEN 0.9
        WHEN confidence < 0.75 AND length(snippet) > 8 THEN 1.0 ELSE confidence END, 6) AS confidence,
    CASE WHEN confidence < 0.75 AND length(snippet) > 8 THEN 'llm' ELSE 'regex' END AS detector
FROM ({_resolved('forms', 'path')}) AS s""")
ORACLE["plain_texts"] = """
SELECT '/in/doc_' || doc_id || '.txt' AS path, md5(text || chr(65533)) AS digest FROM documents"""
ORACLE["csv_texts"] = """
SELECT '/in/doc_' || doc_id || '.csv' AS path, md5('id' || chr(9) || 'text' || chr(10) || doc_id || chr(9) || text)
    AS digest FROM documents"""
ORACLE["ingest_errors"] = """
SELECT '/in/doc_' || doc_id || ending AS path, error FROM documents CROSS JOIN (VALUES
    ('.docx', 'BadZipFile: File is not a zip file'), ('.XYZ', 'unsupported file type: .xyz')) AS kinds(ending, error)"""
ORACLE["full_scan_files"] = _with("forms", f"""
SELECT {_SOURCE} AS source_type, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE {_SOURCE} = 'onedrive') AS owned,
    count(*) FILTER (WHERE {_SOURCE} <> 'onedrive') AS stewarded, count(*) AS scanned
FROM forms GROUP BY 1""")
ORACLE["stream_scan"] = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS file_id, 'doc ' || d.doc_id AS name,
    CASE WHEN f.doc_id IS NULL THEN 'not_flagged' ELSE 'flagged' END AS status_flag,
    'regex' AS detection_stage, f.category AS pii_category
FROM documents AS d LEFT JOIN (SELECT doc_id, arg_min(category, rule) AS category
    FROM ({_DOC_ROWS}) AS g GROUP BY doc_id) AS f ON f.doc_id = d.doc_id"""

_STATUS_ROWS = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS file_id, CASE WHEN f.doc_id IS NULL THEN 'not_flagged' ELSE 'flagged' END
    AS status_flag
FROM documents AS d LEFT JOIN (SELECT DISTINCT doc_id FROM ({_DOC_ROWS}) AS g) AS f ON f.doc_id = d.doc_id"""
ORACLE["stream_malformed"] = f"""
SELECT file_id, status_flag, CAST(NULL AS VARCHAR) AS message, 1 AS n FROM ({_STATUS_ROWS} WHERE d.doc_id % 5 <> 0) AS s
UNION ALL
SELECT NULL, 'bad', md5(line), CAST(count(*) AS INTEGER)
FROM (SELECT unnest(string_split('{{' || text, chr(10))) AS line FROM documents WHERE doc_id % 5 = 0) AS l GROUP BY md5(line)"""

ORACLE["stream_redelivery"] = _STATUS_ROWS
ORACLE["stream_duplicates_registry"] = f"""
SELECT file_id, status_flag, pii_category FROM ({ORACLE["stream_scan"]}) AS s"""
ORACLE["stream_extraction"] = """
SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN doc_id % 6 = 0 THEN 'lost' ELSE md5(text) END AS digest
FROM documents"""

# ``_with`` is written in front of bodies that go on with further named relations.
ORACLE = {name: sql.replace(") \n,", "),").replace(") ,", "),") for name, sql in ORACLE.items()}
