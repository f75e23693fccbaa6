"""Independent SQL formulations of the registered queries (DuckDB dialect).

They are the correctness oracle: the same semantics written as plain SQL over
the driver's parquet views, never sharing code paths with the Spark side
beyond the fixed values (patterns, maps, constants) they both must use.

RE2 (DuckDB) has ASCII ``\\b``/``\\s``/``\\w``; the Spark side uses Java with
Unicode classes.  On the test tables both agree (checked per query by the
driver's compare); differences are limited to non-ASCII word characters
touching a match.
"""

from __future__ import annotations

from veilmark.functions import rules as R
from veilmark.sources import tables as TB

def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def pick(values: list[str], idx: str) -> str:
    arr = "[" + ", ".join(q(v) for v in values) + "]"
    return f"({arr})[(({idx}) % {len(values)}) + 1]"


def luhn_sql(t: str) -> str:
    digits = f"string_split(reverse(regexp_replace({t}, '[^0-9]', '', 'g')), '')"
    w = (
        f"list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 0 THEN "
        f"(CASE WHEN CAST(d AS INTEGER) * 2 > 9 THEN CAST(d AS INTEGER) * 2 - 9 ELSE CAST(d AS INTEGER) * 2 END) "
        f"ELSE CAST(d AS INTEGER) END)"
    )
    return f"(coalesce(list_sum({w}), 0) % 10 = 0 AND length(regexp_replace({t}, '[^0-9]', '', 'g')) > 0)"


def rule_matches_sql(src: str, rule: R.Rule, rank: int, key: str = "doc_id", text: str = "text") -> str:
    """One rule -> rows (key, type, rnk, score, source, start, end, text) with stripped offsets."""
    pat = q("(?i)" + rule.pattern)
    m = f"regexp_extract_all({text}, {pat})"
    g = f"string_split_regex({text}, {pat})"
    st = (
        f"list_transform(m, lambda x, i: {{'raw': x, 'st': "
        f"coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + "
        f"coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)}})"
    )
    inner = (
        f"SELECT {key}, unnest({st}) AS s FROM (SELECT {key}, {m} AS m, {g} AS g FROM {src})"
    )
    lead = "length(regexp_extract(s.raw, '^\\s*'))"
    stripped = "regexp_replace(s.raw, '^\\s+|\\s+$', '', 'g')"
    body = (
        f"SELECT {key}, {q(rule.type)} AS type, {rank} AS rnk, CAST({rule.score} AS DOUBLE) AS score, "
        f"{q(rule.source)} AS source, CAST(s.st + {lead} AS INTEGER) AS start, "
        f"CAST(s.st + {lead} + length({stripped}) AS INTEGER) AS \"end\", {stripped} AS text FROM ({inner})"
    )
    cond = "length(text) > 0"
    if rule.validator == "luhn":
        cond += " AND " + luhn_sql("text")
    return f"SELECT * FROM ({body}) WHERE {cond}"


def type_remap_sql(expr: str) -> str:
    return case_map(expr, R.TYPE_REMAP, expr)


def overlap_sql(a: str, b: str, theta: float) -> str:
    ov = f"(least({a}.\"end\", {b}.\"end\") - greatest({a}.start, {b}.start))"
    mn = f"least({a}.\"end\" - {a}.start, {b}.\"end\" - {b}.start)"
    base = f"({ov} > 0 AND {a}.\"end\" > {a}.start AND {b}.\"end\" > {b}.start"
    if theta <= 0:
        return base + ")"
    return base + f" AND CAST({ov} AS DOUBLE) / {mn} >= {theta})"


def earlier_by_length(a: str, b: str) -> str:
    """b sorts before a in (length desc, rank, start)."""
    la, lb = f"({a}.\"end\" - {a}.start)", f"({b}.\"end\" - {b}.start)"
    return (
        f"({lb} > {la} OR ({lb} = {la} AND ({b}.rnk < {a}.rnk OR ({b}.rnk = {a}.rnk AND {b}.start < {a}.start))))"
    )


def dedup_sql(cands: str, theta: float, key: str = "doc_id") -> str:
    """Greedy longest-first suppression written as NOT EXISTS (exact when no overlap chains)."""
    return (
        f"SELECT c.* FROM {cands} c WHERE NOT EXISTS (SELECT 1 FROM {cands} d WHERE d.{key} = c.{key} "
        f"AND {earlier_by_length('c', 'd')} AND {overlap_sql('c', 'd', theta)})"
    )


def only_rules_sql(src: str, rules: list[R.Rule], theta: float) -> str:
    """CTEs ``raw`` and ``kept`` of one stage with the given rules."""
    raw = " UNION ALL ".join(rule_matches_sql(src, r, i) for i, r in enumerate(rules))
    return f"raw0 AS ({raw}), raw AS (SELECT doc_id, {type_remap_sql('type')} AS type, rnk, score, source, start, \"end\", text FROM raw0), kept AS ({dedup_sql('raw', theta)})"


def detect_ctes(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs: base_raw, base_kept, rule_raw, rule_kept, all_spans (key, type, rnk, score, source, start, end, text)."""
    base = " UNION ALL ".join(
        rule_matches_sql(src, r, i, key, text) for i, r in enumerate(R.default_base_recognizers())
    )
    rules_ = " UNION ALL ".join(
        rule_matches_sql(src, r, 100 + i, key, text) for i, r in enumerate(R.business_rules())
    )
    return (
        f"base_raw0 AS ({base}), "
        f"base_raw AS (SELECT {key}, {type_remap_sql('type')} AS type, rnk, score, source, start, \"end\", text "
        f"FROM base_raw0 WHERE score >= 0.4), "
        f"base_kept AS ({dedup_sql('base_raw', R.THETA_WITHIN, key)}), "
        f"rule_raw AS ({rules_}), "
        f"rule_kept AS ({dedup_sql('rule_raw', R.THETA_WITHIN, key)}), "
        f"rule_added AS (SELECT c.* FROM rule_kept c WHERE NOT EXISTS (SELECT 1 FROM base_kept b "
        f"WHERE b.{key} = c.{key} AND {overlap_sql('c', 'b', R.THETA_ACROSS)}) AND NOT EXISTS ("
        f"SELECT 1 FROM rule_kept d WHERE d.{key} = c.{key} AND {earlier_by_length('c', 'd')} "
        f"AND {overlap_sql('c', 'd', R.THETA_ACROSS)})), "
        f"all_spans AS (SELECT * FROM base_kept UNION ALL SELECT * FROM rule_added)"
    )


SPAN_COLS = 'doc_id, type, start, "end", text, score, source'


def detect_sql(which: str) -> str:
    ctes = detect_ctes()
    table = {"base": "base_kept", "rules_raw": "rule_raw", "rules": "rule_kept", "all": "all_spans"}[which]
    return f"WITH {ctes} SELECT {SPAN_COLS} FROM {table}"


def severity_sql(expr: str) -> str:
    return case_map(expr, R.TYPE_SEVERITY, "'info'")


def label_sql(expr: str) -> str:
    return case_map(expr, R.TYPE_LABEL, expr)


def prefix_sql(expr: str) -> str:
    name = f"regexp_replace(upper({expr}), '[^{R.PREFIX_LETTERS}]', '_', 'g')"
    return case_map(expr, R.TOKEN_PREFIX, f"coalesce(nullif({name}, ''), '_')")


def sev_rank_sql(expr: str) -> str:
    return case_map(expr, R.SEVERITY_RANK, "NULL")


def token_sql(session: str, type_: str, value: str, width: int = 12, salt: str = "") -> str:
    digest = f"sha256(concat_ws('|', {q(salt)}, CAST({session} AS VARCHAR), {type_}, {value}))"
    return f"('[' || {prefix_sql(type_)} || '_' || substr({digest}, 1, {width}) || ']')"


def masked_ctes(src: str = "documents", key: str = "doc_id") -> str:
    """CTEs on top of detect_ctes: tok (spans + token), masked (key, masked_text, n_spans, tokens_used)."""
    return (
        f"tok AS (SELECT {key}, start, \"end\", type, text, {token_sql(key, 'type', 'text')} AS token, "
        f"lag(\"end\", 1, 0) OVER (PARTITION BY {key} ORDER BY start) AS prev_end FROM all_spans), "
        f"masked0 AS (SELECT t.{key}, string_agg(substr(d.text, t.prev_end + 1, t.start - t.prev_end) || t.token, '' "
        f"ORDER BY t.start) || substr(any_value(d.text), max(t.\"end\") + 1) AS masked_text, count(*) AS n_spans, "
        f"count(DISTINCT t.token) AS tokens_used FROM tok t JOIN {src} d ON t.{key} = d.{key} GROUP BY t.{key}), "
        f"masked AS (SELECT d.{key}, d.text, coalesce(m.masked_text, d.text) AS masked_text, "
        f"CAST(coalesce(m.n_spans, 0) AS INTEGER) AS n_spans, CAST(coalesce(m.tokens_used, 0) AS INTEGER) AS tokens_used "
        f"FROM {src} d LEFT JOIN masked0 m ON d.{key} = m.{key}), "
        f"vault AS (SELECT DISTINCT CAST({key} AS VARCHAR) AS session_id, token, type, text AS value FROM tok)"
    )


def audit_cte() -> str:
    """The events -> audit projection (same fixed values as ``tables.audit_events``)."""
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    event = case_map("event_type", TB.EVENT_TYPE_MAP, "event_type")
    is_file = f"({event} IN ({', '.join(q(e) for e in R.FILE_EVENTS)}))"
    is_task = f"({event} IN ({', '.join(q(e) for e in R.TASK_EVENTS)}))"
    provider = pick(R.PROVIDERS, k)
    t1 = pick(TB.AUDIT_PII_TYPES, k)
    t2 = pick(TB.AUDIT_PII_TYPES, f"{k} * 7 + 3")
    model = (
        f"CASE WHEN {k} >= 90 THEN '' WHEN {k} >= 80 THEN {q(R.CONFIGURED_DEFAULT_MODEL)} "
        f"ELSE {case_map(provider, R.DEFAULT_MODEL, 'NULL')} END"
    )
    return (
        f"audit AS (SELECT event_id, ts AS timestamp, {event} AS event, "
        f"({is_task} AND value > {TB.BOUNDARY_VALUE}) AS data_left_boundary, "
        f"CAST(user_id AS VARCHAR) AS session_id, 'user_' || CAST(user_id AS VARCHAR) AS \"user\", "
        f"CASE WHEN {is_file} THEN '***' || {pick(TB.AUDIT_FILE_EXTS, k)} END AS filename, "
        f"CASE WHEN {is_file} THEN {k} END AS pii_count, "
        f"CASE WHEN {is_file} THEN (CASE WHEN {t1} = {t2} THEN [{t1}] ELSE [{t1}, {t2}] END) END AS pii_types, "
        f"CASE WHEN {is_task} THEN {provider} END AS provider, "
        f"CASE WHEN {is_task} THEN {model} END AS model FROM events)"
    )


def resolve_model_sql(provider: str, requested: str) -> str:
    return (
        f"(CASE WHEN trim(coalesce({requested}, '')) = '' THEN coalesce({case_map(provider, R.DEFAULT_MODEL, 'NULL')}, '') "
        f"ELSE trim({requested}) END)"
    )


def event_label_sql(e: str) -> str:
    return case_map(e, R.EVENT_LABEL, e)


def event_color_sql(e: str) -> str:
    return (
        f"(CASE WHEN contains({e}, 'failed') THEN 'text-red-400' "
        f"WHEN contains({e}, 'uploaded') OR contains({e}, 'created') THEN 'text-blue-400' "
        f"WHEN contains({e}, 'complete') OR contains({e}, 'received') THEN 'text-green-400' "
        f"ELSE 'text-pp-text-muted' END)"
    )


def csv_field_sql(v: str) -> str:
    s = f"replace(coalesce({v}, ''), '\"', '\"\"')"
    return f"(CASE WHEN regexp_matches({s}, '[,\"\\n]') THEN '\"' || {s} || '\"' ELSE {s} END)"


def csv_line_sql() -> str:
    vals = [
        "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'",
        "event",
        "CASE WHEN data_left_boundary THEN 'True' WHEN NOT data_left_boundary THEN 'False' END",
        "session_id", "\"user\"", "filename", "CAST(pii_count AS VARCHAR)",
        "CASE WHEN pii_types IS NOT NULL THEN '[''' || array_to_string(pii_types, ''', ''') || ''']' END",
        "provider", "model",
    ]
    return " || ',' || ".join(csv_field_sql(v) for v in vals)


def sheet_lines_cte(src: str) -> str:
    """lines(doc_id, i, line): trimmed non-empty lines in order (0-based i)."""
    return (
        f"raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line0, "
        f"unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM {src}), "
        f"lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS i, line "
        f"FROM (SELECT doc_id, n, trim(line0) AS line FROM raw_lines) WHERE line <> '')"
    )


CELL_PATTERN = "'^([a-zA-Z]+)(\\d+):\\s*(.*)$'"


def sheet_col_sql(line: str) -> str:
    """Column number of a cell line, null if its letters are no column of the sheet format."""
    letters = f"regexp_extract({line}, {CELL_PATTERN}, 1)"
    n = (f"list_reduce(list_transform(string_split(upper({letters}), ''), lambda ch: ascii(ch) - 64), lambda acc, x: acc * 26 + x, 0)")
    return f"(CASE WHEN length({letters}) BETWEEN 1 AND 3 AND {n} <= {R.SHEET_MAX_COL} THEN CAST({n} AS BIGINT) END)"


def sheet_cells_ctes(src: str) -> str:
    hdr = "(starts_with(line, '[Arkusz:') AND ends_with(line, ']'))"
    return (
        f"{sheet_lines_cte(src)}, "
        f"tagged AS (SELECT doc_id, i, line, CASE WHEN {hdr} THEN trim(substr(line, 9, length(line) - 9)) END AS hname, "
        f"NOT {hdr} AND regexp_matches(line, {CELL_PATTERN}) AS is_cell FROM lines), "
        f"sheeted AS (SELECT *, coalesce(last_value(hname IGNORE NULLS) OVER w, 'Arkusz1') AS sheet, "
        f"CAST(count(hname) OVER w AS INTEGER) AS section FROM tagged "
        f"WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        f"cells0 AS (SELECT doc_id, i, section, sheet, TRY_CAST(regexp_extract(line, {CELL_PATTERN}, 2) AS BIGINT) AS \"row\", "
        f"{sheet_col_sql('line')} AS col, regexp_extract(line, {CELL_PATTERN}, 3) AS value FROM sheeted WHERE is_cell), "
        f"cells AS (SELECT doc_id, section, sheet, \"row\", col, arg_max(value, i) AS value "
        f"FROM cells0 WHERE \"row\" <= {R.SHEET_MAX_ROW} AND col IS NOT NULL GROUP BY doc_id, section, sheet, \"row\", col)"
    )


def tasks_ctes() -> str:
    """tasks, files (same derivation as ``tables.tasks`` / ``tables.files``)."""
    status = case_map("o.o_orderstatus", TB.ORDER_STATUS_MAP, "NULL")
    provider = pick(R.PROVIDERS, "p.conv_id")
    model = case_map(provider, R.DEFAULT_MODEL, "NULL")
    ext = case_map("lang", TB.FILE_EXT_BY_LANG, "NULL")
    return (
        "per_conv AS (SELECT conv_id, count(*) AS message_count FROM conversations GROUP BY conv_id), "
        f"tasks AS (SELECT p.conv_id AS task_id, p.conv_id AS file_id, 'cust_' || CAST(o.o_custkey AS VARCHAR) AS user_id, "
        f"coalesce({status}, 'unknown') AS status, {provider} AS provider, {model} AS model, "
        f"o.o_orderdate AS created_at, o.o_orderdate + to_minutes(CAST(p.message_count AS INTEGER)) AS last_activity_at, "
        f"p.message_count FROM per_conv p LEFT JOIN orders o ON p.conv_id = o.o_orderkey), "
        f"files AS (SELECT doc_id AS file_id, CASE WHEN {ext} IS NULL THEN {q(R.TEXT_PLACEHOLDER_FILENAME)} "
        f"ELSE 'doc_' || CAST(doc_id AS VARCHAR) || {ext} END AS filename FROM documents)"
    )


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def summary_cte() -> str:
    cleaned = f"regexp_replace({strip_sql('coalesce(f.instruction, \'\')')}, '\\s+', ' ', 'g')"
    fn = "coalesce(fl.filename, '')"
    title = (
        f"CASE WHEN {fn} <> '' AND {fn} <> {q(R.TEXT_PLACEHOLDER_FILENAME)} THEN {fn} "
        f"WHEN {cleaned} <> '' THEN substr({cleaned}, 1, 72) WHEN {fn} <> '' THEN {fn} "
        f"ELSE {q(R.UNTITLED_CONVERSATION)} END"
    )
    return (
        "facts AS (SELECT conv_id, count(*) AS message_count, arg_max(text, turn) AS last_text, "
        "arg_min(text, turn) FILTER (WHERE role = 'user') AS instruction FROM conversations GROUP BY conv_id), "
        f"summary AS (SELECT t.task_id, {title} AS title, {fn} AS filename, coalesce(t.provider, '') AS provider, "
        f"coalesce(t.model, '') AS model, coalesce(t.status, 'unknown') AS status, t.created_at, "
        f"coalesce(t.last_activity_at, t.created_at) AS last_activity_at, coalesce(f.message_count, 0) AS message_count, "
        f"substr(coalesce(f.last_text, ''), 1, 160) AS last_message_preview "
        f"FROM tasks t LEFT JOIN facts f ON f.conv_id = t.task_id LEFT JOIN files fl ON fl.file_id = t.file_id)"
    )


def answers_cte() -> str:
    from veilmark.sources.derived import ORDER_SHEET_SQL

    tag = R.SOLUTION_TAG
    block = q(f"(?s)<{tag}>(.*?)</{tag}>")
    return (
        f"dumps AS ({ORDER_SHEET_SQL}), "
        f"answers AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND t.status = 'completed' AND (c.conv_id % 2 = 0 OR c.turn < 2) "
        f"THEN c.text || chr(10) || '<{tag}>' || chr(10) || d.text || chr(10) || '</{tag}>' ELSE c.text END AS text "
        f"FROM conversations c LEFT JOIN tasks t ON t.task_id = c.conv_id LEFT JOIN dumps d ON d.doc_id = c.conv_id), "
        f"solved AS (SELECT conv_id, turn, role, text, CASE WHEN regexp_matches(text, {block}) THEN "
        f"{strip_sql(f'regexp_extract(text, {block}, 1)')} END AS solution, "
        f"CASE WHEN regexp_matches(text, {block}) THEN coalesce(nullif({strip_sql(f"regexp_replace(text, {block}, '', 'g')")}, ''), "
        f"{q(R.SOLUTION_DEFAULT_MESSAGE)}) ELSE text END AS message FROM answers), "
        f"result AS (SELECT c.conv_id, (SELECT arg_max(s.solution, s.turn) FROM solved s WHERE s.conv_id = c.conv_id AND s.role = 'assistant' "
        f"AND s.solution IS NOT NULL) AS solution_text, coalesce((SELECT arg_max(s.text, s.turn) FROM solved s WHERE s.conv_id = c.conv_id "
        f"AND s.role = 'assistant'), '') AS last_text FROM (SELECT DISTINCT conv_id FROM conversations) c)"
    )


def audit_lines_sql() -> str:
    """(event_id, kind, ...) over the ``audit`` CTE: what each raw line of the JSON log is."""
    return (
        "log AS (SELECT event_id, event, session_id, coalesce(pii_count, 0) AS n, "
        "CASE WHEN event_id % 11 = 0 THEN 'blank' WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 17 = 0 THEN 'more' "
        "WHEN event_id % 19 = 0 THEN 'odd' ELSE 'plain' END AS kind FROM audit)"
    )


def quoted_sql() -> str:
    """CTEs on top of masked_ctes: inv, pairs (values of a session, longest first) and turns that quote the first value."""
    return (
        "inv AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, text AS value, arg_min(token, struct_pack(s := start, t := token)) AS token "
        "FROM tok GROUP BY doc_id, text), "
        "pairs AS (SELECT session_id, list({'v': value, 't': token} ORDER BY length(value) DESC, value, token) AS p FROM inv GROUP BY session_id), "
        "quoted AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, arg_min(text, start) AS quoted FROM tok GROUP BY doc_id), "
        "turns AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'user' AND k.quoted IS NOT NULL THEN c.text || ' ' || k.quoted "
        "ELSE c.text END AS text FROM conversations c LEFT JOIN quoted k ON k.session_id = CAST(c.conv_id AS VARCHAR))"
    )


REMASKED = "coalesce(list_reduce(p.p, lambda acc, x: replace(acc, x.v, x.t), h.text), h.text)"
