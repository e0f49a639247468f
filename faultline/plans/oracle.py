"""The registered queries as SQL, stated independently of the Spark expressions."""

import re

from .. import fixed_values as V
from ..operators.scoring import prompt_frame
from ..sources.views import CODE_PATHS, LEVELS, LOG_TEXTS, SERVICES
from .registry import BUDGET, CONTEXT, LATE_SECONDS, NOW, PARTS, STORM, WINDOW
from .stub_model import ANSWERS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(pairs, other="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _filled(text: str, fields: dict[str, str]) -> str:
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(fields[p] if i % 2 else q(p) for i, p in enumerate(parts) if p)


# --- the views --------------------------------------------------------------------

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_SERVICE = _case([(f"user_id % 5 = {i}", q(s)) for i, s in enumerate(SERVICES)])
_LEVEL = _case([(f"event_type = {q(k)}", q(v)) for k, v in LEVELS.items()])
_FIELDS = {
    "m": "(user_id % 7)::VARCHAR",
    "d": "(((event_id // 24) * 5 + event_id % 24) * 7919 % (SELECT count(*) FROM documents))::VARCHAR",
    "d2": "(((event_id // 24) * 5 + 4) * 7919 % (SELECT count(*) FROM documents))::VARCHAR",
    "n": "(1 + (event_id // 24) % (1 + (event_id // 24) * 17 % 120))::VARCHAR",
    "n2": "(3 + (event_id // 24) % (1 + (event_id // 24) * 17 % 120))::VARCHAR",
    "long": "CASE WHEN user_id % 7 = 0 THEN repeat(' and so on', 400) ELSE '' END",
    "user": "user_id::VARCHAR",
    "event": "event_id::VARCHAR",
    "ts": _TS,
    "head": f"{_TS} || ' ' || {_LEVEL} || ' [' || {_SERVICE} || '] '",
}
LOGS = f"""logs AS (
  SELECT event_id AS log_id, ts, {_SERVICE} AS service_name,
    {_case([(f"event_id % 24 = {i}", _filled(t, _FIELDS)) for i, t in enumerate(LOG_TEXTS)])} AS raw_log
  FROM events)"""


def _normalized(text: str) -> str:
    for pattern in V.NOISE_PATTERNS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(V.NOISE_MARK)}, 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_ERRORS = ", ".join(f"nullif(regexp_extract(raw_log, {q(p)}, 1), '')" for p in V.ERROR_TYPE_PATTERNS)
_FILE = f"regexp_extract(raw_log, {q(V.FILE_LOCATION_PATTERN)}, 1)"
_LINE = f"regexp_extract(raw_log, {q(V.FILE_LOCATION_PATTERN)}, 2)"
MARKED = f"""{LOGS}, found AS (
  SELECT *, coalesce({_ERRORS}, '') AS error_type,
    regexp_extract({_FILE}, '[^/]*$', 0) || CASE WHEN {_LINE} = '' THEN '' ELSE ':' || {_LINE} END AS file_location,
    {_normalized('raw_log')} AS normalized
  FROM logs), marked AS (
  SELECT *, substr(md5(CASE
      WHEN error_type <> '' AND file_location <> '' THEN error_type || '@' || file_location
      WHEN error_type <> '' THEN error_type || ':' || substr(normalized, 1, 80)
      ELSE substr(normalized, 1, 120) END), 1, 12) AS fingerprint
  FROM found)"""

GROUPS = f"""{MARKED}, firsts AS (
  SELECT fingerprint, log_id, raw_log AS representative_log, service_name, error_type FROM marked
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, log_id) = 1), groups AS (
  SELECT f.*, g.count, g.first_seen, g.last_seen FROM firsts f JOIN (
    SELECT fingerprint, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM marked GROUP BY 1) g
  USING (fingerprint))"""


def _windows(eager: bool = False) -> str:
    span = WINDOW * 1_000_000
    fresh = f"p.cnt = 0{f' OR s.t - p.f > {span}' if eager else ''}"
    return f"""{MARKED}, seq AS (
  SELECT fingerprint AS fp, log_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY fingerprint ORDER BY ts, log_id) AS rn FROM marked), step AS (
  SELECT fp, rn, 1::BIGINT AS cnt, t AS f, t AS l, log_id AS id, TRUE AS fresh, t, log_id,
    NULL::VARCHAR AS ck, 0::BIGINT AS cc, 0::BIGINT AS cf, 0::BIGINT AS cl, 0::BIGINT AS ci
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.fp, s.rn,
    CASE WHEN p.cnt = 0 OR s.t - p.f > {span} THEN 1 WHEN p.cnt + 1 >= {STORM} THEN 0 ELSE p.cnt + 1 END,
    CASE WHEN p.cnt = 0 OR s.t - p.f > {span} THEN s.t ELSE p.f END, s.t,
    CASE WHEN p.cnt = 0 OR s.t - p.f > {span} THEN s.log_id ELSE p.id END,
    {fresh}, s.t, s.log_id,
    CASE WHEN p.cnt = 0 THEN NULL WHEN s.t - p.f > {span} THEN 'EXPIRED' WHEN p.cnt + 1 >= {STORM} THEN 'THRESHOLD' END,
    CASE WHEN s.t - p.f > {span} THEN p.cnt ELSE p.cnt + 1 END, p.f,
    CASE WHEN s.t - p.f > {span} THEN p.l ELSE s.t END, p.id
  FROM step p JOIN seq s ON s.fp = p.fp AND s.rn = p.rn + 1), emitted AS (
  SELECT fp, 'NEW' AS kind, 1::BIGINT AS count, t AS f, t AS l, log_id FROM step WHERE fresh
  UNION ALL SELECT fp, ck, cc, cf, cl, ci FROM step WHERE ck IS NOT NULL
  UNION ALL SELECT fp, 'FLUSH', cnt, f, l, id FROM (
    SELECT * FROM step QUALIFY rn = max(rn) OVER (PARTITION BY fp)) WHERE cnt > 0), windows AS (
  SELECT fp AS fingerprint, kind, count, make_timestamp(f) AS first_seen, make_timestamp(l) AS last_seen, log_id
  FROM emitted)"""


_WINDOW_GROUPS = f"""{_windows()}, groups AS (
  SELECT w.*, m.raw_log AS representative_log, m.service_name, m.error_type
  FROM windows w JOIN marked m USING (log_id))"""
# Timers close, at the newest time of all logs, what the eager way leaves open.
_TIMER_WINDOWS = f"""{_windows(True)}, timed AS (
  SELECT * REPLACE (CASE WHEN kind = 'FLUSH' AND (epoch_us(first_seen) + {WINDOW * 1_000_000}) // 1000 < newest THEN 'EXPIRED'
    ELSE kind END AS kind) FROM windows, (SELECT epoch_us(max(ts)) // 1000 AS newest FROM events))"""
_TIMER_GROUPS = f"""{_TIMER_WINDOWS}, groups AS (
  SELECT w.*, m.raw_log AS representative_log, m.service_name, m.error_type
  FROM timed w JOIN marked m USING (log_id))"""
_WINDOW_COLUMNS = "fingerprint, kind, count, first_seen, last_seen, log_id"


# --- rules and model --------------------------------------------------------------


def _rule_case(text: str, value, rules=None) -> str:
    pairs = []
    for rule in V.RULES if rules is None else rules:
        name, severity, pattern, exclusion, reason, action = rule
        hit = f"regexp_matches({text}, {q(pattern)}, 'i')"
        if exclusion:
            hit += f" AND NOT regexp_matches({text}, {q(exclusion)}, 'i')"
        pairs.append((hit, q(value(rule))))
    return _case(pairs)


_NAME = _rule_case("representative_log", lambda r: r[0])
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(n)}, {q(s)}, {q(V.RULE_REASON_FORMAT % (n, why))}, {q(what)})" for n, s, _, _, why, what in V.RULES
) + ") t(rule_name, severity, reason, action))"
_RULED = f"""ruled AS (
  SELECT g.*, r.rule_name, r.severity, r.reason, r.action
  FROM (SELECT *, {_NAME} AS rule FROM groups) g LEFT JOIN rules r ON g.rule = r.rule_name)"""

_SPAN = "((epoch_us(last_seen) - epoch_us(first_seen)) / 1e6)"
_RATE = f"(count / greatest({_SPAN}, 1.0) * 60.0)"
_CONTEXT = f"""CASE WHEN count > 1 THEN representative_log || chr(10) || '[聚合信息] 该错误在过去 ' ||
  floor({_SPAN})::BIGINT || 's 内出现 ' || count || ' 次（' || round_even({_RATE}, 0)::BIGINT || '次/分钟）'
  ELSE representative_log END"""
_HEAD, _TAIL = prompt_frame()
_PROMPT = f"""({q(_HEAD)} || CASE WHEN length(context) > 1500
  THEN substr(context, 1, 1500) || {q(V.TRIAGE_CUT_MARK)} ELSE context END || {q(_TAIL)})"""


def _answer(digest: str) -> str:
    digit = f"(('0x' || substr({digest}, 1, 1))::INT % {len(ANSWERS)})"
    return _case([(f"{digit} = {i}", q(a)) for i, a in enumerate(ANSWERS)])


_JUDGED = """, judged AS (
  SELECT *, CASE WHEN is_ok THEN json_extract_string(found, '$.severity') ELSE 'P1_HIGH' END AS m_severity,
    CASE WHEN is_ok THEN json_extract_string(found, '$.reason')
      ELSE 'LLM 输出解析失败，降级为 P1_HIGH（需人工确认）' END AS m_reason,
    CASE WHEN is_ok THEN json_extract_string(found, '$.action') ELSE '请人工查看原始日志' END AS m_action,
    CASE WHEN is_ok THEN 'llm' ELSE 'default' END AS m_source
  FROM (SELECT *, json_valid(found) AND CASE WHEN json_valid(found) THEN
      json_type(found) = 'OBJECT' AND coalesce(json_extract_string(found, '$.severity'), '') IN
      ('P0_CRITICAL', 'P1_HIGH', 'P2_WARNING', 'P3_IGNORE') ELSE FALSE END AS is_ok
    FROM (SELECT *, coalesce(
        nullif(regexp_extract(content, '(?s)' || '```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), ''),
        nullif(regexp_extract(content, '\\{[^{}]*"severity"[^{}]*\\}', 0), ''), trim(content)) AS found
      FROM answered)))"""
_CHAT = f"""prompted AS (SELECT *, {_CONTEXT} AS context FROM ruled), answered AS (
  SELECT *, {_answer(f"md5({_PROMPT})")} AS content FROM prompted){_JUDGED}, results AS (
  SELECT fingerprint, log_id, representative_log, service_name, count, first_seen, last_seen, kind,
    coalesce(severity, m_severity) AS severity, coalesce(reason, m_reason) AS reason,
    coalesce(action, m_action) AS action, CASE WHEN severity IS NOT NULL THEN 'rule' ELSE m_source END AS source,
    CASE WHEN severity IS NOT NULL THEN '' ELSE 'stub' END AS model,
    CASE WHEN severity IS NOT NULL THEN '' ELSE content END AS raw_output
  FROM judged)"""


def _results(groups: str, kind: str) -> str:
    ruled = _RULED if kind == "kind" else _RULED.replace("SELECT g.*,", f"SELECT g.*, {kind} AS kind,")
    recursive = "RECURSIVE " if "step AS" in groups else ""
    return f"WITH {recursive}{groups}, {_RULES}, {ruled}, {_CHAT}"


_PLAIN = _results(GROUPS, "'GROUP'")
_EMOJI = _case([(f"severity = {q(s)}", q(e)) for s, _, e, _ in V.SEVERITIES])
_SEVERITIES = "(VALUES " + ", ".join(f"({q(s)}, {n}, {q(e)}, {q(l)})" for s, n, e, l in V.SEVERITIES) + ") t(severity, level, emoji, label_cn)"

# --- stack traces -----------------------------------------------------------------

_STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
_LANGUAGE = _case([(f"regexp_matches(raw_log, {q('(?m)' + p)})", q(n)) for n, p in V.LANGUAGE_PATTERNS], "'unknown'")
_SEVERITY = f"coalesce(nullif(upper(regexp_extract(raw_log, {q(V.HEADER_PATTERN)}, 1, 'i')), ''), 'ERROR')"
_HEADER_SERVICE = f"regexp_extract(raw_log, {q(V.HEADER_PATTERN)}, 2, 'i')"


def _x(pattern: str, group: int, text: str = "line") -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def _m(pattern: str, text: str = "line") -> str:
    return f"regexp_matches({text}, {q(pattern)})"


_SKIP_GO = "(contains(path, 'runtime/') OR contains(path, 'vendor/'))"
_SKIP_NODE = "(contains(path, 'node_modules') OR contains(path, 'internal/'))"
TRACES = f"""{LOGS}, lines AS (
  SELECT log_id, language, unnest(parts) AS line, generate_subscripts(parts, 1) AS at_line FROM (
    SELECT log_id, {_LANGUAGE} AS language, string_split(raw_log, chr(10)) AS parts FROM logs)), s AS (
  SELECT *, {_STRIPPED} AS stripped FROM lines), java_errors AS (
  SELECT log_id, {_x(V.JAVA_ERROR, 1, 'stripped')} AS error_type, trim({_x(V.JAVA_ERROR, 2, 'stripped')}) AS error_message, at_line
  FROM s WHERE language = 'java' AND {_m(V.JAVA_ERROR, 'stripped')}
  QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY at_line) = 1), python_errors AS (
  SELECT log_id, {_x(V.PYTHON_ERROR, 1, 'stripped')} AS error_type, trim({_x(V.PYTHON_ERROR, 2, 'stripped')}) AS error_message, at_line
  FROM s WHERE language = 'python' AND {_m(V.PYTHON_ERROR, 'stripped')} AND NOT {_m(V.PYTHON_FRAME)}
  QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY at_line) = 1), go_errors AS (
  SELECT log_id, 'panic' AS error_type, trim(substr(stripped, 7)) AS error_message, at_line
  FROM s WHERE language = 'go' AND starts_with(stripped, 'panic:')
  QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY at_line DESC) = 1), node_errors AS (
  SELECT log_id, {_x(V.NODE_ERROR, 1, 'stripped')} AS error_type, trim({_x(V.NODE_ERROR, 2, 'stripped')}) AS error_message, at_line
  FROM s WHERE language = 'node' AND {_m(V.NODE_ERROR, 'stripped')}
  QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY at_line) = 1), errors AS (
  SELECT * FROM java_errors UNION ALL SELECT * FROM python_errors
  UNION ALL SELECT * FROM go_errors UNION ALL SELECT * FROM node_errors), go_lines AS (
  SELECT *, {_m(V.GO_FUNCTION, 'stripped')} AS is_function FROM s
  WHERE language = 'go' AND NOT starts_with(stripped, 'panic:')
    AND ({_m(V.GO_FUNCTION, 'stripped')} OR {_m(V.GO_FILE)})), go_pairs AS (
  SELECT *, lag(CASE WHEN is_function THEN {_x(V.GO_FUNCTION, 1, 'stripped')} END)
    OVER (PARTITION BY log_id ORDER BY at_line) AS owner, ltrim({_x(V.GO_FILE, 1)}, '/') AS path FROM go_lines), node_lines AS (
  SELECT s.*, {_m(V.NODE_NAMED_FRAME)} AS named,
    CASE WHEN {_m(V.NODE_NAMED_FRAME)} THEN {_x(V.NODE_NAMED_FRAME, 2)} ELSE {_x(V.NODE_PLAIN_FRAME, 1)} END AS path
  FROM s LEFT JOIN node_errors e USING (log_id)
  WHERE language = 'node' AND s.at_line <> coalesce(e.at_line, 0) AND ({_m(V.NODE_NAMED_FRAME)} OR {_m(V.NODE_PLAIN_FRAME)})), java_lines AS (
  SELECT s.*, {_x(V.JAVA_FRAME, 1)} AS cls, string_split({_x(V.JAVA_FRAME, 1)}, '.') AS parts
  FROM s LEFT JOIN java_errors e USING (log_id)
  WHERE language = 'java' AND s.at_line <> coalesce(e.at_line, 0) AND {_m(V.JAVA_FRAME)}), found_frames AS (
  SELECT log_id, at_line, language, array_to_string(CASE WHEN len(list_filter(parts, lambda p: regexp_matches(p, '^[A-Z]') OR contains(p, '$'))) > 0
      THEN list_filter(parts, lambda p: regexp_matches(p, '^[A-Z]') OR contains(p, '$')) ELSE parts END, '/') || '.java' AS file_path,
    {_x(V.JAVA_FRAME, 4)}::INT AS line_number, {_x(V.JAVA_FRAME, 2)} AS function_name, cls AS class_name, line FROM java_lines
  UNION ALL SELECT log_id, at_line, language, {_x(V.PYTHON_FRAME, 1)}, {_x(V.PYTHON_FRAME, 2)}::INT, {_x(V.PYTHON_FRAME, 3)}, '', line
  FROM s WHERE language = 'python' AND {_m(V.PYTHON_FRAME)}
  UNION ALL SELECT log_id, at_line, language, path, {_x(V.GO_FILE, 2)}::INT, string_split(owner, '.')[-1], owner, line
  FROM go_pairs WHERE NOT is_function AND owner IS NOT NULL AND NOT {_SKIP_GO}
  UNION ALL SELECT log_id, at_line, language, ltrim(path, '/'),
    (CASE WHEN named THEN {_x(V.NODE_NAMED_FRAME, 3)} ELSE {_x(V.NODE_PLAIN_FRAME, 2)} END)::INT,
    CASE WHEN named THEN trim({_x(V.NODE_NAMED_FRAME, 1)}) ELSE '<anonymous>' END, '', line
  FROM node_lines WHERE NOT {_SKIP_NODE}), frames AS (
  SELECT log_id, (row_number() OVER (PARTITION BY log_id ORDER BY at_line) - 1)::INT AS pos, language, file_path,
    line_number, function_name, class_name, rtrim(line) AS raw FROM found_frames), files AS (
  SELECT log_id, file_path, (row_number() OVER (PARTITION BY log_id ORDER BY first_pos) - 1)::INT AS pos,
    language, center, marks FROM (
    SELECT log_id, file_path, min(pos) AS first_pos, min(language) AS language, min(line_number) AS center,
      list_sort(list_distinct(list(line_number))) AS marks FROM frames GROUP BY 1, 2)), parsed AS (
  SELECT l.log_id, l.raw_log, {_SEVERITY} AS severity, {_HEADER_SERVICE} AS service, {_LANGUAGE} AS language,
    coalesce(e.error_type, '') AS error_type, coalesce(e.error_message, '') AS error_message,
    coalesce(n.n, 0) AS n_files, t.file_path AS top_path, t.line_number AS top_line, t.function_name AS top_function
  FROM logs l LEFT JOIN errors e USING (log_id)
  LEFT JOIN (SELECT log_id, count(*)::INT AS n FROM files GROUP BY 1) n USING (log_id)
  LEFT JOIN frames t ON t.log_id = l.log_id AND t.pos = 0), summarised AS (
  SELECT *, '服务: ' || coalesce(nullif(service, ''), '未知') || chr(10) || '级别: ' || severity || chr(10) ||
    '错误: ' || coalesce(nullif(error_type, ''), '未知') || ': ' || error_message || chr(10) || '涉及文件数: ' || n_files ||
    CASE WHEN top_path IS NULL THEN '' ELSE chr(10) || '最顶层报错: ' || top_path || ':' || top_line || ' in ' || top_function || '()' END
    AS summary FROM parsed)"""

_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CODE = f"""code AS (
  SELECT unnest([{", ".join(f"{q(a)} || doc_id || {q(b)}" for a, b in CODE_PATHS)}]) AS file_path,
    doc_id, CASE WHEN pieces[-1] = '' THEN pieces[:-2] ELSE pieces END AS lines
  FROM (SELECT doc_id, regexp_split_to_array(text, {q(_BREAK)}) AS pieces FROM documents))"""
SNIPPETS = f"""{TRACES}, {CODE}, windowed AS (
  SELECT log_id, pos, f.file_path, language, marks, lines, greatest(1, center - {CONTEXT}) AS start_line,
    least(len(lines), center + {CONTEXT})::INT AS end_line
  FROM files f JOIN code c USING (file_path) WHERE f.pos < {V.MAX_FILES}), snip AS (
  SELECT log_id, pos, file_path, language, marks, start_line, end_line, '' AS commit_sha,
    coalesce(array_to_string(list_transform(range(start_line, end_line + 1), lambda n:
      lpad(n::VARCHAR, 6, ' ') || ' | ' || lines[n]), chr(10)), '') AS content,
    coalesce(array_to_string(list_transform(range(start_line, end_line + 1), lambda n:
      CASE WHEN list_contains(marks, n) THEN '>>> ' ELSE '    ' END || lpad(n::VARCHAR, 6, ' ') || ' | ' || lines[n]), chr(10)), '')
      AS marked_content
  FROM windowed)"""
_BY_REF = f"""WITH {TRACES}, {CODE}, asked AS (
  SELECT *, CASE WHEN log_id % 3 = 0 THEN 'HEAD' ELSE 'v1' END AS ref FROM files WHERE pos < {V.MAX_FILES}), held AS (
  SELECT a.*, a.ref = 'v1' AND c.doc_id % 2 = 1 AS from_tree,
    CASE WHEN a.ref = 'HEAD' THEN c.lines WHEN c.doc_id % 2 = 0 THEN list_prepend('v1', c.lines)
      ELSE list_prepend('tree', c.lines) END AS lines, CASE WHEN a.ref = 'HEAD' THEN '' ELSE '0a1b2c3' END AS commit_sha
  FROM asked a JOIN code c USING (file_path)), placed AS (
  SELECT *, greatest(1, center - {CONTEXT}) AS start_line, least(len(lines), center + {CONTEXT})::INT AS end_line FROM held)"""


def _rca(budget: int) -> str:
    return f"""{SNIPPETS}, blocks AS (
  SELECT log_id, i, n, block, sum(length(block)) OVER (PARTITION BY log_id ORDER BY i) <= {budget} AS fits FROM (
    SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY log_id) AS n,
      '### 片段 ' || row_number() OVER (PARTITION BY log_id ORDER BY pos) || ': `' || file_path || '`' || chr(10) ||
      '```' || language || chr(10) || marked_content || chr(10) || '```' AS block FROM snip)), sections AS (
  SELECT log_id, any_value(n)::INT AS n, count(*) FILTER (fits) AS kept,
    coalesce(string_agg(block, chr(10) ORDER BY i) FILTER (fits), '') AS body FROM blocks GROUP BY 1), rca AS (
  SELECT p.log_id, p.error_type, coalesce(n, 0) AS found_files, {q(V.LOG_SECTION_HEAD)} || summary || {q(V.LOG_SECTION_RAW)} ||
    CASE WHEN length(raw_log) > 3000 THEN substr(raw_log, 1, 2800) || {q(V.RAW_LOG_CUT_MARK)} ELSE raw_log END ||
    {q(V.LOG_SECTION_TAIL)} || chr(10) || chr(10) || CASE WHEN n IS NULL THEN '' ELSE {q(V.CODE_SECTION_HEAD)} ||
      CASE WHEN kept > 0 THEN chr(10) || body ELSE '' END ||
      CASE WHEN n > kept THEN chr(10) || '*（剩余 ' || (n - kept) || ' 个文件因 Token 限制省略）*' ELSE '' END ||
      chr(10) || chr(10) END || {q(V.RCA_TASK)} AS user_prompt
  FROM summarised p LEFT JOIN sections USING (log_id))"""


_RCA = _rca(V.CODE_BUDGET_CHARS)

SFT = """sft AS (
  SELECT u.conv_id, u.turn, coalesce(s.text, '') AS prompt, u.text AS query, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, max(text) AS text FROM conversations WHERE role = 'system' GROUP BY 1) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""

_OWN_RULES = [
    ("java_trouble", "P2_WARNING", r"java\.lang\.\w+(Error|Exception)", "heap", "jvm", "look"),
    ("any_connection", "P1_HIGH", "connection|upstream", None, "net", "check"),
    ("noise", "P3_IGNORE", "bot|health", "503", "noise", "none"),
]
_PREVIEW = "replace(substr(raw_log, 1, 80), chr(10), ' ') || '...'"
_OWN = _rule_case("raw_log", lambda r: r[0], _OWN_RULES)
_SCAN = _rule_case("raw_log", lambda r: r[0])
_SCANNED = f"WITH {LOGS}, {_RULES}, scan AS (SELECT *, {_SCAN} AS rule_name FROM logs)"
_AT = q(NOW.replace(" ", "T") + "Z")


# Fifty logs after one another in one file.
_INCIDENTS = f"""{LOGS.replace("logs AS (", "singles AS (", 1)}, logs AS (
  SELECT log_id // 50 AS log_id, max(ts) AS ts, '' AS service_name, string_agg(raw_log, chr(10) ORDER BY log_id) || chr(10) AS raw_log
  FROM singles GROUP BY 1)"""


def _frames_of(language: str) -> str:
    return f"WITH {TRACES} SELECT * FROM frames WHERE language = {q(language)}"


_DISTRIBUTION = (
    "SELECT s.severity, coalesce(n, 0) AS n FROM (SELECT severity FROM {all}) s LEFT JOIN "
    "({counted}) c USING (severity)"
).replace("{all}", _SEVERITIES)

ORACLE: dict[str, str] = {
    "log_records": f"WITH {LOGS} SELECT * FROM logs",
    "log_lines": f"""WITH {LOGS}, lines AS (SELECT rtrim(unnest(string_split(raw_log, chr(10)))) AS raw_log FROM logs)
        SELECT 'app' AS service_name, raw_log FROM lines WHERE raw_log <> ''""",
    "normalized_logs": f"WITH {MARKED} SELECT log_id, normalized, error_type, file_location FROM marked",
    "fingerprints": f"WITH {MARKED} SELECT log_id, fingerprint, error_type FROM marked",
    "dedup_groups": f"WITH {GROUPS} SELECT * FROM groups",
    "group_frequency": f"WITH {GROUPS} SELECT fingerprint, count, {_RATE} AS per_minute FROM groups",
    "group_context": f"WITH {GROUPS} SELECT fingerprint, {_CONTEXT} AS context FROM groups",
    "ungrouped_logs": f"""WITH {MARKED} SELECT fingerprint, 1::BIGINT AS count, ts AS first_seen, ts AS last_seen, log_id,
        raw_log AS representative_log, service_name, '' AS error_type FROM marked""",
    "anchored_windows": f"""WITH RECURSIVE {_WINDOW_GROUPS}
        SELECT {_WINDOW_COLUMNS}, representative_log, service_name, error_type FROM groups""",
    "eager_windows": f"WITH RECURSIVE {_windows(True)} SELECT {_WINDOW_COLUMNS} FROM windows",
    "storm_groups": f"WITH RECURSIVE {_windows()} SELECT {_WINDOW_COLUMNS} FROM windows WHERE kind = 'THRESHOLD'",
    "open_windows": f"WITH RECURSIVE {_windows()} SELECT count(*) AS open_windows FROM windows WHERE kind = 'FLUSH'",
    "expired_windows": f"""WITH RECURSIVE {_windows()} SELECT {_WINDOW_COLUMNS} FROM windows
        WHERE kind = 'FLUSH' AND epoch_us(TIMESTAMP {q(NOW)}) - epoch_us(first_seen) > {WINDOW * 1_000_000}""",
    "rule_triage": f"WITH {GROUPS}, {_RULES}, {_RULED} SELECT fingerprint, rule_name, severity, reason, action FROM ruled",
    "rule_table_triage": f"""WITH {LOGS}, scan AS (SELECT *, {_OWN} AS rule_name FROM logs)
        SELECT log_id, rule_name, {_case([(f"rule_name = {q(r[0])}", q(r[1])) for r in _OWN_RULES])} AS severity,
          {_case([(f"rule_name = {q(r[0])}", q(V.RULE_REASON_FORMAT % (r[0], r[4]))) for r in _OWN_RULES])} AS reason,
          CASE WHEN rule_name IS NULL THEN {_PREVIEW} END AS preview FROM scan""",
    "rule_scan": f"""{_SCANNED} SELECT log_id, service_name, rule_name, severity,
        CASE WHEN rule_name IS NULL THEN {_PREVIEW} END AS preview FROM scan LEFT JOIN rules USING (rule_name)""",
    "rule_hit_rate": f"""{_SCANNED} SELECT count(rule_name) AS hits, count(*) - count(rule_name) AS misses,
        count(rule_name) / count(*) AS hit_rate FROM scan""",
    "rule_usage": f"""{_SCANNED}, used AS (SELECT rule_name, count(*) AS n FROM scan GROUP BY 1)
        SELECT severity, count(*) AS rules, count(n) AS rules_hit, coalesce(sum(n), 0)::BIGINT AS logs
        FROM rules LEFT JOIN used USING (rule_name) GROUP BY 1""",
    "triage_prompts": f"""WITH {GROUPS}, prompted AS (SELECT *, {_CONTEXT} AS context FROM groups)
        SELECT fingerprint, {q(V.TRIAGE_SYSTEM)} AS system_prompt, {_PROMPT} AS user_prompt FROM prompted""",
    "parsed_verdicts": f"""WITH {GROUPS}, prompted AS (SELECT *, {_CONTEXT} AS context FROM groups), answered AS (
        SELECT *, {_answer(f"md5({_PROMPT})")} AS content FROM prompted){_JUDGED}
        SELECT fingerprint, m_severity AS severity, m_reason AS reason, m_action AS action, m_source AS source,
          content AS raw_output FROM judged""",
    "triage_results": f"""{_results(_WINDOW_GROUPS, "kind")} SELECT fingerprint, kind, log_id, service_name, severity, reason,
        action, source, count, first_seen, last_seen, model, raw_output FROM results""",
    "stored_responses": f"""WITH {GROUPS}, {_RULES}, {_RULED}, answered AS (
        SELECT *, {_answer("fingerprint")} AS content FROM ruled){_JUDGED}
        SELECT fingerprint, coalesce(severity, m_severity) AS severity, coalesce(reason, m_reason) AS reason,
          CASE WHEN severity IS NOT NULL THEN 'rule' ELSE m_source END AS source FROM judged""",
    "ungrouped_triage": f"""WITH {MARKED}, {_RULES}, scan AS (SELECT *, {_SCAN} AS rule_name FROM marked)
        SELECT log_id, fingerprint, coalesce(severity, 'P1_HIGH') AS severity,
          CASE WHEN rule_name IS NULL THEN 'default' ELSE 'rule' END AS source, 1::BIGINT AS count
        FROM scan LEFT JOIN rules USING (rule_name)""",
    "result_records": f"""{_PLAIN} SELECT severity, reason, action, source, service_name AS service, count,
        round_even({_RATE}, 1) AS frequency, fingerprint FROM results""",
    "severity_attributes": f"{_PLAIN} SELECT severity, fingerprint, level, emoji, label_cn FROM results JOIN {_SEVERITIES} USING (severity)",
    "severity_stats": f"{_PLAIN} " + _DISTRIBUTION.format(counted="SELECT severity, count(*) AS n FROM results GROUP BY 1"),
    "source_stats": f"""{_PLAIN} SELECT source, coalesce(n, 0) AS n FROM (VALUES ('rule'), ('llm'), ('default')) t(source)
        LEFT JOIN (SELECT source, count(*) AS n FROM results GROUP BY 1) USING (source)""",
    "run_totals": f"""{_PLAIN} SELECT count(*) AS total, count(*) FILTER (source = 'rule') AS rule_hits,
        count(*) FILTER (source = 'llm') AS model_calls,
        coalesce(avg(length(raw_output)::DOUBLE) FILTER (source = 'llm'), 0) AS mean_model_ms,
        count(*) FILTER (source = 'rule') / count(*) AS rule_hit_rate FROM results""",
    "routed_alerts": f"""{_PLAIN} SELECT fingerprint, severity, handler, seq FROM results JOIN (VALUES ('P0_CRITICAL', 'audit', 1),
        ('P1_HIGH', 'audit', 1), ('P2_WARNING', 'audit', 1), ('P3_IGNORE', 'audit', 1), ('P3_IGNORE', 'ignored_archive', 2))
        t(severity, handler, seq) USING (severity)""",
    "audit_records": f"""{_PLAIN} SELECT {_AT} AS ts, severity, reason, action, source, service_name AS service, count, fingerprint,
        round_even({_RATE}, 1) AS frequency, substr(representative_log, 1, 300) AS raw_log_preview FROM results""",
    "audit_files": f"{_PLAIN} SELECT severity, source, count(*) AS n FROM results GROUP BY 1, 2",
    "ignored_archive": f"""{_PLAIN} SELECT fingerprint, severity, substr(representative_log, 1, 300) AS raw_log_preview
        FROM results WHERE severity = 'P3_IGNORE'""",
    "ignored_documents": f"""{_PLAIN} SELECT {_AT} AS at, TRUE AS ai_ignored, severity AS ai_severity, reason AS ai_reason,
        service_name AS service, fingerprint, count, substr(representative_log, 1, 500) AS raw_log
        FROM results WHERE severity = 'P3_IGNORE'""",
    "notify_bodies": f"""{_PLAIN} SELECT fingerprint, severity, '🚨 [' || severity || '] ' || coalesce(nullif(service_name, ''), 'unknown') ||
        chr(10) || '原因: ' || reason || chr(10) || '操作: ' || action || chr(10) || '出现次数: ' || count || ' 次' AS text FROM results""",
    "markdown_bodies": f"""{_PLAIN} SELECT fingerprint, 'markdown' AS msgtype, severity || ' 告警' AS title, '## ' || {_EMOJI} || ' ' || severity ||
        ' — ' || service_name || chr(10) || chr(10) || '**原因**: ' || reason || chr(10) || chr(10) || '**操作**: ' || action ||
        chr(10) || chr(10) || '> 出现次数: ' || count || '  来源: ' || source AS text FROM results""",
    "attachment_bodies": f"""{_PLAIN} SELECT fingerprint,
        {_case([(f"severity = {q(s)}", q(c)) for s, c in V.ATTACHMENT_COLORS.items()], "'#888888'")} AS color,
        {_EMOJI} || ' ' || severity || ' — ' || service_name AS title, '*原因*: ' || reason || chr(10) || '*操作*: ' || action AS text,
        '次数: ' || count || ' | 来源: ' || source AS footer FROM results""",
    "delivery_outcomes": f"""{_PLAIN} SELECT fingerprint, severity, handler, seq, NOT (handler = 'markdown' AND severity = 'P3_IGNORE') AS sent
        FROM results, (VALUES ('notification', 0), ('markdown', 1)) t(handler, seq)""",
    "log_headers": f"WITH {LOGS} SELECT log_id, {_SEVERITY} AS severity, {_HEADER_SERVICE} AS service FROM logs",
    "log_language": f"WITH {LOGS} SELECT log_id, {_LANGUAGE} AS language FROM logs",
    "java_frames": _frames_of("java"),
    "python_frames": _frames_of("python"),
    "go_frames": _frames_of("go"),
    "node_frames": _frames_of("node"),
    "trace_errors": f"WITH {TRACES} SELECT log_id, language, error_type, error_message FROM parsed",
    "trace_files": f"""WITH {TRACES} SELECT p.log_id, n_files AS files, coalesce(paths, '') AS paths, top_path AS top_file FROM parsed p
        LEFT JOIN (SELECT log_id, string_agg(file_path, ',' ORDER BY pos) AS paths FROM files GROUP BY 1) USING (log_id)""",
    "parsed_summary": f"WITH {TRACES} SELECT log_id, summary FROM summarised",
    "source_lines": f"""WITH {CODE} SELECT 'HEAD' AS ref, file_path, generate_subscripts(lines, 1)::INT AS line_no,
        unnest(lines) AS text FROM code""",
    "file_requests": f"""WITH {TRACES} SELECT log_id, pos, 'HEAD' AS ref, file_path, language,
        array_to_string(marks, ',') AS highlight_lines, center FROM files WHERE pos < 2""",
    "snippets": f"WITH {SNIPPETS} SELECT log_id, pos, file_path, start_line, end_line, content, marked_content, commit_sha FROM snip",
    "snippet_markdown": f"""WITH {SNIPPETS} SELECT log_id, pos, '**文件**: `' || file_path || '`  **行**: ' || start_line || '–' || end_line ||
        '  **报错行**: ' || array_to_string(marks, ', ') || chr(10) || '```' || language || chr(10) || content || chr(10) || '```'
        AS markdown FROM snip""",
    "retrieval_coverage": f"""WITH {SNIPPETS} SELECT log_id, count(s.pos) AS found_files, count(*) AS requested_files,
        count(s.pos) / count(*) AS coverage FROM files f LEFT JOIN snip s USING (log_id, pos)
        WHERE f.pos < {V.MAX_FILES} GROUP BY 1""",
    "rca_prompts": f"""WITH {_RCA} SELECT log_id, user_prompt, (length({q(V.RCA_SYSTEM)}) + length(user_prompt))::INT AS prompt_chars,
        found_files FROM rca""",
    "rca_prompts_tight": f"""WITH {_rca(BUDGET)} SELECT log_id, user_prompt,
        (length({q(V.RCA_SYSTEM)}) + length(user_prompt))::INT AS prompt_chars, found_files FROM rca""",
    "snippets_by_ref": f"""{_BY_REF} SELECT log_id, pos, ref, file_path, start_line, end_line, commit_sha,
        coalesce(array_to_string(list_transform(range(start_line, end_line + 1), lambda n:
          lpad(n::VARCHAR, 6, ' ') || ' | ' || lines[n]), chr(10)), '') AS content FROM placed""",
    "report_refs": f"""{_BY_REF} SELECT l.log_id, CASE WHEN l.log_id % 3 = 0 THEN 'HEAD' ELSE 'v1' END AS git_ref,
        count(p.pos)::INT AS found_files FROM logs l LEFT JOIN placed p ON p.log_id = l.log_id AND NOT p.from_tree GROUP BY 1, 2""",
    "rule_stats": f"""{_SCANNED} SELECT count(*) AS total_rules, count(*) FILTER (severity = 'P0_CRITICAL') AS p0_rules,
        count(*) FILTER (severity = 'P1_HIGH') AS p1_rules, count(*) FILTER (severity = 'P3_IGNORE') AS p3_rules
        FROM rules WHERE rule_name IN (SELECT rule_name FROM scan)""",
    "rca_reports": f"""WITH {_RCA} SELECT log_id, 'HEAD' AS git_ref, error_type, found_files, {_answer("md5(user_prompt)")} AS markdown,
        'stub' AS model, 'ok' AS status, NULL::VARCHAR AS error FROM rca""",
    "token_usage": f"""WITH {_RCA} SELECT log_id, length(user_prompt) AS prompt_tokens,
        ('0x' || substr(md5(user_prompt), 1, 1))::BIGINT AS completion_tokens FROM rca""",
    "report_texts": f"""WITH {_RCA} SELECT log_id, '# 根因分析报告：' || log_id || chr(10) || chr(10) || {_answer("md5(user_prompt)")} AS value
        FROM rca""",
    "sft_rows": f"WITH {SFT} SELECT * FROM sft",
    "sft_chat": f"""WITH {SFT} SELECT conv_id, turn, 0 AS pos, 'user' AS role, prompt || chr(10) || chr(10) || query AS content FROM sft
        UNION ALL SELECT conv_id, turn, 1, 'assistant', response FROM sft""",
    "sft_cutoff": f"""WITH {SFT}, t AS (SELECT conv_id, turn,
        len(regexp_extract_all(prompt || ' ' || query || ' ' || response, '\\S+'))::INT AS tokens FROM sft)
        SELECT *, tokens > 100 AS over_cutoff FROM t""",
    "sft_sample": f"WITH {SFT} SELECT * FROM sft ORDER BY conv_id, turn LIMIT 100",
    "sft_split": f"""WITH {SFT} SELECT conv_id, turn, CASE WHEN
        ('0x' || substr(md5(conv_id || chr(31) || turn), 1, 8))::BIGINT % 1000 < 100 THEN 'validation' ELSE 'train' END AS split FROM sft""",
    "label_distribution": f"{_PLAIN} "
    + _DISTRIBUTION.format(
        counted="""SELECT CASE WHEN json_valid(raw_output) THEN CASE WHEN json_extract_string(raw_output, '$.severity') IN
        ('P0_CRITICAL', 'P1_HIGH', 'P2_WARNING', 'P3_IGNORE') THEN json_extract_string(raw_output, '$.severity') ELSE 'UNKNOWN' END
        ELSE 'UNKNOWN' END AS severity, count(*) AS n FROM results GROUP BY 1"""
    ),
    "stream_dedup": f"""WITH RECURSIVE {_WINDOW_GROUPS}
        SELECT {_WINDOW_COLUMNS}, representative_log, service_name, error_type FROM groups""",
    "stream_triage": f"""{_results(_WINDOW_GROUPS, "kind")} SELECT log_id, kind, severity, handler, source FROM results
        JOIN (VALUES ('P0_CRITICAL', 'audit'), ('P1_HIGH', 'audit'), ('P2_WARNING', 'audit'), ('P3_IGNORE', 'audit'),
        ('P3_IGNORE', 'ignored_archive')) t(severity, handler) USING (severity) WHERE kind <> 'FLUSH'""",
    "block_snippets": f"WITH {SNIPPETS} SELECT log_id, pos, file_path, start_line, end_line, content, marked_content, commit_sha FROM snip",
    "kept_answers": f"""{_PLAIN} SELECT fingerprint, severity, reason, source, 0::BIGINT AS asked_again FROM results""",
    "snapshot_store": f"""WITH paths AS (SELECT unnest([{", ".join(f"{q(a)} || doc_id || {q(b)}" for a, b in CODE_PATHS)}]) AS file_path, doc_id, text
        FROM documents), held AS (SELECT 'HEAD' AS ref, file_path, '' AS commit_sha, text FROM paths UNION ALL
        SELECT 'v2', file_path, 'beef002', CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'v2' ELSE text END FROM paths),
        first AS (SELECT text, min(ref) AS ref FROM held GROUP BY 1), added AS (SELECT ref, count(*) AS n FROM first GROUP BY 1)
        SELECT h.ref, file_path, commit_sha, md5(h.text) AS digest, n AS texts_added FROM held h JOIN added USING (ref)""",
    "numbered_lines": f"""WITH {LOGS}, lines AS (SELECT log_id AS id, unnest(string_split(raw_log, chr(10))) AS line,
        generate_subscripts(string_split(raw_log, chr(10)), 1) AS pos FROM logs), numbered AS (
        SELECT row_number() OVER (ORDER BY id, pos) - 1 AS log_id, rtrim(line) AS raw_log FROM lines)
        SELECT * FROM numbered WHERE raw_log <> ''""",
    "observed_stats": f"""{_PLAIN} SELECT 'severity ' || severity AS metric, n::DOUBLE AS value FROM (SELECT s.severity, coalesce(n, 0) AS n
        FROM (SELECT severity FROM {_SEVERITIES}) s LEFT JOIN (SELECT severity, count(*) AS n FROM results GROUP BY 1) c USING (severity))
        UNION ALL SELECT 'source ' || source, coalesce(n, 0) FROM (VALUES ('rule'), ('llm'), ('default')) t(source)
        LEFT JOIN (SELECT source, count(*) AS n FROM results GROUP BY 1) USING (source)
        UNION ALL SELECT unnest(['total', 'rule_hits', 'model_calls', 'mean_model_ms', 'rule_hit_rate']),
        unnest([count(*), count(*) FILTER (source = 'rule'), count(*) FILTER (source = 'llm'),
        coalesce(sum(length(raw_output)) FILTER (source = 'llm') / count(*) FILTER (source = 'llm'), 0),
        count(*) FILTER (source = 'rule') / count(*)]::DOUBLE[]) FROM results""",
    "indexed_rules": f"""{_SCANNED} SELECT log_id, rule_name, severity, reason, action FROM scan LEFT JOIN rules USING (rule_name)""",
    "rule_set_stats": f"""{_SCANNED}, used AS (SELECT rule_name, count(*) AS n FROM scan GROUP BY 1)
        SELECT count(*) AS total_rules, count(*) FILTER (severity = 'P0_CRITICAL') AS p0_rules,
        count(*) FILTER (severity = 'P1_HIGH') AS p1_rules, count(*) FILTER (severity = 'P3_IGNORE') AS p3_rules,
        count(n) AS rules_hit, coalesce(sum(n), 0)::BIGINT AS logs_hit FROM rules LEFT JOIN used USING (rule_name)""",
    "sft_sample_half": f"WITH {SFT} SELECT * FROM sft ORDER BY conv_id, turn LIMIT (SELECT count(*) // 2 FROM sft)",
    "sft_json_rows": f"WITH {SFT} SELECT prompt, query, response FROM sft",
    "incident_files": f"""WITH {TRACES.replace(LOGS, _INCIDENTS)} SELECT i.log_id AS incident, language, error_type, error_message,
        length(i.raw_log) AS chars FROM parsed JOIN logs i USING (log_id)""",
    "snapshot_files": """WITH bundles AS (SELECT doc_id // 10 AS bundle, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text
        FROM documents GROUP BY 1), held AS (SELECT 'HEAD' AS ref, 'c0ffee1' AS commit_sha, bundle, text FROM bundles
        UNION ALL SELECT 'v1', '0a1b2c3', bundle, 'v1' || chr(10) || text FROM bundles WHERE bundle % 2 = 0)
        SELECT ref, commit_sha, bundle, length(text) AS chars, md5(text) AS digest FROM held""",
    "stream_timer_dedup": f"WITH RECURSIVE {_TIMER_WINDOWS} SELECT {_WINDOW_COLUMNS} FROM timed",
    "stream_timer_triage": f"""{_results(_TIMER_GROUPS, "kind")} SELECT log_id, kind, severity, handler, source FROM results
        JOIN (VALUES ('P0_CRITICAL', 'audit'), ('P1_HIGH', 'audit'), ('P2_WARNING', 'audit'), ('P3_IGNORE', 'audit'),
        ('P3_IGNORE', 'ignored_archive')) t(severity, handler) USING (severity)""",
    "stream_late_logs": f"""WITH timed AS (SELECT event_id AS log_id, epoch_us(ts) AS t, min(epoch_us(ts)) OVER () AS low,
        max(epoch_us(ts)) OVER () AS high FROM events), parted AS (SELECT log_id, t,
        least(floor((t - low) * {PARTS} / (high - low + 1))::BIGINT + (log_id % 10 = 0)::INT, {PARTS - 1}) AS batch_id FROM timed),
        newest AS (SELECT batch_id, max(max(t)) OVER (ORDER BY batch_id) AS t FROM parted GROUP BY batch_id),
        judged AS (SELECT p.log_id, p.batch_id, coalesce(p.t <= n.t - {LATE_SECONDS * 1_000_000}, FALSE) AS is_late
        FROM parted p LEFT JOIN newest n ON n.batch_id = p.batch_id - 1)
        SELECT *, count(*) FILTER (NOT is_late) OVER (PARTITION BY batch_id) AS on_time,
        count(*) FILTER (is_late) OVER (PARTITION BY batch_id) AS late FROM judged""",
    "stream_window_counts": f"""WITH {MARKED}, counted AS (SELECT date_trunc('day', ts) AS window_start,
        date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, fingerprint, count(*) AS count FROM marked GROUP BY 1, 2, 3)
        SELECT * FROM counted""",
    "window_counts": f"""WITH {MARKED} SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
        fingerprint, count(*) AS count FROM marked GROUP BY 1, 2, 3""",
}
