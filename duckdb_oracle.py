"""DuckDB SQL for every registered query, written apart from the Spark code.

``ACTIVITY``, ``EDGES`` and ``LOGS`` derive the three tables as FIXTURES.md
says; each statement puts those it needs in front of its own text.
"""

from __future__ import annotations

_MICROS = "(({k} * 15485863) % 207705600 * 1000000 + ({k} * 131) % 1000000)"


def _micros(k: str) -> str:
    return _MICROS.format(k=k)


def _created(k: str) -> str:
    return f"(TIMESTAMP '1995-01-01' + to_microseconds({_micros(k)}))"


def _run_id(k: str) -> str:
    ms = f"lpad(lower(hex(788918400000 + {_micros(k)} // 1000)), 12, '0')"
    return (
        f"({ms}[1:8] || '-' || {ms}[9:12] || CASE WHEN {k} % 97 = 0 THEN '-4' ELSE '-7' END "
        f"|| '000-8000-' || lpad(lower(hex({k})), 12, '0'))"
    )


def _app(k: str) -> str:
    return (
        f"CASE WHEN {k} % 101 = 0 THEN NULL WHEN {k} % 103 = 0 THEN '' "
        f"WHEN {k} % 3 = 0 THEN 'app0' ELSE 'app' || ({k} % 12) END"
    )


ACTIVITY = f"""
run_base AS (
  SELECT o.*, o_orderkey AS k, o_custkey AS c, {_created("o_orderkey")} AS created_on,
    CASE WHEN o_orderkey % 20 IN (0,1,2,3,4,5,6,7,8,9,10,11,19) THEN 'succeeded'
         WHEN o_orderkey % 20 IN (12, 13) THEN 'failed' WHEN o_orderkey % 20 = 14 THEN 'canceled'
         WHEN o_orderkey % 20 IN (15, 16) THEN 'skipped' WHEN o_orderkey % 20 = 17 THEN 'running'
         ELSE 'pending' END AS status
  FROM orders o
),
run_started AS (
  SELECT *, CASE WHEN status <> 'pending' THEN created_on + to_milliseconds(k % 5000) END AS started_on
  FROM run_base
),
activity AS (
  SELECT {_run_id("k")} AS id, created_on, {_app("k")} AS application,
    CASE o_orderstatus WHEN 'F' THEN 'prod' WHEN 'O' THEN 'test' ELSE 'dev' END AS environment,
    o_orderpriority AS activity_type,
    CASE WHEN k % 50 <> 0 THEN 'job' || (c % 150) END AS activity_key,
    'dw.customer_' || c || CASE k % 7 WHEN 0 THEN '%' WHEN 1 THEN '!' WHEN 2 THEN '_' ELSE '' END AS target,
    status, started_on,
    CASE WHEN status NOT IN ('pending', 'running')
      THEN started_on + to_microseconds(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * 37) END AS completed_on,
    CASE WHEN k % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS records_impacted,
    CASE WHEN status IN ('failed', 'canceled') THEN 'E' || (k % 5) END AS error_type,
    'host' || (c % 40) AS host,
    CASE WHEN k % 43 = 0 THEN ' ' WHEN k % 41 = 0 THEN 'oops' ELSE '{{"k": ' || k || '}}' END AS parameters,
    CASE WHEN k % 2 = 0 THEN '[' || (k % 9) || ', null]' END AS metrics,
    d.text AS error, c AS created_by, CAST(k % 65536 AS INTEGER) AS process_id,
    CASE WHEN k % 5 = 0 THEN '' WHEN k > 0 THEN {_run_id("(k - 1)")} END AS parent_activity_id,
    {_run_id("(k - k % 100)")} AS root_activity_id,
    lpad(lower(hex(k)), 12, '0') AS trace_id
  FROM run_started
  LEFT JOIN documents d ON d.doc_id = c AND status IN ('failed', 'canceled')
)"""

EDGES = f"""
edge_base AS (SELECT o_orderkey AS k FROM orders),
activity_input AS (
  SELECT {_run_id("k")} AS activity_id, {_run_id("(k - 1)")} AS input_activity_id, 'previous' AS input_role,
    {_created("k")} AS created_on FROM edge_base WHERE k >= 1
  UNION ALL
  SELECT {_run_id("k")}, {_run_id("(k - 2)")}, 'baseline', {_created("k")} FROM edge_base WHERE k % 3 = 0 AND k >= 2
  UNION ALL
  SELECT {_run_id("k")}, {_run_id("(k - k % 100)")}, 'hub', {_created("k")} FROM edge_base WHERE k % 100 <> 0
  UNION ALL
  SELECT {_run_id("k")}, 'gone-' || k, 'lost', {_created("k")} FROM edge_base WHERE k % 31 = 0
)"""

LOGS = f"""
line_base AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS flag,
    CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS cents,
    CAST(CAST(l_quantity AS BIGINT) % 7 AS INTEGER) AS log_level, d.text AS text
  FROM lineitem LEFT JOIN documents d ON d.doc_id = l_partkey
),
log_entries AS (
  SELECT (k * 8 + n) * 1048576 + (p * 31 + s * 17 + cents) % 1048576 AS id,
    {_created("k")} + to_microseconds(CAST(n + CASE n WHEN 6 THEN 1800 WHEN 7 THEN 4320 ELSE 0 END AS BIGINT)
      * 60000000 + (p % 60000) * 1000 + s % 1000) AS event_time_utc,
    log_level,
    CASE WHEN p % 17 <> 0 THEN 'Svc.' || flag || '.' || (p % 15) END AS category,
    CAST(s % 100 AS INTEGER) AS event_id, 'Event' || (s % 100) AS event_name,
    text AS message, '{{text}}' AS message_template,
    CASE WHEN p % 31 = 0 THEN '' WHEN p % 29 = 0 THEN 'not json {{' ELSE '{{"part": ' || p || '}}' END AS properties,
    CASE WHEN log_level >= 4 AND p % 2 = 0 THEN text END AS exception,
    CASE WHEN log_level >= 4 AND p % 2 = 0 THEN
      CASE p % 3 WHEN 0 THEN 'IOException' WHEN 1 THEN 'TimeoutException' ELSE 'KeyError' END END AS exception_type,
    {_run_id("k")} AS activity_id, lpad(lower(hex(k)), 12, '0') AS trace_id,
    {_app("k")} AS application, 'host' || (s % 40) AS host
  FROM line_base
)"""

_WINDOW = "created_on >= TIMESTAMP '1995-01-01' AND created_on < TIMESTAMP '2002-01-01'"
_LOG_WINDOW = _WINDOW.replace("created_on", "event_time_utc")
_YEAR = "created_on >= TIMESTAMP '2000-08-01' AND created_on < TIMESTAMP '2001-08-01'"
_CAPPED = "created_on >= TIMESTAMP '2001-01-01' AND created_on < TIMESTAMP '2002-01-01'"
_NOW = "TIMESTAMP '2001-08-01'"
# The notes, and below the statement rule's words and reasons.
_HISTORY_NOTE = "window capped to the ~12-month activity retention horizon"
_NOTE = (
    "window predates the ~90-day log retention horizon; "
    "logs may have been dropped even if the activity resolves"
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _ms(a: str = "started_on", b: str = "completed_on") -> str:
    return f"CAST(round_even((epoch_us({b}) - epoch_us({a})) / 1000.0::DOUBLE, 0) AS BIGINT)"


def _spent(ms: str) -> str:
    return (
        f"CASE WHEN {ms} IS NULL OR {ms} < 0 THEN NULL WHEN {ms} < 1000 THEN {ms} || 'ms' ELSE "
        f"CASE WHEN {ms} >= 86400000 THEN ({ms} // 86400000) || 'd ' ELSE '' END || "
        f"CASE WHEN {ms} // 3600000 % 24 > 0 THEN ({ms} // 3600000 % 24) || 'h ' ELSE '' END || "
        f"CASE WHEN {ms} // 60000 % 60 > 0 THEN ({ms} // 60000 % 60) || 'm ' ELSE '' END || "
        f"({ms} // 1000 % 60) || 's' END"
    )


def _id_time(x: str) -> str:
    """Ids in the derived tables are all hyphenated and in range."""
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') "
        f"THEN make_timestamp(CAST('0x' || {x}[1:8] || {x}[10:13] AS BIGINT) * 1000) END"
    )


def _json(x: str) -> str:
    return (
        f"CASE WHEN trim({x}) = '' THEN NULL WHEN json_valid({x}) THEN CAST(json({x}) AS VARCHAR) "
        f"ELSE CAST(to_json({x}) AS VARCHAR) END"
    )


def _cursor(time: str, row: str) -> str:
    ticks = f"(epoch_us({time}) * 10 + 621355968000000000)"
    return f"to_base64(encode(CAST({ticks} AS VARCHAR) || '|' || {row}))"


_RATE = (
    "round_even(count(*) FILTER (status = 'succeeded') * 1.0::DOUBLE "
    "/ nullif(count(*) FILTER (status IN ('succeeded', 'failed', 'canceled')), 0) * 10000, 0) / 10000"
)
_LEVELS = ("trace", "debug", "information", "warning", "error", "critical")
_LEVEL_COUNTS = ", ".join(
    f"nullif(count(*) FILTER (log_level = {i}), 0) AS {n}" for i, n in enumerate(_LEVELS)
)
_LEVEL_NAME = (
    "CASE log_level WHEN 0 THEN 'Trace' WHEN 1 THEN 'Debug' WHEN 2 THEN 'Information' WHEN 3 THEN 'Warning' "
    "WHEN 4 THEN 'Error' WHEN 5 THEN 'Critical' WHEN 6 THEN 'None' ELSE 'Unknown' END"
)


def _summary(error: bool) -> str:
    err = (
        "left(error, 500) AS error, length(error) > 500 AS error_truncated"
        if error
        else "CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BOOLEAN) AS error_truncated"
    )
    return (
        f"id, {_iso('created_on')} AS created_on_utc, application, environment, activity_type, activity_key, "
        f"target, status, {_iso('started_on')} AS started_on_utc, {_iso('completed_on')} AS completed_on_utc, "
        f"{_ms()} AS duration_ms, {_spent(_ms())} AS duration, records_impacted, {err}, error_type, host"
    )


def _line(chars: int | None) -> str:
    def cut(name: str) -> str:
        if chars is None:
            return f"{name}, CASE WHEN {name} IS NOT NULL THEN false END AS {name}_truncated"
        return f"left({name}, {chars}) AS {name}, length({name}) > {chars} AS {name}_truncated"

    return (
        f"id, {_iso('event_time_utc')} AS event_time_utc, {_LEVEL_NAME} AS level, category, event_id, event_name, "
        f"{cut('message')}, message_template, {_json('properties')} AS properties, exception_type, "
        f"{cut('exception')}, activity_id, trace_id, CAST(NULL AS VARCHAR) AS span_id, application, host"
    )


def _page(columns: str, table: str, time: str, where: str, limit: int) -> str:
    order = f"ORDER BY {time} DESC, id DESC"
    return (
        f", numbered AS (SELECT *, row_number() OVER ({order}) AS position, "
        f"count(*) OVER () AS available FROM {table} WHERE {where})"
        f" SELECT position, {columns}, CASE WHEN position = {limit} AND available > {limit} "
        f"THEN {_cursor(time, 'id')} END AS next_cursor FROM numbered WHERE position <= {limit}"
    )


def _overview(keys: str, kind: str, table: str = "activity", source: str = "") -> str:
    return f"""
SELECT application, {kind} AS activity_type, count(*) AS runs,
  count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'canceled') AS canceled, count(*) FILTER (status = 'running') AS running,
  count(*) FILTER (status = 'skipped') AS skipped, {_RATE} AS success_rate,
  CAST(round_even(CAST(sum(epoch_us(completed_on) - epoch_us(started_on)) AS DOUBLE)
    / (1000 * count(epoch_us(completed_on) - epoch_us(started_on))), 0) AS BIGINT) AS avg_duration_ms,
  CAST(NULL AS BIGINT) AS p95_duration_ms, CAST(sum(records_impacted) AS DECIMAL(38, 0)) AS total_records_impacted,
  {_iso("max(created_on)")} AS last_run_utc,
  {_iso("max(created_on) FILTER (status IN ('failed', 'canceled'))")} AS last_failure_utc{source}
FROM {table} WHERE {_WINDOW} GROUP BY {keys}"""


_TOP_KEYS = f"""
key_counts AS (
  SELECT application, activity_key, count(*) AS run_count FROM activity
  WHERE {_WINDOW} AND activity_key IS NOT NULL GROUP BY ALL
),
top_keys AS (
  SELECT coalesce(application, '') AS app, activity_key, run_count,
    row_number() OVER (PARTITION BY coalesce(application, '')
      ORDER BY run_count DESC, activity_key, application NULLS FIRST) AS rank
  FROM key_counts QUALIFY rank <= 10
)"""

_NEAR = f"""
dated AS (SELECT *, {_id_time("activity_id")} AS center FROM log_entries),
near AS (
  SELECT * FROM dated WHERE center IS NULL
    OR (event_time_utc >= center - INTERVAL 2 DAY AND event_time_utc < center + INTERVAL 2 DAY)
)"""


def _note(x: str) -> str:
    return f"CASE WHEN {x} < {_NOW} - INTERVAL 90 DAY THEN '{_NOTE}' END AS note"


_TOTALS = (
    f"count(*) AS total, {_LEVEL_COUNTS}, {_iso('min(event_time_utc)')} AS first_event_utc, "
    f"{_iso('max(event_time_utc)')} AS last_event_utc"
)

_TOP_CATEGORIES = """
top_categories AS (
  SELECT activity_id, category, count(*) AS count,
    row_number() OVER (PARTITION BY activity_id ORDER BY count(*) DESC, category NULLS FIRST) AS rank
  FROM near GROUP BY activity_id, category QUALIFY rank <= 10
)"""
_TOP_EXCEPTIONS = """
top_exceptions AS (
  SELECT activity_id, exception_type AS type, count(*) AS count, left(min(message), 500) AS sample_message,
    length(min(message)) > 500 AS sample_message_truncated,
    row_number() OVER (PARTITION BY activity_id ORDER BY count(*) DESC, exception_type) AS rank
  FROM near WHERE exception_type IS NOT NULL GROUP BY activity_id, exception_type QUALIFY rank <= 10
)"""


def _numbered(where: str, order: str, source: str = "log_entries") -> str:
    return (
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY {order}) AS position, "
        f"count(*) OVER (PARTITION BY activity_id) AS available FROM {source} WHERE {where})"
    )


def _run_page(columns: str, limit: int) -> str:
    return (
        f" SELECT position, {columns}, CASE WHEN position = {limit} AND available > {limit} "
        f"THEN {_cursor('event_time_utc', 'id')} END AS next_cursor, {_note('hi')} "
        f"FROM numbered WHERE position <= {limit}"
    )


# Window by id: a day either side, or the retention horizon if the id has no time.
_BY_ID = f"""
dated AS (SELECT *, {_id_time("activity_id")} AS t FROM log_entries),
placed AS (
  SELECT *, coalesce(t - INTERVAL 1 DAY, {_NOW} - INTERVAL 90 DAY) AS lo,
    coalesce(t + INTERVAL 1 DAY, {_NOW} + INTERVAL 1 DAY) AS hi FROM dated
)"""


def _ordered(order: str) -> str:
    """Lines inside their window with their number and the cursor of the place behind them."""
    return (
        f"ordered AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY {order}) AS r, "
        f"{_cursor('event_time_utc', 'id')} AS here FROM placed WHERE event_time_utc >= lo AND event_time_utc < hi)"
    )


def _lineage(near: str, far: str, direction: str) -> str:
    return f"""{_with(ACTIVITY, EDGES)},
link AS (SELECT {near} AS a, {far} AS b, input_role AS role FROM activity_input),
s0 AS (SELECT id AS seed, id AS node FROM activity),
n1 AS (SELECT DISTINCT seed, b AS node FROM s0 JOIN link ON a = node WHERE b <> seed),
seen1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM n1),
n2 AS (SELECT DISTINCT n1.seed, b AS node FROM n1 JOIN link ON a = n1.node
  WHERE NOT EXISTS (SELECT 1 FROM seen1 x WHERE x.seed = n1.seed AND x.node = b)),
seen2 AS (SELECT * FROM seen1 UNION ALL SELECT * FROM n2),
n3 AS (SELECT DISTINCT n2.seed, b AS node FROM n2 JOIN link ON a = n2.node
  WHERE NOT EXISTS (SELECT 1 FROM seen2 x WHERE x.seed = n2.seed AND x.node = b)),
found AS (
  SELECT f.seed, 1 AS depth, role, b FROM s0 f JOIN link ON a = f.node JOIN n1 t ON t.seed = f.seed AND t.node = b
  UNION ALL
  SELECT f.seed, 2, role, b FROM n1 f JOIN link ON a = f.node JOIN n2 t ON t.seed = f.seed AND t.node = b
  UNION ALL
  SELECT f.seed, 3, role, b FROM n2 f JOIN link ON a = f.node JOIN n3 t ON t.seed = f.seed AND t.node = b
)
SELECT seed AS seed_id, '{direction}' AS direction, depth, role, b AS activity_id, activity_type, target, status,
  {_iso("started_on")} AS started_on_utc, {_iso("created_on")} AS created_on_utc, records_impacted,
  false AS depth_limited
FROM found JOIN activity ON id = b"""


# Not quantile_cont(): it interpolates with other intermediate values, which
# shows where the result lies halfway between two whole numbers.
_SORTED = "list_sort(list(ms) FILTER (ms IS NOT NULL))"
_RANK = "(CAST(0.95 AS DOUBLE) * (count(ms) - 1))"
_AT = f"{_SORTED}[CAST(floor({_RANK}) AS BIGINT) + 1]"
_P95 = (
    f"CAST(round_even({_AT} + ({_SORTED}[CAST(ceil({_RANK}) AS BIGINT) + 1] - {_AT}) "
    f"* ({_RANK} - floor({_RANK})), 0) AS BIGINT)"
)


def _stats(by: str, where: str, limit: int, not_null: str, note: str, more: str = "") -> str:
    return f"""{_with(ACTIVITY)},
latest AS (
  SELECT *, {_ms()} AS ms FROM activity WHERE {where} AND {not_null} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY created_on DESC, id DESC) <= {limit}
)
SELECT {by}, {more} {note} AS note, count(*) AS count, count(*) FILTER (status = 'skipped') AS skipped, {_RATE} AS success_rate,
  min(ms) AS min_duration_ms, CAST(round_even(avg(ms), 0) AS BIGINT) AS avg_duration_ms,
  {_P95} AS p95_duration_ms, max(ms) AS max_duration_ms,
  CAST(round_even(avg(records_impacted), 0) AS BIGINT) AS avg_records_impacted
FROM latest GROUP BY {by}"""


# Fixed values of the statement rule, here and in the reasons below.
_WORDS = (
    "INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE|TRUNCATE|GRANT|REVOKE|CALL|EXEC|EXECUTE|LOAD|INTO|OUTFILE|"
    "DUMPFILE|HANDLER|LOCK|UNLOCK|SET|USE|RENAME|ATTACH|MERGE|DELIMITER"
)
_NOT_WORD = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
_SPACE = r"[\s\x0b\x{85}\p{Z}]"

_AUDIT = rf"""
WITH statement AS (
  SELECT doc_id, unnest(['bare', 'quoted', 'cte', 'chained']) AS form,
    unnest([text, ' select ''' || text || ''' ;; ' || chr(10), '(WITH t AS (SELECT 1 /' || text || ') SELECT 1',
      'SELECT 1; ' || text]) AS sql
  FROM documents
),
trimmed AS (
  SELECT doc_id, form, regexp_replace(rtrim(regexp_replace(sql, '^{_SPACE}+|{_SPACE}+$', '', 'g'),
    '; ' || chr(9) || chr(10) || chr(13)), '{_SPACE}+$', '') AS body
  FROM statement
),
judged AS (
  SELECT doc_id, form, CASE
    WHEN body = '' THEN 'Query text is required.'
    WHEN contains(body, ';') THEN 'Only a single statement is allowed (no '';'' chaining).'
    WHEN contains(body, '--') OR contains(body, '/*') OR contains(body, '#') THEN 'SQL comments are not allowed.'
    WHEN NOT regexp_matches(body, '(?i)^{_SPACE}*\(*{_SPACE}*(SELECT|WITH)({_NOT_WORD}|$)')
      THEN 'Only SELECT or WITH (CTE) queries are allowed.'
    WHEN regexp_matches(body, '(?i)(^|{_NOT_WORD})({_WORDS})({_NOT_WORD}|$)')
      THEN 'Disallowed keyword in query: '
        || upper(regexp_extract(body, '(?i)(^|{_NOT_WORD})({_WORDS})({_NOT_WORD}|$)', 2)) || '.'
    END AS reason
  FROM trimmed
)
SELECT doc_id, form, reason IS NULL AS accepted, reason FROM judged"""

_EDGE_COUNTS = f"""
ins AS (
  SELECT activity_id, count(*) AS n FROM (SELECT *, {_id_time("activity_id")} AS t FROM activity_input)
  WHERE t IS NULL OR (created_on >= t - INTERVAL 2 DAY AND created_on < t + INTERVAL 2 DAY) GROUP BY activity_id
),
outs AS (SELECT input_activity_id, count(*) AS n FROM activity_input GROUP BY input_activity_id)"""

_DETAIL = f"""{_with(ACTIVITY, EDGES, LOGS)}, {_EDGE_COUNTS},
levels AS (
  SELECT l.activity_id, {_LEVEL_COUNTS.replace("AS ", "AS level_")} FROM log_entries l JOIN activity a ON a.id = l.activity_id
    AND event_time_utc >= coalesce(started_on, created_on) - INTERVAL 1 DAY
    AND event_time_utc < coalesce(completed_on, created_on) + INTERVAL 1 DAY
  GROUP BY l.activity_id
)
SELECT {_summary(True)},
  nullif(parent_activity_id, '') AS parent_activity_id, nullif(root_activity_id, '') AS root_activity_id, trace_id,
  CAST(NULL AS VARCHAR) AS span_id, {_iso("completed_on")} AS last_heartbeat_on_utc,
  {_json("parameters")} AS parameters, {_json("metrics")} AS metrics, CAST(created_by AS VARCHAR) AS created_by,
  CAST(NULL AS VARCHAR) AS scheduler_instance_id, CAST(NULL AS VARCHAR) AS fire_instance_id,
  CAST(NULL AS VARCHAR) AS quartz_job_name, CAST(NULL AS VARCHAR) AS quartz_job_group,
  CAST(NULL AS VARCHAR) AS quartz_trigger_name, CAST(NULL AS VARCHAR) AS quartz_trigger_group, process_id,
  {", ".join(f"level_{n}" for n in _LEVELS)},
  coalesce(ins.n, 0) AS input_count, coalesce(outs.n, 0) AS output_count
FROM activity a LEFT JOIN levels v ON v.activity_id = id LEFT JOIN ins ON ins.activity_id = id
LEFT JOIN outs ON outs.input_activity_id = id
WHERE {_id_time("id")} IS NULL OR (created_on >= {_id_time("id")} - INTERVAL 2 DAY
  AND created_on < {_id_time("id")} + INTERVAL 2 DAY)"""

def _detail(center: str, unknown: str) -> str:
    """The same for runs asked for with their start as the hint, which also places the edges."""
    t = center.format(t=_id_time("id"))
    near = f"({unknown.format(t=_id_time('id'))}(created_on >= {t} - INTERVAL 2 DAY AND created_on < {t} + INTERVAL 2 DAY))"
    edge = near.replace("created_on", "e.created_on").replace("started_on", "r.started_on").replace(_id_time("id"), _id_time("e.activity_id"))
    ins = (
        f"ins AS (SELECT e.activity_id, count(*) AS n FROM activity_input e JOIN activity r ON r.id = e.activity_id "
        f"WHERE {edge} GROUP BY e.activity_id), outs AS"
    )
    head, tail = _DETAIL.split("WHERE " + _id_time("id") + " IS NULL OR")[0], near
    start, end = head.index("ins AS ("), head.index("outs AS")
    return head[:start] + ins + head[end + len("outs AS") :] + "WHERE " + tail


_SEARCH = (
    f"{_LOG_WINDOW} AND log_level >= 4 AND contains(lower(category), 'svc.r') "
    "AND contains(lower(message), 'the') AND exception_type = 'IOException'"
)

SQL: dict[str, str] = {
    "catalog": f"""{_with(ACTIVITY, _TOP_KEYS)},
lists AS (SELECT app, string_agg(activity_key, ',' ORDER BY rank) AS activity_keys FROM top_keys GROUP BY app)
SELECT application, string_agg(DISTINCT activity_type, ',' ORDER BY activity_type) AS activity_types,
  coalesce(any_value(activity_keys), '') AS activity_keys, count(*) AS run_count,
  {_iso("min(created_on)")} AS first_seen_utc, {_iso("max(created_on)")} AS last_seen_utc
FROM activity LEFT JOIN lists ON app = coalesce(application, '') WHERE {_WINDOW} GROUP BY application""",
    "catalog_top_keys": f"{_with(ACTIVITY, _TOP_KEYS)} SELECT app AS application, rank, activity_key, run_count FROM top_keys",
    "catalog_keys_json": f"""{_with(ACTIVITY, _TOP_KEYS)}
SELECT '{{"application":' || to_json(app) || ',"rank":' || rank || ',"activity_key":' || to_json(activity_key)
  || ',"run_count":' || run_count || '}}' AS json FROM top_keys""",
    "fleet_overview": _with(ACTIVITY) + _overview("application", "CAST(NULL AS VARCHAR)"),
    "fleet_overview_by_type": _with(ACTIVITY) + _overview("application, activity_type", "activity_type"),
    "fleet_overview_sources": f"""{_with(ACTIVITY)},
split AS (SELECT *, CASE WHEN environment = 'prod' THEN 'Production' ELSE 'Other' END AS source FROM activity)
{_overview("application, source", "CAST(NULL AS VARCHAR)", "split", ", source")}""",
    "fleet_overview_levels": f"""{_with(ACTIVITY)},
per_type AS ({_overview("application, activity_type", "activity_type")}),
per_application AS ({_overview("application", "CAST(NULL AS VARCHAR)")}),
fleet AS ({_overview("()", "CAST(NULL AS VARCHAR)").replace("SELECT application,", "SELECT CAST(NULL AS VARCHAR) AS application,")})
SELECT *, 'type' AS level FROM per_type UNION ALL SELECT *, 'application' FROM per_application
UNION ALL SELECT *, 'fleet' FROM fleet""",
    "fleet_overview_folded": _with(ACTIVITY) + _overview("application", "CAST(NULL AS VARCHAR)"),
    "latest_runs_folded": f"""{_with(ACTIVITY)}
      SELECT id, {_iso("created_on")} AS created_on_utc, application, status, FALSE AS late FROM activity
      UNION ALL SELECT id, {_iso("created_on")}, application, status, TRUE FROM activity WHERE year(created_on) = 1996""",
    "fleet_overview_one_application": _with(ACTIVITY)
    + _overview("application, activity_type", "activity_type", "(SELECT * FROM activity WHERE application = 'app0')"),
    "recent_failures": f"""{_with(ACTIVITY)} SELECT {_summary(True)}, count(*) OVER () > 25 AS has_more FROM activity
WHERE {_WINDOW} AND status IN ('failed', 'canceled') ORDER BY created_on DESC, activity.id DESC LIMIT 25""",
    "activities_page_1": _with(ACTIVITY) + _page(_summary(False), "activity", "created_on", _WINDOW, 50),
    "activities_default_window": _with(ACTIVITY)
    + _page(_summary(False), "activity", "created_on", f"created_on >= {_NOW} - INTERVAL 7 DAY AND created_on < {_NOW}", 50),
    "activities_page_2": _with(ACTIVITY)
    + _page(
        _summary(False),
        "activity",
        "created_on",
        f"{_WINDOW} AND (created_on, id) < (TIMESTAMP '1999-12-31 23:59:59.999999', 'f')",
        200,
    ),
    "activities_broken_cursor": _with(ACTIVITY) + _page(_summary(False), "activity", "created_on", _WINDOW, 50),
    "activities_filtered": _with(ACTIVITY)
    + _page(
        _summary(False),
        "activity",
        "created_on",
        f"{_WINDOW} AND environment = 'prod' AND status = 'succeeded' AND contains(lower(target), 'customer_1')",
        200,
    ),
    "activities_wildcards": _with(ACTIVITY)
    + _page(_summary(False), "activity", "created_on", rf"{_WINDOW} AND target LIKE '%7!%%' ESCAPE '!'", 200),
    "activity_detail": _DETAIL,
    "activity_detail_full": _DETAIL.replace(
        "left(error, 500) AS error, length(error) > 500", "error, CASE WHEN error IS NOT NULL THEN false END"
    ),
    "missing_ids": f"""{_with(ACTIVITY, EDGES)}
SELECT DISTINCT input_activity_id AS activity_id FROM activity_input WHERE input_activity_id NOT IN (SELECT id FROM activity)""",
    "activity_get_ids": _detail("coalesce(started_on, {t})", "started_on IS NULL AND {t} IS NULL OR "),
    "log_summary_stats": f"""{_with(LOGS, _NEAR)}
SELECT activity_id, {_TOTALS}, {_note("any_value(center)")} FROM near GROUP BY activity_id""",
    "log_summary_stats_hinted": f"""{_with(ACTIVITY, LOGS)},
asked AS (SELECT id, coalesce(started_on, {_id_time("id")}) AS center FROM activity),
found AS (
  SELECT activity_id, {_TOTALS} FROM log_entries JOIN asked ON asked.id = activity_id AND (center IS NULL
    OR (event_time_utc >= center - INTERVAL 2 DAY AND event_time_utc < center + INTERVAL 2 DAY))
  GROUP BY activity_id
)
SELECT id AS activity_id, coalesce(total, 0) AS total, {", ".join(_LEVELS)}, first_event_utc, last_event_utc,
  {_note("center")} FROM asked LEFT JOIN found ON activity_id = id""",
    "log_summary_ids": f"""{_with(ACTIVITY, LOGS, _NEAR)},
found AS (SELECT activity_id, {_TOTALS} FROM near GROUP BY activity_id)
SELECT id AS activity_id, coalesce(total, 0) AS total, {", ".join(f"found.{n}" for n in _LEVELS)},
  first_event_utc, last_event_utc, {_note(_id_time("id"))} FROM activity LEFT JOIN found ON activity_id = id""",
    "log_summary_categories": f"""{_with(LOGS, _NEAR, _TOP_CATEGORIES)}
SELECT activity_id, rank, category, count FROM top_categories""",
    "log_summary_exceptions": f"""{_with(LOGS, _NEAR, _TOP_EXCEPTIONS)}
SELECT activity_id, rank, type, count, sample_message, sample_message_truncated FROM top_exceptions""",
    "activity_log_summary": f"""{_with(LOGS, _NEAR, _TOP_CATEGORIES, _TOP_EXCEPTIONS)},
stats AS (SELECT activity_id, {_TOTALS}, {_note("any_value(center)")} FROM near GROUP BY activity_id),
cats AS (SELECT activity_id, string_agg(coalesce(category, '<null>') || '=' || count, ',' ORDER BY rank) AS t
  FROM top_categories GROUP BY activity_id),
excs AS (SELECT activity_id, string_agg(type || '=' || count, ',' ORDER BY rank) AS t
  FROM top_exceptions GROUP BY activity_id)
SELECT stats.activity_id, total, {", ".join(_LEVELS)}, first_event_utc, last_event_utc,
  coalesce(cats.t, '') AS top_categories, coalesce(excs.t, '') AS exception_types, note
FROM stats LEFT JOIN cats USING (activity_id) LEFT JOIN excs USING (activity_id)""",
    "month_coverage_footers": f"""{_with(ACTIVITY, LOGS)},
times AS (SELECT 'activity' AS "table", created_on AS t FROM activity UNION ALL SELECT 'log_entries', event_time_utc FROM log_entries)
SELECT "table", CAST(year(t) * 100 + month(t) AS INTEGER) AS month, count(*) AS rows, {_iso("min(t)")} AS first_utc,
  {_iso("max(t)")} AS last_utc FROM times GROUP BY ALL""",
    "run_reports": f"""{_with(ACTIVITY, EDGES, LOGS, _NEAR, _TOP_CATEGORIES, _TOP_EXCEPTIONS)}, {_EDGE_COUNTS},
asked AS (SELECT id, {_id_time("id")} AS t FROM (SELECT id FROM activity UNION SELECT input_activity_id FROM activity_input)),
detail AS (
  SELECT a.*, coalesce(ins.n, 0) AS input_count, coalesce(outs.n, 0) AS output_count FROM activity a
  LEFT JOIN ins ON ins.activity_id = id LEFT JOIN outs ON outs.input_activity_id = id
  WHERE {_id_time("id")} IS NULL OR (created_on >= {_id_time("id")} - INTERVAL 2 DAY
    AND created_on < {_id_time("id")} + INTERVAL 2 DAY)
),
levels AS (
  SELECT l.activity_id, {_LEVEL_COUNTS.replace("AS ", "AS level_")} FROM log_entries l JOIN detail a ON a.id = l.activity_id
    AND event_time_utc >= coalesce(started_on, created_on) - INTERVAL 1 DAY
    AND event_time_utc < coalesce(completed_on, created_on) + INTERVAL 1 DAY
  GROUP BY l.activity_id
),
stats AS (SELECT activity_id, {_TOTALS} FROM near GROUP BY activity_id),
cats AS (SELECT activity_id, string_agg(coalesce(category, '<null>') || '=' || count, ',' ORDER BY rank) AS t
  FROM top_categories GROUP BY activity_id),
excs AS (SELECT activity_id, string_agg(type || '=' || count, ',' ORDER BY rank) AS t
  FROM top_exceptions GROUP BY activity_id),
windowed AS (
  SELECT l.*, coalesce(coalesce(started_on, created_on, t) - INTERVAL 1 DAY, {_NOW} - INTERVAL 90 DAY) AS lo,
    coalesce(coalesce(completed_on, created_on, t) + INTERVAL 1 DAY, {_NOW} + INTERVAL 1 DAY) AS hi
  FROM log_entries l JOIN asked k ON k.id = l.activity_id LEFT JOIN detail d ON d.id = l.activity_id
),
{_numbered("log_level >= 2 AND event_time_utc >= lo AND event_time_utc < hi", "event_time_utc, id", "windowed")},
shown AS ({_run_page("activity_id, id, concat_ws('|', id, " + _LEVEL_NAME + ", left(message, 20)) AS line", 3)}),
pages AS (SELECT activity_id, string_agg(line, ';' ORDER BY position) AS page, max(next_cursor) AS next_cursor
  FROM shown GROUP BY activity_id)
SELECT asked.id AS activity_id, coalesce(total, 0) AS total, {", ".join(f"stats.{n}" for n in _LEVELS)}, first_event_utc, last_event_utc,
  coalesce(cats.t, '') AS top_categories, coalesce(excs.t, '') AS exception_types, {_note("asked.t")},
  input_count, output_count, {", ".join(f"level_{n}" for n in _LEVELS)}, page, next_cursor
FROM asked LEFT JOIN detail ON detail.id = asked.id LEFT JOIN levels ON levels.activity_id = asked.id
LEFT JOIN stats ON stats.activity_id = asked.id LEFT JOIN cats ON cats.activity_id = asked.id
LEFT JOIN excs ON excs.activity_id = asked.id LEFT JOIN pages ON pages.activity_id = asked.id""",
    "activity_logs": f"""{_with(ACTIVITY, LOGS)},
placed AS (
  SELECT l.*, coalesce(started_on, created_on) - INTERVAL 1 DAY AS lo,
    coalesce(completed_on, created_on) + INTERVAL 1 DAY AS hi
  FROM log_entries l JOIN activity a ON a.id = l.activity_id
), {_numbered("log_level >= 2 AND event_time_utc >= lo AND event_time_utc < hi", "event_time_utc, id", "placed")}
{_run_page(_line(500), 200)}""",
    "activity_logs_by_id": f"""{_with(LOGS, _BY_ID)},
{_numbered("event_time_utc >= lo AND event_time_utc < hi", "event_time_utc, id", "placed")}
{_run_page(_line(500), 200)}""",
    "activity_logs_desc_page_2": f"""{_with(LOGS, _BY_ID)}, {_ordered("event_time_utc DESC, id DESC")},
asked AS (SELECT *, max(here) FILTER (r = 2) OVER (PARTITION BY activity_id) AS cursor FROM ordered),
{_numbered("r > 2", "event_time_utc DESC, id DESC", "asked")}
{_run_page("cursor, " + _line(500), 2)}""",
    "activity_logs_many_pages": f"""{_with(LOGS, _BY_ID)}, {_ordered("event_time_utc, id")},
numbered AS (
  SELECT *, (r - 1) % 2 + 1 AS position, lag(here, CAST((r - 1) % 2 + 1 AS INTEGER)) OVER (PARTITION BY activity_id ORDER BY r) AS cursor,
    count(*) OVER (PARTITION BY activity_id) AS n FROM ordered
)
SELECT position, cursor, {_line(500)}, CASE WHEN position = 2 AND n > r THEN here END AS next_cursor, {_note("hi")}
FROM numbered WHERE r BETWEEN 3 AND 6""",
    "activity_logs_exceptions": f"""{_with(LOGS, _BY_ID)},
{_numbered("event_time_utc >= lo AND event_time_utc < hi AND exception_type IS NOT NULL", "event_time_utc, id", "placed")}
{_run_page(_line(500), 200)}""",
    "activity_logs_filtered": f"""{_with(LOGS, _BY_ID)},
{_numbered("event_time_utc >= lo AND event_time_utc < hi AND contains(lower(category), 'svc.r') AND contains(lower(message), 'the')", "event_time_utc, id", "placed")}
{_run_page(_line(500), 200)}""",
    "logs_search": _with(LOGS)
    + _page(_line(500), "log_entries", "event_time_utc", f"{_LOG_WINDOW} AND log_level >= 3", 100),
    "logs_search_filtered": _with(LOGS) + _page(_line(None), "log_entries", "event_time_utc", _SEARCH, 500),
    "lineage_inputs_d3": _lineage("activity_id", "input_activity_id", "inputs"),
    "lineage_outputs_d3": _lineage("input_activity_id", "activity_id", "outputs"),
    "lineage_both_d3": f"""
SELECT * FROM ({_lineage("activity_id", "input_activity_id", "inputs")})
UNION ALL SELECT * FROM ({_lineage("input_activity_id", "activity_id", "outputs")})""",
    "history_runs": f"""{_with(ACTIVITY)},
latest AS (
  SELECT *, row_number() OVER (PARTITION BY application, activity_key ORDER BY created_on DESC, id DESC) AS position
  FROM activity WHERE {_YEAR} AND activity_key IS NOT NULL
)
SELECT position, {_summary(True)}, CAST(NULL AS VARCHAR) AS note FROM latest WHERE position <= 30""",
    "history_runs_capped": f"""{_with(ACTIVITY)},
latest AS (
  SELECT *, row_number() OVER (PARTITION BY application, activity_key ORDER BY created_on DESC, id DESC) AS position
  FROM activity WHERE {_CAPPED} AND activity_key IS NOT NULL
)
SELECT position, {_summary(True)}, '{_HISTORY_NOTE}' AS note FROM latest WHERE position <= 30""",
    "history_one_workload": f"""{_with(ACTIVITY)},
latest AS (
  SELECT *, row_number() OVER (ORDER BY created_on DESC, id DESC) AS position
  FROM activity WHERE {_CAPPED} AND activity_key = 'job7' AND activity_type = '1-URGENT'
)
SELECT position, {_summary(True)}, '{_HISTORY_NOTE}' AS note FROM latest WHERE position <= 30""",
    "activity_history": _stats(
        "application, activity_key", _CAPPED, 30, "activity_key", f"'{_HISTORY_NOTE}'", "string_agg(id, ',' ORDER BY created_on DESC, id DESC) AS run_ids,"
    ),
    "history_stats": _stats("application, activity_key", _YEAR, 30, "activity_key", "CAST(NULL AS VARCHAR)"),
    "history_stats_by_type": _stats("application, activity_type", _CAPPED, 200, "activity_type", f"'{_HISTORY_NOTE}'"),
    "bounded_query": f"""{_with(ACTIVITY)}
SELECT application, environment, status, count(*) AS runs, min(created_on) AS first_run, true AS truncated
FROM activity WHERE status IN ('failed', 'canceled', 'running') GROUP BY application, environment, status
ORDER BY runs DESC, application NULLS FIRST, environment, status LIMIT 20""",
    "statement_audit": _AUDIT,
    "id_time_audit": f"""{_with(ACTIVITY)}, timed AS (SELECT *, {_id_time("id")} AS t FROM activity)
SELECT application, count(*) AS runs, count(*) - count(t) AS undecodable,
  count(*) FILTER (NOT (created_on >= t - INTERVAL 2 DAY AND created_on < t + INTERVAL 2 DAY)) AS outside_bracket,
  max(abs({_ms("t", "created_on")})) AS max_drift_ms FROM timed GROUP BY application""",
    "page_manifest": f"""{_with(ACTIVITY)},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY created_on DESC, id DESC) - 1 AS i, count(*) OVER () AS n FROM activity
)
SELECT i // 100 + 1 AS page, count(*) AS row_count, {_iso("max(created_on)")} AS first_time_utc,
  {_iso("min(created_on)")} AS last_time_utc, arg_max(id, i) AS last_id,
  CASE WHEN max(i) < max(n) - 1 THEN {_cursor("min(created_on)", "arg_max(id, i)")} END AS next_cursor
FROM numbered GROUP BY i // 100""",
    "retention_coverage": f"""{_with(ACTIVITY)}, placed AS (
  SELECT id, application, coalesce(started_on, created_on) - INTERVAL 1 DAY AS lo,
    coalesce(completed_on, created_on) + INTERVAL 1 DAY AS hi FROM activity
)
SELECT id AS activity_id, application, {_iso("lo")} AS log_from_utc, {_iso("hi")} AS log_until_utc, {_note("hi")}
FROM placed""",
}
