"""DuckDB SQL that computes the facts of ``queries`` straight from the tables, without rendering or parsing lines."""

from __future__ import annotations

EVENTS = """ev AS (
  SELECT event_id AS id, user_id, event_type, epoch_us(ts) // 1000 AS full_ms, epoch_us(ts) // 1000000 * 1000 AS ms, epoch_us(ts) // 60000000 AS minute, floor(value * 1000)::BIGINT AS n,
         floor(value * 1000)::BIGINT * 0.001::DOUBLE AS took, CASE WHEN user_id % 17 <> 3 THEN floor(value * 1000)::BIGINT * 0.001::DOUBLE END AS lat, user_id % 13 AS part,
         CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'error' THEN 'GET' ELSE 'POST' END AS method,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 404 WHEN 'error' THEN 500 END AS status,
         CASE event_type WHEN 'view' THEN CASE WHEN event_id % 10 = 0 THEN 'TRACE' ELSE 'INFO' END WHEN 'click' THEN 'DEBUG' WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'WARN' WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'FATAL' ELSE 'ERROR' END END AS level,
         CASE WHEN event_id % 101 = 7 OR event_id < 3 THEN 'text' WHEN event_id % 211 = 5 THEN 'indent' WHEN event_id % 307 = 3 THEN 'blank' ELSE 'ok' END AS line
  FROM events),
rt AS (SELECT *, method || ' /u/:id/' || event_type || '/s' || part AS route FROM ev),
sk AS (SELECT route, ceil(ln(greatest(lat, 1e-6)) / ln(1.02::DOUBLE))::INT AS bucket, count(*) AS n, max(lat) AS top FROM rt WHERE lat IS NOT NULL GROUP BY ALL)"""

BURSTS = f"""{EVENTS},
evp AS (SELECT * FROM ev UNION ALL SELECT ev.* FROM ev, range(40) WHERE id % 997 = 0),
mc AS (SELECT minute, count(*) AS n, count(*) FILTER (status >= 500) AS errors FROM evp GROUP BY minute)"""


def traffic(value: str) -> str:
    """CTEs for the zero-filled series of ``mc`` and its statistics."""
    return f"""{BURSTS},
every AS (SELECT unnest(generate_series((SELECT min(minute) FROM mc), (SELECT max(minute) FROM mc))) AS minute),
filled AS (SELECT minute, COALESCE(mc.{value}, 0) AS v FROM every LEFT JOIN mc USING (minute)),
mid AS (SELECT median(v) AS median FROM filled),
st AS (
  SELECT (SELECT median FROM mid) AS median, median(round(abs(v - (SELECT median FROM mid)))) AS mad, max(v) AS peak,
         CASE WHEN max(v) > 0 THEN arg_min(minute, (-v, minute)) END AS peak_minute, count(*) AS minutes
  FROM filled)"""


def quantile(q: str, name: str) -> str:
    return f"arg_min(least(pow(1.02::DOUBLE, bucket) * 2 / 2.02::DOUBLE, most), bucket) FILTER (upto >= greatest(ceil({q}::DOUBLE * samples), 1)) AS {name}"


def quantiles(source: str, keys: str, columns: dict[str, str]) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    pick = ", ".join(quantile(q, name) for name, q in columns.items())
    return f"""w AS (SELECT *, sum(n) OVER ({by} ORDER BY bucket) AS upto, sum(n) OVER ({by}) AS samples, max(top) OVER ({by}) AS most FROM {source}),
q AS (SELECT {keys + ',' if keys else ''} max(samples)::BIGINT AS samples, max(most) AS top, {pick} FROM w {'GROUP BY ' + keys if keys else ''})"""


def spikes(value: str) -> str:
    return f"""WITH {traffic(value)}
SELECT minute, strftime(make_timestamp(minute * 60000000), '%Y-%m-%d %H:%M') AS minute_utc, v AS count, round(CASE WHEN median > 0 THEN v / median ELSE 0 END, 6) AS times_median
FROM filled, st WHERE v > median + 6 * greatest(1.4826 * mad, 1) AND v >= 2 * greatest(median, 1)"""


LABEL = "strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S')"
ORDER_STEPS = """o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, epoch_us(o_orderdate) // 1000000 * 1000 AS ms FROM orders),
s AS (SELECT *, lag(ms) OVER (ORDER BY line_no) AS prev FROM o)"""
EVENT_STEPS = f"""{EVENTS},
o AS (SELECT row_number() OVER (ORDER BY id) AS line_no, ms FROM ev),
s AS (SELECT *, lag(ms) OVER (ORDER BY line_no) AS prev FROM o)"""
STEP_TOTALS = """SELECT count(*) FILTER (ms < prev) AS out_of_order, count(*) FILTER (ms - prev > 300000) AS gaps,
  COALESCE(max(ms - prev) FILTER (ms - prev > 300000) / 1000.0::DOUBLE, 0) AS longest_gap_seconds FROM s"""

#: Lines of the application log: what each is, given whether any line before it parsed.
APP_LINES = f"{EVENTS}, al AS (SELECT *, CASE WHEN line = 'text' AND id < (SELECT min(id) FROM ev WHERE line = 'ok') THEN 'bad' WHEN line IN ('text', 'indent') THEN 'more' ELSE line END AS kind FROM ev)"
APP_ERRORS = f"{EVENTS}, er AS (SELECT 'user #: error of cart # step ' || chr(97 + part::INT) || ' took # ms' AS message, count(*) AS n FROM ev WHERE line = 'ok' AND level IN ('ERROR', 'FATAL') GROUP BY ALL)"

def report(fmt: str) -> str:
    """All fields of the report on the events, as (field, value)."""
    access = fmt == "access"
    minute = lambda x: f"strftime(make_timestamp({x} * 60000000), '%Y-%m-%d %H:%M')"
    second = lambda x: f"strftime(make_timestamp({x} * 1000), '%Y-%m-%d %H:%M:%S')"
    real = lambda x: f"printf('%.3f', {x}::DOUBLE)"
    if access:  # with bursts
        log = """lg AS (SELECT id * 64 + copy AS o, ms, minute, status >= 500 AS bad, status // 100 || 'xx' AS kind, user_id % 5000 AS bytes, lat, method || ' /u/:id/' || event_type || '/s' || part AS route, 'ok' AS line
  FROM (SELECT *, unnest(range(1, CASE WHEN id % 997 = 0 THEN 42 ELSE 2 END)) AS copy FROM ev))"""
    else:
        log = "lg AS (SELECT id AS o, full_ms AS ms, minute, level IN ('ERROR', 'FATAL') AS bad, level AS kind, 0 AS bytes, took AS lat, NULL AS route, line, id FROM ev)"
    text = "NULL" if access else "CASE line WHEN 'text' THEN 'plain text ' || id ELSE '    at frame ' || id END"
    ctes = [f"WITH {EVENTS}", log]
    ctes.append(f"""al AS (SELECT *, row_number() OVER (ORDER BY o) AS line_no, {text} AS text,
  CASE WHEN line = 'text' AND NOT COALESCE(bool_or(line = 'ok') OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'bad' WHEN line IN ('text', 'indent') THEN 'more' ELSE line END AS what FROM lg)""")
    ctes.append("ok AS (SELECT *, lag(ms) OVER (ORDER BY o) AS prev FROM al WHERE what = 'ok')")
    ctes.append("mc AS (SELECT minute, count(*) AS n, count(*) FILTER (bad) AS errors FROM ok GROUP BY minute)")
    ctes.append("every AS (SELECT unnest(generate_series((SELECT min(minute) FROM mc), (SELECT max(minute) FROM mc))) AS minute)")
    for value in ("n", "errors"):
        ctes.append(f"f_{value} AS (SELECT minute, COALESCE(mc.{value}, 0) AS v FROM every LEFT JOIN mc USING (minute))")
        ctes.append(f"m_{value} AS (SELECT median(v) AS median FROM f_{value})")
        ctes.append(f"s_{value} AS (SELECT (SELECT median FROM m_{value}) AS median, median(round(abs(v - (SELECT median FROM m_{value})))) AS mad, max(v) AS peak, arg_min(minute, (-v, minute)) AS peak_minute FROM f_{value})")
        ctes.append(f"""p_{value} AS (SELECT row_number() OVER (ORDER BY v DESC, minute) - 1 AS k, minute, v, CASE WHEN median > 0 THEN v / median ELSE 0 END AS times
  FROM f_{value}, s_{value} WHERE v > median + 6 * greatest(1.4826 * mad, 1) AND v >= 2 * greatest(median, 1) QUALIFY k < 5)""")
    ctes.append("sk2 AS (SELECT route, ceil(ln(greatest(lat, 1e-6)) / ln(1.02::DOUBLE))::INT AS bucket, count(*) AS n, max(lat) AS top FROM ok WHERE lat IS NOT NULL GROUP BY ALL)")
    ctes.append("sk1 AS (SELECT bucket, sum(n) AS n, max(top) AS top FROM sk2 GROUP BY bucket)")
    ctes.append(f"g AS (SELECT * FROM (WITH {quantiles('sk1', '', {'p50': '0.5', 'p95': '0.95', 'p99': '0.99', 'p999': '0.999'})} SELECT * FROM q))")
    ctes.append(f"rq AS (SELECT * FROM (WITH {quantiles('sk2', 'route', {'p95': '0.95', 'p99': '0.99'})} SELECT * FROM q))")
    ctes.append("rc AS (SELECT route, count(*) AS requests, count(*) FILTER (bad) AS errors FROM ok WHERE route IS NOT NULL GROUP BY route)")
    ctes.append("rl AS (SELECT *, row_number() OVER (ORDER BY p95 DESC, route) - 1 AS k FROM rc JOIN rq USING (route) WHERE samples >= 20 QUALIFY k < 5)")
    ctes.append("re AS (SELECT rc.*, p95, p99, row_number() OVER (ORDER BY errors DESC, rc.route) - 1 AS k FROM rc LEFT JOIN rq USING (route) WHERE errors > 0 QUALIFY k < 5)")
    ctes.append("ex AS (SELECT CASE WHEN ms < prev THEN 'out_of_order_examples' ELSE 'gap_examples' END AS tag, line_no, ms, prev, row_number() OVER (PARTITION BY ms < prev ORDER BY line_no) - 1 AS k FROM ok WHERE ms < prev OR ms - prev > 300000 QUALIFY k < 5)")
    ctes.append("tot AS (SELECT count(*) AS lines, count(*) FILTER (what = 'ok') AS parsed, count(*) FILTER (what = 'bad') AS bad, count(*) FILTER (what = 'more') AS more, sum(bytes) FILTER (what = 'ok') AS bytes FROM al)")
    one = {"format": f"'{fmt}'", "lines": "lines::VARCHAR", "parsed": "parsed::VARCHAR", "unparseable": "bad::VARCHAR", "continuation_lines": "more::VARCHAR", "bytes": "bytes::BIGINT::VARCHAR"}
    parts = [f"SELECT '{k}' AS field, {v} AS value FROM tot" for k, v in one.items()]
    span = {"first_utc": minute("min(minute)"), "last_utc": minute("max(minute)")}
    parts += [f"SELECT '{k}', {v} FROM mc" for k, v in span.items()]
    stats = {"median_per_minute": real("median"), "peak_per_minute": "peak::VARCHAR", "peak_minute_utc": minute("peak_minute")}
    parts += [f"SELECT '{k}', {v} FROM s_n" for k, v in stats.items()]
    order = {"out_of_order": "count(*) FILTER (ms < prev)::VARCHAR", "gaps": "count(*) FILTER (ms - prev > 300000)::VARCHAR", "longest_gap_seconds": real("COALESCE(max(ms - prev) FILTER (ms - prev > 300000), 0) / 1000.0")}
    parts += [f"SELECT '{k}', {v} FROM ok" for k, v in order.items()]
    lists = [(f"{name}_spikes", f"p_{v}", {"minute_utc": minute("minute"), "count": "v::VARCHAR", "times_median": real("times")}) for name, v in (("traffic", "n"), ("error", "errors"))]
    if access:
        routes = {"route": "route", "requests": "requests::VARCHAR", "errors": "errors::VARCHAR", "p95_ms": f"CASE WHEN p95 IS NOT NULL THEN {real('p95 * 1000')} END", "p99_ms": f"CASE WHEN p99 IS NOT NULL THEN {real('p99 * 1000')} END"}
        lists += [("slow_routes", "rl", routes), ("error_routes", "re", routes)]
    else:
        ctes.append("me AS (SELECT 'user #: error of cart # step ' || chr(97 + part::INT) || ' took # ms' AS message, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, message) - 1 AS k FROM ev WHERE line = 'ok' AND level IN ('ERROR', 'FATAL') GROUP BY message QUALIFY k < 5)")
        ctes.append("bl AS (SELECT line_no, text, row_number() OVER (ORDER BY line_no) - 1 AS k FROM al WHERE what = 'bad' QUALIFY k < 5)")
        lists += [("top_errors", "me", {"0": "message", "1": "n::VARCHAR"}), ("unparseable_examples", "bl", {"0": "line_no::VARCHAR", "1": "text"})]
    parts += [f"SELECT '{name}.' || k || '.{c}', {v} FROM {source}" for name, source, columns in lists for c, v in columns.items()]
    parts += [f"SELECT tag || '.' || k || '.{c}', {v} FROM ex" for c, v in {"line": "line_no::VARCHAR", "at_utc": second("ms"), "previous_utc": second("prev")}.items()]
    parts.append(f"SELECT '{'status_classes' if access else 'levels'}.' || kind, count(*)::VARCHAR FROM ok GROUP BY kind")
    parts += [f"SELECT 'latency.{c}', {v} FROM g" for c, v in {"samples": "samples::VARCHAR", **{f"{q}_ms": real(f"{q} * 1000") for q in ("p50", "p95", "p99", "p999")}, "max_ms": real("top * 1000")}.items()]
    return ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


ORACLES = {
    "access_parse": f"WITH {EVENTS} SELECT ms AS ts_ms, method, '/u/' || user_id || '/' || event_type || '/s' || part || '?k=' || id AS path, status, user_id % 5000 AS bytes, round(lat, 6) AS latency_s FROM ev",
    "app_parse": f"""WITH {EVENTS} SELECT full_ms AS ts_ms, level, 'user ' || user_id || ': ' || event_type || ' of cart ' || id % 50 || ' step ' || chr(97 + part::INT) || ' took ' || n || ' ms' AS message, round(took, 6) AS latency_s FROM ev WHERE line = 'ok'""",
    "detect_format": "SELECT * FROM (VALUES ('access', 'access'), ('app', 'app'), ('neither', NULL)) t(log, format)",
    "clf_time": """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 9 THEN NULL
  ELSE epoch_us(o_orderdate) // 1000000 * 1000 - 60000 * CASE o_orderkey % 10 WHEN 2 THEN 330 WHEN 3 THEN -210 WHEN 5 THEN 840 ELSE 0 END END AS ms FROM orders""",
    "iso_time": """SELECT o_orderkey, CASE WHEN k = 9 THEN NULL ELSE s - 60000 * CASE k WHEN 4 THEN 330 WHEN 5 THEN -210 WHEN 6 THEN -180 ELSE 0 END + CASE k WHEN 2 THEN 500 WHEN 3 THEN 123 WHEN 6 THEN 250 ELSE 0 END END AS ms,
  CASE k WHEN 0 THEN 19 WHEN 1 THEN 20 WHEN 2 THEN 22 WHEN 3 THEN 24 WHEN 4 THEN 25 WHEN 5 THEN 24 WHEN 6 THEN 25 WHEN 7 THEN 19 WHEN 8 THEN 19 WHEN 10 THEN 19 WHEN 11 THEN 20 END AS used
FROM (SELECT o_orderkey, o_orderkey % 12 AS k, epoch_us(o_orderdate) // 1000000 * 1000 AS s FROM orders)""",
    "utc_format": """SELECT o_orderkey, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS at_utc, floor(ms / 60000)::BIGINT AS minute, strftime(make_timestamp(floor(ms / 60000)::BIGINT * 60000000), '%Y-%m-%d %H:%M') AS minute_utc
FROM (SELECT o_orderkey, (o_orderkey - 700) * 86399977 AS ms FROM orders)""",
    "normalize_url": """SELECT page_id, array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-fA-F-]{8,}') THEN ':id' ELSE s END), '/') AS route
FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS p FROM pages)""",
    "normalize_message": """SELECT conv_id, turn, regexp_replace(left(text, 160), '[0-9]+', '#', 'g') AS key FROM (
  SELECT conv_id::VARCHAR AS conv_id, turn::BIGINT AS turn, text FROM conversations
  UNION ALL SELECT event_id::VARCHAR, -1, concat_ws(' ', props, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')) FROM events)""",
    "message_latency": f"""WITH {EVENTS} SELECT id, round(CASE id % 9 WHEN 0 THEN took WHEN 1 THEN took WHEN 3 THEN n::DOUBLE WHEN 5 THEN 7.0 WHEN 8 THEN n + 0.5::DOUBLE END, 6) AS seconds FROM ev""",
    "level_words": """SELECT CASE WHEN k IN (0, 1, 2) THEN 'TRACE' WHEN k IN (3, 4) THEN 'DEBUG' WHEN k IN (5, 6, 7) THEN 'INFO' WHEN k IN (8, 9, 10) THEN 'WARN' WHEN k IN (11, 12, 13) THEN 'ERROR' WHEN k < 18 THEN 'FATAL' ELSE '-' END AS level, count(*) AS n
FROM (SELECT event_id % 21 AS k FROM events) GROUP BY ALL""",
    "access_status_classes": f"WITH {EVENTS} SELECT status // 100 || 'xx' AS class, count(*) AS n FROM ev GROUP BY ALL",
    "status_shares": f"WITH {EVENTS} SELECT status // 100 || 'xx' AS class, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev), 2) AS percent FROM ev GROUP BY ALL",
    "access_bytes_total": "SELECT sum(user_id % 5000)::BIGINT AS bytes FROM events",
    "access_route_stats": f"WITH {EVENTS} SELECT route, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM rt GROUP BY route",
    "error_routes_top": f"WITH {EVENTS} SELECT route, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM rt GROUP BY route HAVING errors > 0 ORDER BY errors DESC, route LIMIT 3",
    "minute_counts": f"WITH {EVENTS} SELECT minute, count(*) AS n, count(*) FILTER (status >= 500) AS errors FROM ev GROUP BY minute",
    "minute_span": "SELECT strftime(min(ts), '%Y-%m-%d %H:%M') AS first_utc, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_utc FROM events",
    "app_levels": f"WITH {EVENTS} SELECT level, count(*) AS n FROM ev WHERE line = 'ok' GROUP BY level",
    "top_errors": f"WITH {APP_ERRORS} SELECT message, n FROM er ORDER BY n DESC, message LIMIT 10",
    "capped_errors": f"WITH {APP_ERRORS}, k AS (SELECT *, row_number() OVER (ORDER BY n DESC, message) AS k FROM er) SELECT CASE WHEN k <= 3 THEN message ELSE '(other)' END AS message, sum(n)::BIGINT AS n FROM k GROUP BY ALL",
    "line_counts": f"WITH {APP_LINES} SELECT count(*) AS lines, count(*) FILTER (kind = 'ok') AS parsed, count(*) FILTER (kind = 'bad') AS unparseable, count(*) FILTER (kind = 'more') AS continuation_lines FROM al",
    "access_line_counts": f"WITH {EVENTS} SELECT count(*) AS lines, 0::BIGINT AS parsed, count(*) FILTER (line <> 'blank') AS unparseable, 0::BIGINT AS continuation_lines FROM ev",
    "unparseable_examples": f"""WITH {EVENTS}, t AS (
  SELECT row_number() OVER (ORDER BY id) AS line_no, id, line, left(strftime(make_timestamp(full_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((full_ms % 1000)::VARCHAR, 3, '0') || 'Z [worker-' || id % 7 || '] '
    || CASE level WHEN 'TRACE' THEN '<trace>' WHEN 'FATAL' THEN 'panic' ELSE CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'DBG' WHEN 'purchase' THEN 'Notice' WHEN 'signup' THEN '[WARN]' ELSE 'ERROR:' END END
    || ' user ' || user_id || ': ' || event_type || ' of cart ' || id % 50 || ' step ' || chr(97 + part::INT) || ' took ' || n || ' ms', 120) AS good FROM ev)
SELECT line_no, CASE line WHEN 'text' THEN 'plain text ' || id WHEN 'indent' THEN '    at frame ' || id ELSE good END AS text FROM t WHERE line <> 'blank' ORDER BY line_no LIMIT 5""",
    "line_numbers": f"""WITH {EVENTS}, c AS (SELECT *, unnest(range(1, CASE WHEN id % 997 = 0 THEN 42 ELSE 2 END)) AS copy FROM ev)
SELECT row_number() OVER (ORDER BY id * 64 + copy) AS line_no, '10.0.0.1 - - [' || strftime(make_timestamp(ms * 1000), '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' /u/' || user_id || '/' || event_type || '/s' || part || '?k=' || (id * 64 + copy)
  || ' HTTP/1.1" ' || status || ' ' || user_id % 5000 || ' "-" "agent" ' || CASE WHEN lat IS NULL THEN '-' ELSE n::VARCHAR END AS value FROM c""",
    "latency_buckets": f"WITH {EVENTS} SELECT bucket, sum(n)::BIGINT AS n FROM sk GROUP BY bucket",
    "latency_quantiles": f"""WITH {EVENTS}, a AS (SELECT bucket, sum(n) AS n, max(top) AS top FROM sk GROUP BY bucket), {quantiles("a", "", {"p50": "0.5", "p95": "0.95", "p99": "0.99", "p999": "0.999"})}
SELECT samples, round(top, 6) AS top, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(p999, 6) AS p999 FROM q""",
    "route_quantiles": f"""WITH {EVENTS}, {quantiles("sk", "route", {"p95": "0.95", "p99": "0.99"})} SELECT route, samples, round(top, 6) AS top, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM q""",
    "slow_routes_top": f"""WITH {EVENTS}, {quantiles("sk", "route", {"p95": "0.95", "p99": "0.99"})},
r AS (SELECT route, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM rt GROUP BY route)
SELECT route, requests, errors, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM q JOIN r USING (route) WHERE samples >= 20 ORDER BY q.p95 DESC, route LIMIT 3""",
    "traffic_stats": f"WITH {traffic('n')} SELECT median, mad, peak, peak_minute, minutes FROM st",
    "error_traffic_stats": f"WITH {traffic('errors')} SELECT median, mad, peak, peak_minute, minutes FROM st",
    "traffic_spikes": spikes("n"),
    "error_spikes": spikes("errors"),
    "out_of_order_count": f"WITH {ORDER_STEPS} {STEP_TOTALS}",
    "out_of_order_examples": f"WITH {ORDER_STEPS} SELECT line_no, {LABEL} AS at_utc, {LABEL.replace('(ms', '(prev')} AS previous_utc FROM s WHERE ms < prev ORDER BY line_no LIMIT 5",
    "gap_count": f"WITH {EVENT_STEPS} {STEP_TOTALS}",
    "gap_examples": f"WITH {EVENT_STEPS} SELECT line_no, {LABEL} AS at_utc, {LABEL.replace('(ms', '(prev')} AS previous_utc FROM s WHERE ms - prev > 300000 ORDER BY line_no LIMIT 5",
    "summary_report": report("access"),
    "app_summary_report": report("app"),
}


ORACLES["top_errors_bounded"] = f"""WITH {EVENTS} SELECT CASE WHEN part < 2 THEN 'user #: error of cart # step ' || chr(97 + part::INT) || ' took # ms'
  ELSE 'user ' || user_id || ': ' || event_type || ' of cart ' || id % 50 || ' step ' || chr(97 + part::INT) || ' took ' || n || ' ms' END AS message, count(*) AS n
FROM ev WHERE line = 'ok' AND level IN ('ERROR', 'FATAL') GROUP BY message ORDER BY n DESC, message LIMIT 2"""
ORACLES["sql_routes"] = ORACLES["access_route_stats"]
ORACLES["sql_times"] = f"""WITH {EVENTS} SELECT strftime(make_timestamp(minute * 60000000), '%Y-%m-%d %H:%M') AS minute_utc, count(*) AS n
FROM (SELECT minute FROM ev WHERE line = 'ok' UNION ALL SELECT minute FROM ev) GROUP BY ALL"""
ORACLES["file_formats"] = """SELECT * FROM (VALUES ('access-00000.log', 'access'), ('access-00001.log', 'access'), ('jobs-00000.log', 'app'), ('jobs-00001.log', 'app'), ('names-00000.log', NULL), ('names-00001.log', NULL)) t(file, format)"""
ORACLES["mixed_reports"] = f"SELECT 'access.' || field AS field, value FROM ({report('access')}) UNION ALL SELECT 'app.' || field, value FROM ({report('app')})"
ORACLES["generated_log"] = """WITH g AS (SELECT o_orderkey * 20 + k AS i FROM orders, range(20) r(k)),
t AS (SELECT i, (i // 300000) * (270000 * 9 + 30000 + 420000) + i % 300000 * 9 - 8 * greatest(0, least(i % 300000, 150000) - 120000) - CASE WHEN i % 25013 = 25012 THEN 15000 ELSE 0 END AS ms FROM g WHERE i % 9973 <> 9972),
s AS (SELECT i, (1751500000000 + ms) // 1000 * 1000 AS ms FROM t), w AS (SELECT *, lag(ms) OVER (ORDER BY i) AS prev FROM s)
SELECT (SELECT count(*) FROM g) AS lines, count(*)::BIGINT AS parsed, (SELECT count(*) FROM g) - count(*)::BIGINT AS unparseable, 0::BIGINT AS continuation_lines, count(*) FILTER (ms < prev)::BIGINT AS out_of_order,
  count(*) FILTER (ms - prev > 300000)::BIGINT AS gaps, COALESCE(max(ms - prev) FILTER (ms - prev > 300000) / 1000.0::DOUBLE, 0) AS longest_gap_seconds FROM w"""
ORACLES["source_lines"] = f"""WITH {EVENTS}
SELECT row_number() OVER (ORDER BY id) AS line_no, '10.0.0.1 - - [' || strftime(make_timestamp(ms * 1000), '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' /u/' || user_id || '/' || event_type || '/s' || part || '?k=' || id
  || ' HTTP/1.1" ' || status || ' ' || user_id % 5000 || ' "-" "agent" ' || CASE WHEN lat IS NULL THEN '-' ELSE n::VARCHAR END || CASE WHEN id % 97 = 0 THEN chr(65533) || chr(65533) ELSE '' END AS value FROM ev"""
ORACLES["report_in_two_parts"] = ORACLES["summary_report"]
ORACLES |= {"stream_minutes": ORACLES["minute_counts"], "stream_buckets": ORACLES["latency_buckets"], "stream_order": ORACLES["out_of_order_count"]}
ORACLES["stream_silences"] = f"""WITH {EVENTS},
s AS (SELECT event_type, ms, lag(ms) OVER (PARTITION BY event_type ORDER BY full_ms, id) AS prev, max(ms) OVER () AS whole, last_value(ms) OVER (PARTITION BY event_type ORDER BY full_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM ev)
SELECT event_type AS source, count(*) FILTER (ms < prev) AS out_of_order, count(*) FILTER (ms - prev > 300000) AS gaps, COALESCE(max(ms - prev) FILTER (ms - prev > 300000), 0) AS longest_ms,
  CASE WHEN any_value(whole) - any_value(tail) >= 300000 THEN strftime(make_timestamp(any_value(tail) * 1000), '%Y-%m-%d %H:%M:%S') END AS silent_since_utc
FROM s GROUP BY event_type"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
