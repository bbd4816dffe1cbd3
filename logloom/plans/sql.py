"""DuckDB SQL for the queries that SQL can express, built from shared table expressions."""

from __future__ import annotations

from ..config import Config
from ..functions.scalar import TYPES
from ..sources.logs import EDGES, SERVICES
from . import fold_sql, judged_sql

ERROR = "(level IN ('ERROR', 'CRITICAL') OR coalesce(status_code >= 500, false))"


def _q(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def build(cfg: Config, day0: int, truth: list, entry: tuple, types: tuple, held_out: tuple, weights: dict, intercept: float) -> dict[str, str]:
    small, large = min(cfg.windows), max(cfg.windows)
    cte: dict[str, str] = {}
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SERVICES))
    cte["logs"] = f"""SELECT event_id AS id, CASE user_id % 6 {names} END AS service, epoch_us(ts) // 1000000 AS ts,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level, event_type || ' ' || props AS message,
        CASE WHEN event_type <> 'signup' THEN event_id END AS request_id,
        CASE WHEN event_type <> 'view' THEN regexp_extract(props, '"k": *([0-9]+)', 1) || '-' || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) END AS trace_id,
        CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS INTEGER) END AS latency_ms,
        CASE WHEN event_type <> 'error' THEN 200 WHEN value >= 20 THEN 500 ELSE 404 END AS status_code FROM events"""
    cte["sizes"] = f"SELECT CAST(unnest([{small}, {large}]) AS BIGINT) AS size"
    cte["pos"] = f"SELECT service, size, min(ts) - min(ts) % size AS first, (max(ts) - {cfg.grace}) - (max(ts) - {cfg.grace}) % size AS eff FROM logs, sizes GROUP BY service, size"
    cte["frame"] = "SELECT service, size, unnest(range(first, eff, size)) AS window_start FROM pos"
    cte["agg"] = f"""SELECT service, size, ts - ts % size AS window_start, count(request_id) AS rc, count(*) FILTER (WHERE {ERROR}) AS ec, count(DISTINCT message) AS um,
        list_sort(list(CAST(latency_ms AS DOUBLE)) FILTER (WHERE latency_ms IS NOT NULL)) AS lat FROM logs, sizes GROUP BY 1, 2, 3"""

    def pct(q: float) -> str:
        p = f"((len(lat) - 1) * CAST({q} AS DOUBLE))"
        low = f"CAST(floor({p}) AS BIGINT)"
        x, y, t = f"lat[{low} + 1]", f"lat[least({low} + 1, len(lat) - 1) + 1]", f"({p} - floor({p}))"
        return f"CAST(trunc(CASE WHEN {t} >= 0.5 THEN {y} - ({y} - {x}) * (1 - {t}) ELSE {x} + ({y} - {x}) * {t} END) AS BIGINT)"

    cte["w"] = f"""SELECT f.service, f.size, f.window_start, coalesce(rc, 0) AS request_count, coalesce(ec, 0) AS error_count, coalesce(um, 0) AS unique_messages,
        CASE WHEN rc > 0 THEN CAST(ec AS DOUBLE) / rc END AS exact_rate, {pct(0.5)} AS p50_latency_ms, {pct(0.95)} AS p95_latency_ms
        FROM frame f LEFT JOIN agg a ON f.service = a.service AND f.size = a.size AND f.window_start = a.window_start"""
    source = {"request_count": "request_count", "error_rate": "exact_rate", "p95_latency_ms": "p95_latency_ms"}
    cols = ", ".join(f"CASE WHEN count(*) OVER p >= {cfg.min_history} THEN median(CAST({source[m]} AS DOUBLE)) OVER p END AS {m}_median, CASE WHEN count(*) OVER p >= {cfg.min_history} AND mad(CAST({source[m]} AS DOUBLE)) OVER p IS NOT NULL THEN greatest(mad(CAST({source[m]} AS DOUBLE)) OVER p, CAST({f} AS DOUBLE)) END AS {m}_mad" for m, f in cfg.floors)
    cte["b"] = f"SELECT *, round(exact_rate, 4) AS error_rate, {cols} FROM w WINDOW p AS (PARTITION BY service, size ORDER BY window_start ROWS BETWEEN {cfg.baseline_windows} PRECEDING AND 1 PRECEDING)"
    parts = " UNION ALL ".join(f"SELECT service, '{m}' AS metric, window_start, size, CAST({m} AS DOUBLE) AS observed, {m}_median AS baseline, CAST(0.6745 AS DOUBLE) * (CAST({m} AS DOUBLE) - {m}_median) / {m}_mad AS z FROM b WHERE {m}_mad <> 0" for m, _ in cfg.floors)
    kinds = " ".join(f"WHEN metric = '{m}' AND sign(z) = {s} THEN '{n}'" for (m, s), n in TYPES.items())
    cte["an"] = f"""SELECT service || '|' || metric || '|' || lpad(CAST(window_start AS VARCHAR), 12, '0') || '|' || lpad(CAST(size AS VARCHAR), 6, '0') || '|mad' AS id, service, metric, window_start, size, 'mad' AS detector,
        round_even(z, 4) AS score, observed, baseline, CASE WHEN abs(z) >= 6 THEN 'CRITICAL' WHEN abs(z) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE {kinds} ELSE metric || '_anomaly' END AS anomaly_type
        FROM ({parts}) WHERE z >= {cfg.threshold} OR (metric = 'request_count' AND z <= -{cfg.threshold})"""
    cte["ord"] = "SELECT *, row_number() OVER (PARTITION BY service, anomaly_type ORDER BY window_start, id) AS rn FROM an"
    hit = f"(f.e >= o.window_start - {cfg.debounce} AND f.s <= o.window_start + {cfg.debounce} AND o.window_start + o.size <= f.s + {cfg.alert_max})"
    cte["fold"] = f"""SELECT service, anomaly_type, rn, window_start AS s, window_start + size AS e, 1 AS grp FROM ord WHERE rn = 1
        UNION ALL SELECT o.service, o.anomaly_type, o.rn, CASE WHEN {hit} THEN f.s ELSE o.window_start END, CASE WHEN {hit} THEN greatest(f.e, o.window_start + o.size) ELSE o.window_start + o.size END, f.grp + CASE WHEN {hit} THEN 0 ELSE 1 END
        FROM fold f JOIN ord o ON o.service = f.service AND o.anomaly_type = f.anomaly_type AND o.rn = f.rn + 1"""
    rank = "CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 ELSE 0 END"
    cte["al"] = f"""SELECT 'A|' || arg_min(o.id, o.rn) AS alert_id, o.service, o.anomaly_type, min(f.s) AS start, max(f.e) AS "end", CASE max({rank}) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        arg_min(o.observed, o.rn) AS observed, arg_min(o.baseline, o.rn) AS baseline, string_agg(o.id, ',' ORDER BY o.rn) AS anomaly_ids
        FROM ord o JOIN fold f ON o.service = f.service AND o.anomaly_type = f.anomaly_type AND o.rn = f.rn GROUP BY o.service, o.anomaly_type, f.grp"""
    cte["edges"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") AS t(upstream, downstream)"
    cte["services"] = "SELECT * FROM (VALUES " + ", ".join(f"('s{i}', '{n}')" for i, n in enumerate(SERVICES)) + ") AS t(id, name)"
    cte["reach"] = "SELECT upstream, downstream AS reached FROM edges UNION SELECT r.upstream, e.downstream FROM reach r JOIN edges e ON r.reached = e.upstream"
    cte["truth"] = "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{r}', [{_q(a)}], {day0 + s * 3600}, {day0 + e * 3600}, '{types[0] if r in entry else types[1]}')" for i, r, a, s, e in truth) + ") AS t(truth_id, root, affected, start_time, end_time, type)"
    cte["calls"] = "SELECT up, service AS down, count(*) AS c FROM (SELECT *, lag(service) OVER (PARTITION BY trace_id, ts // 3600 ORDER BY ts, id) AS up FROM logs WHERE trace_id IS NOT NULL) WHERE up <> service GROUP BY ALL"
    cte["seen"] = "SELECT a.up AS upstream, a.down AS downstream FROM calls a LEFT JOIN calls b ON a.up = b.down AND a.down = b.up WHERE a.c > coalesce(b.c, 0) OR (a.c = b.c AND a.up < a.down)"
    cte["sreach"] = "SELECT upstream, downstream AS reached FROM seen UNION SELECT r.upstream, e.downstream FROM sreach r JOIN seen e ON r.reached = e.upstream"
    cte["svc"] = "SELECT * FROM services WHERE name IN (SELECT service FROM logs)"
    cte["lw"] = f"""SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE list_contains(t.affected, b.service) AND b.window_start < t.end_time AND b.window_start + b.size > t.start_time) THEN 1 ELSE 0 END AS label,
        CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.service = b.service AND an.size = b.size AND an.window_start = b.window_start) THEN 1 ELSE 0 END AS flag FROM b WHERE size = {large}"""
    cte["sc"] = "SELECT an.*, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE list_contains(t.affected, an.service) AND an.window_start < t.end_time AND an.window_start + an.size > t.start_time) THEN 1 ELSE 0 END AS label FROM an"

    near = lambda pad: f"""b.start <= a."end" + {pad} AND b."end" >= a.start - {pad} AND (a.start, a.alert_id) < (b.start, b.alert_id)"""
    cte |= fold_sql.ctes(cfg, near)

    def using(body: str, *, until: str) -> str:
        out = []
        for name, text in cte.items():
            out.append(f"{name} AS ({text})")
            if name == until:
                break
        return "WITH RECURSIVE " + ",\n".join(out) + "\n" + body

    W = "service, size, window_start, request_count, error_count, error_rate, p50_latency_ms, p95_latency_ms, unique_messages"

    def curve(by: str) -> str:
        return f"""SELECT d AS detector, i AS place, round(hits / i, 4) AS precision, CASE WHEN positives > 0 THEN round(hits / positives, 4) ELSE 0 END AS recall FROM (
            SELECT {by} AS d, row_number() OVER w AS i, CAST(sum(label) OVER (PARTITION BY {by} ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS hits, count(*) OVER (PARTITION BY {by}) AS n, CAST(sum(label) OVER (PARTITION BY {by}) AS DOUBLE) AS positives
            FROM sc WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, id)) WHERE (i - 1) % greatest(1, n // 100) = 0"""

    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / ({b}), 4) ELSE 0 END"
    now = day0 + 29 * 86400
    return {
        "logs_filter_page": using("SELECT * FROM logs WHERE service = 'payment-service' AND level = 'ERROR' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 10", until="logs"),
        "logs_time_range": using(f"SELECT * FROM logs WHERE ts BETWEEN {day0 + 86400} AND {day0 + 2 * 86400}", until="logs"),
        "logs_by_trace": using(f"SELECT * FROM logs WHERE trace_id = '7-{day0 // 86400 + 3}' ORDER BY ts, id", until="logs"),
        "log_counts": using(f"SELECT count(*) AS total, count(*) FILTER (WHERE {ERROR}) AS errors, count(*) FILTER (WHERE ts > {now - 18000} AND ts <= {now}) AS recent, round(count(*) FILTER (WHERE ts > {now - 18000} AND ts <= {now}) / 300, 2) AS per_minute FROM logs", until="logs"),
        "logs_validate": using("""SELECT problems, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN id % 50 = 0 THEN 'service' END, CASE WHEN id % 70 = 0 OR id % 80 = 0 THEN 'level' END, CASE WHEN id % 60 = 0 THEN 'message' END, CASE WHEN id % 90 = 0 THEN 'request_id' END,
            CASE WHEN id % 110 = 0 AND trace_id IS NOT NULL THEN 'trace_id' END, CASE WHEN latency_ms < 5 THEN 'latency_ms' END) AS problems FROM logs) GROUP BY 1""", until="logs"),
        "logs_jsonl": using("""SELECT CASE WHEN id % 200 <> 0 THEN service END AS service, CASE WHEN id % 200 <> 0 THEN level END AS level, CASE WHEN id % 200 = 0 THEN 'timestamp,service,level,message' WHEN latency_ms < 0 THEN 'latency_ms' ELSE '' END AS problems, count(*) AS n
            FROM logs GROUP BY 1, 2, 3""", until="logs"),
        "logs_import": using("SELECT s.id AS service_id, CASE WHEN level = 'DEBUG' THEN 'INFO' ELSE level END AS level, count(*) AS n, CAST(0 AS BIGINT) AS with_metadata FROM logs JOIN services s ON s.name = service WHERE service <> 'auth-service' GROUP BY 1, 2", until="services"),
        "trace_spans": using(f"SELECT trace_id, min(ts) AS first, max(ts) AS last, count(DISTINCT service) AS services, count(*) FILTER (WHERE {ERROR}) AS errors FROM logs WHERE trace_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT service) > 1", until="logs"),
        "metric_windows_short": using(f"SELECT {W} FROM b WHERE size = {small}", until="b"),
        "metric_windows_long": using(f"SELECT {W}, window_start + size + {cfg.grace} AS closed_at FROM b WHERE size = {large}", until="b"),
        "metric_windows_observed": using("SELECT a.service, a.size, a.window_start, rc AS request_count, um AS unique_messages FROM agg a JOIN pos p ON a.service = p.service AND a.size = p.size WHERE a.window_start + a.size <= p.eff", until="agg"),
        "watermark_positions": using("SELECT service, size, eff - size AS last_closed_window_start, (eff - first) // size AS windows FROM pos", until="pos"),
        "late_logs": using(f"SELECT service, count(*) AS late FROM (SELECT *, max(ts) OVER (PARTITION BY service ORDER BY id + CASE WHEN id % 97 = 0 THEN 400 ELSE 0 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM logs) WHERE ts - ts % {small} + {small} <= seen - {cfg.grace} GROUP BY 1", until="logs"),
        "windows_resumed": using(f"SELECT {W} FROM b", until="b"),
        "anomalies_page": using(f"SELECT id, service, metric, window_start, size, score, severity, anomaly_type FROM an WHERE metric = 'request_count' AND severity = 'HIGH' AND window_start BETWEEN {day0} AND {now} ORDER BY window_start DESC, id LIMIT 40 OFFSET 5", until="an"),
        "alerts_page": using("""SELECT alert_id, service, anomaly_type, start, "end", severity FROM al WHERE service = 'checkout-service' ORDER BY start DESC, alert_id LIMIT 60""", until="al"),
        "stream_windows_append": using(f"""SELECT service, ts - ts % {small} AS window_start, CAST({small} AS BIGINT) AS size, count(request_id) AS request_count, count(*) FILTER (WHERE {ERROR}) AS error_count FROM logs
            GROUP BY 1, 2 HAVING CAST(1000000 AS BIGINT) * (ts - ts % {small} + {small}) <= (SELECT max(epoch_us(ts)) FROM events) - CAST(1000000 AS BIGINT) * {cfg.grace}""", until="logs"),
        "baselines_median_mad": using("SELECT service, size, window_start, " + ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for m, _ in cfg.floors for k in ("median", "mad")) + " FROM b", until="b"),
        "mad_anomalies": using("SELECT id, service, metric, window_start, size, detector, score, round(observed, 6) AS observed, round(baseline, 6) AS baseline, severity, anomaly_type FROM an", until="an"),
        "anomaly_counts": using(f"SELECT anomaly_type, severity, count(*) AS n, CAST(max({rank}) AS BIGINT) AS rank FROM an GROUP BY 1, 2", until="an"),
        "normal_windows": using(f"SELECT service, count(*) AS n, CAST(sum(request_count) AS BIGINT) AS requests FROM b WHERE size = {large} AND NOT EXISTS (SELECT 1 FROM truth WHERE window_start < end_time AND window_start + size > start_time) GROUP BY 1", until="truth"),
        "upsert_windows": using(f"""SELECT service, run, first_run, count(*) AS n, CAST(sum(request_count) AS BIGINT) AS requests FROM (
            SELECT coalesce(n.service, o.service) AS service, CASE WHEN n.service IS NULL THEN 1 ELSE 2 END AS run, CASE WHEN o.service IS NULL THEN 2 ELSE 1 END AS first_run, coalesce(n.c, o.c) AS request_count
            FROM (SELECT * FROM old_rows) o FULL JOIN (SELECT * FROM new_rows WHERE window_start >= {day0 + 5 * 86400}) n ON o.service = n.service AND o.window_start = n.window_start) GROUP BY 1, 2, 3""", until="logs").replace("\nSELECT service, run", "".join(f""",
            p{k} AS (SELECT service, min(ts) - min(ts) % {large} AS first, (max(ts) - {cfg.grace}) - (max(ts) - {cfg.grace}) % {large} AS eff FROM logs WHERE ts < {day0 + day * 86400} GROUP BY 1),
            f{k} AS (SELECT service, unnest(range(first, eff, {large})) AS window_start FROM p{k}),
            {name} AS (SELECT f.service, f.window_start, count(l.request_id) AS c FROM f{k} f LEFT JOIN logs l ON l.service = f.service AND l.ts >= f.window_start AND l.ts < f.window_start + {large} AND l.ts < {day0 + day * 86400} GROUP BY 1, 2)""" for k, day, name in ((1, 10, "old_rows"), (2, 20, "new_rows"))) + "\nSELECT service, run"),
        "alerts_debounced": using('SELECT alert_id, service, anomaly_type, start, "end", severity, round(observed, 6) AS observed, round(baseline, 6) AS baseline, anomaly_ids FROM al', until="al"),
        "dedup_edges_same_service": using(f"SELECT a.alert_id AS a, b.alert_id AS b FROM al a JOIN al b ON a.service = b.service AND a.anomaly_type = b.anomaly_type AND {near(cfg.dedup_same)}", until="al"),
        "dedup_edges_shared_trace": using(f"""SELECT DISTINCT a.alert_id AS a, b.alert_id AS b FROM tr a JOIN tr b ON a.trace_id = b.trace_id AND a.service <> b.service AND {near(cfg.dedup_trace)}""", until="al").replace("\nSELECT DISTINCT a.alert_id", """,
            tr AS (SELECT DISTINCT al.alert_id, al.service, al.start, al."end", l.trace_id FROM al JOIN logs l ON l.service = al.service AND l.trace_id IS NOT NULL AND l.ts BETWEEN al.start AND al."end")
            SELECT DISTINCT a.alert_id"""),
        "dependencies_named": using("SELECT u.id AS upstream_id, d.id AS downstream_id, upstream, downstream FROM seen JOIN svc u ON u.name = upstream JOIN svc d ON d.name = downstream", until="svc"),
        "graph_closure": using("SELECT DISTINCT upstream, reached FROM sreach WHERE upstream <> reached", until="sreach"),
        "blast_radius": using("SELECT name AS service, (SELECT count(DISTINCT reached) FROM sreach WHERE upstream = name AND reached <> name) AS blast_radius FROM svc", until="svc"),
        "affected_callers": using("SELECT DISTINCT reached AS root, upstream AS affected FROM sreach WHERE upstream <> reached UNION SELECT name, name FROM svc", until="svc"),
        "truth_window_labels": using("SELECT service, label, flag, count(*) AS n FROM lw GROUP BY 1, 2, 3", until="lw"),
        "confusion_matrix": using(f"""SELECT tp, fp, fn, tn, {ratio('tp', 'tp + fn')} AS recall, {ratio('fp', 'fp + tn')} AS fpr, {ratio('tp', 'tp + fp')} AS precision, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
            SELECT count(*) FILTER (WHERE label = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE label = 0 AND flag = 1) AS fp, count(*) FILTER (WHERE label = 1 AND flag = 0) AS fn, count(*) FILTER (WHERE label = 0 AND flag = 0) AS tn FROM lw)""", until="lw"),
        "pr_curve": using(curve("detector"), until="sc"),
        "pr_interpolated": using(f"""SELECT g.detector, g.recall, round(a.precision + CASE WHEN b.recall > a.recall THEN (g.recall - a.recall) / (b.recall - a.recall) ELSE 0 END * (b.precision - a.precision), 4) AS precision FROM (
            SELECT d.detector, r.recall, coalesce((SELECT max(recall) FROM c WHERE c.detector = d.detector AND c.recall <= r.recall), (SELECT min(recall) FROM c WHERE c.detector = d.detector)) AS lo, coalesce((SELECT min(recall) FROM c WHERE c.detector = d.detector AND c.recall >= r.recall), (SELECT max(recall) FROM c WHERE c.detector = d.detector)) AS hi
            FROM (SELECT DISTINCT detector FROM c) d, (SELECT DISTINCT recall FROM c) r) g JOIN c a ON a.detector = g.detector AND a.recall = g.lo JOIN c b ON b.detector = g.detector AND b.recall = g.hi""", until="sc").replace("\nSELECT g.detector", f",\nc AS (SELECT detector, recall, max(precision) AS precision FROM ({curve('metric')}) GROUP BY 1, 2)\nSELECT g.detector"),
        "overview_metrics": using(f"""SELECT *, CASE WHEN last_day > 0 THEN round(100 * last_day_errors / last_day, 1) ELSE 0 END AS error_percent FROM (SELECT count(*) AS total_logs, count(*) FILTER (WHERE ts > {now - 86400} AND ts <= {now}) AS last_day,
            count(*) FILTER (WHERE ts > {now - 86400} AND ts <= {now} AND {ERROR}) AS last_day_errors, count(DISTINCT service) AS services FROM logs)""", until="logs"),
        "service_health": using(f"SELECT {W} FROM b WHERE service = 'payment-service' AND size = {small} AND window_start BETWEEN {day0 + 86400} AND {day0 + 8 * 86400} ORDER BY window_start LIMIT 200", until="b"),
        "service_status": using(f"""SELECT service, max(window_start) AS window_start, arg_max(coalesce(error_rate, 0), window_start) * 100 AS error_percent, arg_max(coalesce(coalesce(error_rate, 0) * 100 >= 5 OR p95_latency_ms >= 500, coalesce(error_rate, 0) * 100 >= 5), window_start) AS degraded FROM b WHERE size = {large} GROUP BY 1""", until="b"),
        "ingest_rate_limited": using("SELECT ts - ts % 3600 AS window_start, left(sha256(service), 24) AS identity_hash, count(*) AS requests FROM logs GROUP BY 1, 2 HAVING count(*) > 5", until="logs"),
        "latency_summary": using("SELECT service, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99, round(avg(latency_ms), 4) AS mean, min(latency_ms) AS least, max(latency_ms) AS most FROM logs WHERE latency_ms IS NOT NULL GROUP BY 1", until="logs"),
        "truth_import": using("""SELECT 'w-' || r.service AS truth_incident_id, k.id AS root_id, strftime(make_timestamp(r.half * 43200 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS start_time, strftime(make_timestamp((r.half + 1) * 43200 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS end_time,
            (SELECT string_agg(s.id, ',' ORDER BY s.id) FROM services s WHERE s.name IN (SELECT service FROM e WHERE e.half = r.half)) AS affected_ids
            FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n DESC, half) AS k FROM e) r JOIN services k ON k.name = r.service WHERE r.k = 1 AND r.service NOT IN ('api-gateway', 'auth-service')""", until="truth").replace("\nSELECT 'w-'", f""", e AS (SELECT service, ts // 43200 AS half, count(*) AS n FROM logs WHERE {ERROR} GROUP BY 1, 2)\nSELECT 'w-'"""),
    } | fold_sql.queries(cfg, using, day0 + 31 * 86400) | judged_sql.queries(cfg, using, ratio, now, held_out, weights, intercept)
