"""SQL of what is judged against labels: ranked root causes, accuracy, intervals and the gate; and of reconciled duplicates and the whole overview."""

from __future__ import annotations

import math

from ..config import Config
from ..operators.evaluate import CONTRACT, GATE_LEAST, GATE_MOST
from ..operators.rootcause import FEATURES

PLACE = "CAST('0x' || left(md5(duplicate), 8) AS BIGINT) % 10"


def queries(cfg: Config, using, ratio, now: int, held_out: tuple, weights: dict, intercept: float) -> dict[str, str]:
    split = f"CASE WHEN truth_id IN ({', '.join(repr(t) for t in held_out)}) THEN 'held out' ELSE 'training' END"
    features = """SELECT p.incident_id, p.service, CASE WHEN p.service = first THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_earliest,
        CASE WHEN p.service = first THEN CAST(coalesce(greatest(0, (SELECT min(o.own_start) FROM per o WHERE o.incident_id = p.incident_id AND o.service <> p.service) - first_start), 0) AS DOUBLE) ELSE 0.0::DOUBLE END AS earliest_seconds_gap,
        (SELECT CAST(count(DISTINCT reached) AS DOUBLE) FROM reach WHERE upstream = p.service AND reached <> upstream) AS blast_radius,
        (SELECT CAST(count(DISTINCT o.service) AS DOUBLE) FROM per o JOIN reach r ON r.reached = o.service WHERE o.incident_id = p.incident_id AND r.upstream = p.service AND o.service <> p.service) AS upstream_position,
        coalesce((SELECT max(abs(an.score)) FROM an JOIN (SELECT unnest(string_split(anomaly_ids, ',')) AS id, incident_id, service FROM mal) x USING (id) WHERE x.incident_id = p.incident_id AND x.service = p.service), 0) AS anomaly_magnitude,
        p.alert_count FROM per p JOIN earliest USING (incident_id)"""

    def ranked(rows: str, without: str | None = None) -> str:
        own = {n: w for n, w in sorted(weights.items()) if n != without}
        z = f"CAST({intercept} AS DOUBLE)" + "".join(f" + CAST({w} AS DOUBLE) * {n}" for n, w in own.items())
        parts = ", ".join(f"{{'v': -abs(round(CAST({w} AS DOUBLE) * {n}, 6)), 'k': '{n}'}}" for n, w in own.items())
        return f"""SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS rank FROM (
            SELECT *, 1 / (1 + exp(-({z}))) AS score, array_to_string(list_transform(list_sort([{parts}])[1:3], lambda x: replace(x.k, '_', ' ')), ', ') AS top_features FROM ({rows}))"""

    known = f"SELECT f.*, t.truth_id, t.type, f.service = t.root AS is_cause, {split} AS split FROM ({features}) f JOIN mt ON mt.i = f.incident_id JOIN truth t ON t.truth_id = mt.t"
    held = lambda by, rows: f"""SELECT {by} AS which, count(*) AS n, round(avg(t1), 4) AS top1, round(avg(t3), 4) AS top3 FROM (
        SELECT incident_id, {by}, max(CASE WHEN is_cause AND rank <= 1 THEN 1 ELSE 0 END) AS t1, max(CASE WHEN is_cause AND rank <= 3 THEN 1 ELSE 0 END) AS t3 FROM ({rows}) GROUP BY ALL) GROUP BY 1"""  # noqa: E731
    told = f"SELECT incident_id, service, round(score, 6) AS score, rank, top_features FROM ({ranked(features)})"
    variants = " UNION ALL ".join(f"SELECT '{n or 'none'}' AS dropped, n, top1, top3 FROM ({held('1', ranked(known, n))})" for n in (None, *FEATURES))
    ends = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
    weight = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in ends)
    interval = f"""SELECT service, n, mean, round(quantile_cont(s / w, 0.025), 6) AS low, round(quantile_cont(s / w, 0.975), 6) AS high FROM (
        SELECT service, b, CAST(sum(w * flag) AS DOUBLE) AS s, sum(w) AS w FROM (SELECT service, b, flag, {weight} AS w FROM (
        SELECT service, flag, b, CAST('0x' || left(md5(b || ':' || service || '|' || size || '|' || window_start), 8) AS BIGINT) AS u FROM lw, range(1000) AS r(b) WHERE label = 1)) GROUP BY 1, 2 HAVING sum(w) > 0)
        JOIN (SELECT service, count(*) AS n, round(avg(flag), 6) AS mean FROM lw WHERE label = 1 GROUP BY 1) USING (service) GROUP BY ALL"""
    matrix = f"""SELECT {ratio('tp', 'tp + fn')} AS recall, {ratio('fp', 'fp + tn')} AS fpr, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fp AS flags, tp + fp + fn + tn AS windows FROM (
        SELECT count(*) FILTER (WHERE label = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE label = 0 AND flag = 1) AS fp, count(*) FILTER (WHERE label = 1 AND flag = 0) AS fn, count(*) FILTER (WHERE label = 0 AND flag = 0) AS tn FROM lw)"""
    by_split = held("split", ranked(known))
    percent = "SELECT CASE WHEN count(*) > 0 THEN round(CAST(100 * count(*) FILTER (WHERE i <> c) AS DOUBLE) / count(*), 1) END FROM place"
    figures = " UNION ALL ".join([
        *(f"SELECT '{n}' AS name, CAST({c} AS DOUBLE) AS value FROM ({matrix})" for n, c in (("mad_recall", "recall"), ("mad_fpr", "fpr"), ("mad_f1", "f1"), ("mad_anomalies", "flags"), ("windows", "windows"))),
        f"SELECT 'compression', ({percent}) / 100", "SELECT 'truths', CAST(count(*) AS DOUBLE) FROM truth", f"SELECT 'training_n', CAST(n AS DOUBLE) FROM ({by_split}) WHERE which = 'training'",
        *(f"SELECT 'held_out_{c}', CAST({c} AS DOUBLE) FROM ({by_split}) WHERE which = 'held out'" for c in ("n", "top1", "top3")),
    ])
    bounds = [(n, "at least", b) for n, b in (GATE_LEAST | CONTRACT).items()] + [(n, "at most", b) for n, b in GATE_MOST.items()]
    listed = ", ".join(f"('{n}', '{s}', CAST({b} AS DOUBLE))" for n, s, b in bounds)
    gate = f"""SELECT b.*, value, coalesce(CASE WHEN side = 'at least' THEN value >= bound ELSE value <= bound END, false) AS ok FROM (VALUES {listed}) AS b(name, side, bound) LEFT JOIN ({figures}) USING (name)"""
    last = lambda minutes: f"ts >= {now - minutes * 3600} AND ts <= {now}"
    return {
        "rca_features": using(features, until="earliest"),
        "rca_rank": using(told, until="earliest"),
        "rca_top3": using(told + " WHERE rank <= 3", until="earliest"),
        "rca_accuracy": using(f"SELECT 'split' AS by, * FROM ({by_split}) UNION ALL SELECT 'type', * FROM ({held('type', ranked(known))})", until="mt"),
        "rca_ablation": using(variants, until="mt"),
        "recall_interval": using(interval, until="lw"),
        "quality_gate": using(gate, until="mt"),
        "dedup_reconciled": using(f"""SELECT CAST(1 AS BIGINT) AS run, count(*) FILTER (WHERE p = 0) AS inserted, count(*) FILTER (WHERE p = 1) AS updated, count(*) FILTER (WHERE p > 1) AS kept, count(*) FILTER (WHERE p = 2) AS deleted FROM (SELECT {PLACE} AS p FROM pairs)
            UNION ALL SELECT 2, 0, 0, count(*), 0 FROM pairs""", until="pairs"),
        "overview_full": using(f"""SELECT count(*) AS total_logs, round(count(*) FILTER (WHERE {last(5)}) / 5, 1) AS recent_events_per_min, count(*) FILTER (WHERE {last(15)}) AS queue_depth, count(*) FILTER (WHERE {last(15)} AND level IN ('ERROR', 'CRITICAL')) AS recent_errors,
            count(DISTINCT service) AS total_services, (SELECT count(*) FROM inc WHERE start <= {now} AND NOT "end" < {now - cfg.close_gap}) AS active_incidents FROM logs""", until="inc"),
    }
