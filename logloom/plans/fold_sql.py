"""SQL of the ordered folds, as reductions of lists: duplicates of alerts, incidents, and what is read from them.

The engine folds components and stretches apart; here one reduction goes over all rows in their order, so the two share no cut.
"""

from __future__ import annotations

from ..config import Config

SPAN = """CASE WHEN s.label[e.a] <> s.label[e.b] AND greatest(s.high[s.label[e.a]], s.high[s.label[e.b]]) - least(s.low[s.label[e.a]], s.low[s.label[e.b]]) <= {span}"""


SPANS = 'greatest(0, least(i."end", t.end_time) - greatest(i.start, t.start_time))'


def ctes(cfg: Config, near) -> dict[str, str]:
    """Table expressions over al, logs, edges, truth, reach and an; near(pad) is the condition that alerts a and b come within pad."""
    out = {}
    out["tr"] = """SELECT DISTINCT al.alert_id, al.service, al.start, al."end", l.trace_id FROM al JOIN logs l ON l.service = al.service AND l.trace_id IS NOT NULL AND l.ts BETWEEN al.start AND al."end" """
    out["cand"] = f"""SELECT 0 AS rule, a.alert_id AS a, b.alert_id AS b FROM al a JOIN al b ON a.service = b.service AND a.anomaly_type = b.anomaly_type AND {near(cfg.dedup_same)}
        UNION ALL SELECT DISTINCT 1, a.alert_id, b.alert_id FROM tr a JOIN tr b ON a.trace_id = b.trace_id AND a.service <> b.service AND {near(cfg.dedup_trace)}"""
    out["seq"] = "SELECT *, row_number() OVER (ORDER BY start, alert_id) AS i FROM al"
    # An edge joins the labels of its ends where their joint span allows it; label x keeps the first, with the joint low and high.
    joined = SPAN.format(span=cfg.dedup_span)
    step = f"""{{'label': list_transform(s.label, lambda x: {joined} AND x = s.label[e.b] THEN s.label[e.a] ELSE x END),
        'low': list_transform(s.low, lambda x, k: {joined} AND k = s.label[e.a] THEN least(x, s.low[s.label[e.b]]) ELSE x END),
        'high': list_transform(s.high, lambda x, k: {joined} AND k = s.label[e.a] THEN greatest(x, s.high[s.label[e.b]]) ELSE x END), 'a': e.a, 'b': e.b}}"""
    out["links"] = """SELECT list({'label': CAST([] AS BIGINT[]), 'low': CAST([] AS BIGINT[]), 'high': CAST([] AS BIGINT[]), 'a': x.i, 'b': y.i} ORDER BY rule, x.i, y.i) AS es
        FROM cand JOIN seq x ON x.alert_id = cand.a JOIN seq y ON y.alert_id = cand.b"""
    out["begin"] = """SELECT {'label': list(i ORDER BY i), 'low': list(start ORDER BY i), 'high': list("end" ORDER BY i), 'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)} AS first FROM seq"""
    out["labels"] = f"SELECT unnest(label) AS label, generate_subscripts(label, 1) AS i FROM (SELECT list_reduce(list_concat([first], coalesce(es, [])), lambda s, e: {step}).label AS label FROM begin, links)"
    out["place"] = "SELECT seq.*, min(seq.i) OVER (PARTITION BY label) AS c FROM seq JOIN labels USING (i)"
    out["pairs"] = """SELECT h.alert_id AS canonical, p.alert_id AS duplicate, CASE WHEN h.service = p.service AND h.anomaly_type = p.anomaly_type THEN 'same_service_overlap' ELSE 'shared_trace_id' END AS reason
        FROM place p JOIN seq h ON h.i = p.c WHERE p.i <> p.c"""
    rank = "CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 ELSE 0 END"
    out["next_to"] = "SELECT upstream AS service, downstream AS other FROM edges UNION SELECT downstream, upstream FROM edges UNION SELECT name, name FROM services"
    out["grp"] = f"""SELECT c, list(alert_id ORDER BY start, alert_id) AS alerts, list(DISTINCT service) AS services, max("end") AS last, max({rank}) AS rank,
        list_distinct(flatten(list((SELECT list(other) FROM next_to n WHERE n.service = place.service)))) AS about FROM place GROUP BY c"""
    # An open incident and a group have the same fields, so that a group becomes an incident.
    fields = "'start': {start}, 'id': {id}, 'end': {end}, 'rank': {rank}, 'services': {services}, 'alerts': {alerts}"
    out["heads"] = f"""SELECT list({{'incidents': [{{{fields.format(start='h.start', id="'I|' || h.alert_id", end='g.last', rank='g.rank', services='g.services', alerts='g.alerts')}}}], 'upto': h."end", 'about': g.about}} ORDER BY h.i) AS gs
        FROM grp g JOIN seq h ON h.i = g.c"""
    fits = f"""(e.incidents[1].start <= x."end" + {cfg.proximity} AND e.incidents[1].start >= x.start - {cfg.proximity} AND e.upto <= x.start + {cfg.incident_max} AND list_has_any(x.services, e.about))"""
    hit, mine = f"list_sort(list_filter(s.incidents, lambda x: {fits}))", "e.incidents[1]"
    every = lambda name: f"list_concat(list_transform({hit}, lambda x: x.{name}), [{mine}.{name}])"
    one = fields.format(start=f"coalesce({hit}[1].start, {mine}.start)", id=f"coalesce({hit}[1].id, {mine}.id)", end=f"list_max({every(chr(34) + 'end' + chr(34))})", rank=f"list_max({every('rank')})", services=f"list_distinct(flatten({every('services')}))", alerts=f"flatten({every('alerts')})")
    rest = f"list_filter(s.incidents, lambda x: NOT {fits})"
    out["inc"] = f"""SELECT unnest(incidents, recursive := true) FROM (SELECT list_reduce(list_concat([{{'incidents': gs[1].incidents[1:0], 'upto': gs[1].upto, 'about': gs[1].about}}], gs),
        lambda s, e: {{'incidents': list_concat({rest}, [{{{one}}}]), 'upto': e.upto, 'about': e.about}}).incidents AS incidents FROM heads WHERE gs IS NOT NULL)"""
    out["members"] = """SELECT id AS incident_id, unnest(alerts) AS alert_id, start, "end", CASE rank WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, list_sort(services) AS services FROM inc"""
    out["mal"] = "SELECT m.incident_id, al.* FROM members m JOIN al USING (alert_id)"
    out["per"] = """SELECT incident_id, service, CAST(count(*) AS DOUBLE) AS alert_count, min(start) AS own_start FROM mal GROUP BY 1, 2"""
    out["earliest"] = "SELECT incident_id, arg_min(service, {'start': start, 'id': alert_id}) AS first, min(start) AS first_start FROM mal GROUP BY 1"
    lasts = SPANS
    out["mc"] = f"""SELECT id AS incident_id, truth_id, {lasts} AS overlap, round(CAST({lasts} AS DOUBLE) / greatest(1, end_time - start_time), 6) AS coverage,
        round(CAST(len(list_intersect(services, affected)) AS DOUBLE) / greatest(1, len(list_distinct(list_concat(services, affected)))), 6) AS jaccard
        FROM inc i JOIN truth t ON list_has_any(services, affected) WHERE {lasts} >= {cfg.min_overlap}"""
    pair = "{'i': incident_id, 't': truth_id}"
    out["mo"] = f"SELECT list({{'taken': [{pair}]}} ORDER BY coverage DESC, jaccard DESC, truth_id, incident_id) AS cs FROM mc"
    out["mt"] = """SELECT unnest(taken, recursive := true) FROM (SELECT list_reduce(list_concat([{'taken': cs[1].taken[1:0]}], cs), lambda s, e:
        {'taken': CASE WHEN len(list_filter(s.taken, lambda x: x.i = e.taken[1].i OR x.t = e.taken[1].t)) = 0 THEN list_concat(s.taken, e.taken) ELSE s.taken END}).taken AS taken FROM mo WHERE cs IS NOT NULL)"""
    out["fc"] = f"""SELECT id, start, list({{'i': id, 't': truth_id}} ORDER BY {SPANS} DESC, truth_id) AS able FROM inc i JOIN truth t ON {SPANS} >= {2 * cfg.min_overlap} GROUP BY 1, 2"""
    free = "list_filter(e.able, lambda x: NOT list_contains(list_transform(s.taken, lambda y: y.t), x.t))[1:1]"
    out["fm"] = f"""SELECT unnest(taken, recursive := true) FROM (SELECT list_reduce(list_concat([{{'taken': es[1].able[1:0], 'able': es[1].able}}], es), lambda s, e: {{'taken': list_concat(s.taken, {free}), 'able': e.able}}).taken AS taken
        FROM (SELECT list({{'taken': able[1:0], 'able': able}} ORDER BY start, id) AS es FROM fc) WHERE es IS NOT NULL)"""
    return out


def queries(cfg: Config, using, as_of: int) -> dict[str, str]:
    return {
        "dedup_pairs": using("SELECT * FROM pairs", until="pairs"),
        "canonical_alerts": using('SELECT alert_id, service, anomaly_type, start, "end", severity FROM place WHERE i = c', until="pairs"),
        "alert_detail": using("SELECT alert_id, severity, (SELECT canonical FROM pairs WHERE duplicate = alert_id) AS duplicate_of, (SELECT string_agg(duplicate, ',' ORDER BY duplicate) FROM pairs WHERE canonical = alert_id) AS duplicates FROM al", until="pairs"),
        "dedup_reasons": using("SELECT reason, count(*) AS n FROM pairs GROUP BY 1", until="pairs"),
        "dedup_compression": using("SELECT *, CASE WHEN total > 0 THEN round(CAST(100 * suppressed AS DOUBLE) / total, 1) END AS percent FROM (SELECT count(*) AS total, count(*) FILTER (WHERE i <> c) AS suppressed FROM place)", until="pairs"),
        "incident_members": using("""SELECT incident_id, alert_id, start, "end", severity, array_to_string(services, ',') AS services FROM members""", until="members"),
        "incident_list": using(f"""SELECT *, round(CAST("end" - start AS DOUBLE) / 60, 1) AS duration_minutes, CASE WHEN "end" < {as_of - cfg.close_gap} THEN CAST({as_of} AS BIGINT) END AS closed_at FROM (
            SELECT incident_id, start, "end", severity, array_to_string(services, ',') AS services, count(*) AS alert_count FROM members GROUP BY ALL) ORDER BY start DESC, incident_id LIMIT 50""", until="members"),
        "incident_timeline": using("SELECT incident_id, string_agg(service || ' ' || anomaly_type || ' ' || severity, '; ' ORDER BY start, alert_id) AS timeline, count(*) AS alerts FROM mal GROUP BY 1", until="mal"),
        "chain_incidents": using("""SELECT incident_id, alert_id, start, "end", severity, array_to_string(services, ',') AS services FROM members""", until="members"),
        "incident_labels": using("""SELECT incident_id, len(names) AS services, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3) ELSE '' END AS label FROM (
            SELECT incident_id, list(CASE WHEN name = 'auth-service' THEN services.id ELSE name END ORDER BY name) AS names FROM (SELECT id AS incident_id, unnest(services) AS name FROM inc) JOIN services USING (name) GROUP BY 1)""", until="inc"),
        "incidents_overview": using(f"""SELECT count(DISTINCT id) AS incidents, count(DISTINCT CASE WHEN "end" < {as_of - cfg.close_gap} THEN NULL ELSE id END) AS active, count(DISTINCT service) AS impacted
            FROM (SELECT id, "end", unnest(services) AS service FROM (SELECT * FROM inc ORDER BY start DESC, id LIMIT 10))""", until="inc"),
        "incident_detail": using(f"""SELECT incident_id, CASE WHEN closed_at IS NULL THEN 'active' ELSE 'closed' END AS status, alert_count, closed_at, services, alerts FROM (
            SELECT m.incident_id, CASE WHEN m."end" < {as_of - cfg.close_gap} THEN CAST({as_of} AS BIGINT) END AS closed_at, array_to_string(m.services, ',') AS services, count(*) AS alert_count,
            string_agg(al.alert_id || ' ' || al."end" || ' ' || al.severity, ';' ORDER BY al.start, al.alert_id) AS alerts FROM members m JOIN al USING (alert_id) GROUP BY 1, 2, 3)""", until="members"),
        "truth_matches_first_come": using(f"SELECT id AS incident_id, truth_id, {SPANS} AS overlap FROM fm JOIN inc i ON i.id = fm.i JOIN truth t ON t.truth_id = fm.t", until="fm"),
        "truth_matches": using("SELECT incident_id, mc.truth_id, overlap, coverage, jaccard FROM mc JOIN mt ON mt.i = incident_id AND mt.t = mc.truth_id", until="mt"),
    }
