"""Incidents: clusters of alerts near in time and in the dependency graph; graph closure; read views."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import SEVERITIES, confidence
from ..sources.stages import spread, stored
from .alerts import gap_groups
from .graph import components, reachable

INCIDENT = "incident_id string, alert_id string, start bigint, end bigint, severity string, services array<string>"


def closure(edges: DataFrame) -> DataFrame:
    """(upstream, reached) over any number of steps, without self pairs."""
    return reachable(edges)


def named_edges(dependencies: DataFrame, services: DataFrame) -> DataFrame:
    up = services.select(F.col("id").alias("upstream_id"), F.col("name").alias("upstream"))
    down = services.select(F.col("id").alias("downstream_id"), F.col("name").alias("downstream"))
    return dependencies.join(up, "upstream_id").join(down, "downstream_id")


def neighbours(adjacent: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """Ordered pairs of services with an edge in either direction."""
    return adjacent | {(b, a) for a, b in adjacent}


def attach(open_: list[dict], group: dict, near: set[tuple[str, str]], cfg: Config) -> dict:
    """Takes a group of alerts into the open incidents that are near in time and share or neighbour a service: none opens one, several are merged into the oldest.

    group: id, start and end of its first alert, and alerts as (id, service, end, rank of severity). Returns the incident, which is in open_.
    """

    def fits(i: dict) -> bool:
        if group["start"] > i["end"] + cfg.proximity or group["start"] < i["start"] - cfg.proximity or group["end"] > i["start"] + cfg.incident_max:
            return False
        return any(service == s or (service, s) in near for _, service, _, _ in group["alerts"] for s in i["services"])

    found = sorted(filter(fits, open_), key=lambda i: (i["start"], i["id"]))
    if not found:
        found = [{"id": "I|" + group["id"], "start": group["start"], "end": group["end"], "rank": 0, "services": [], "alerts": []}]
        open_ += found
    target, *others = found
    for o in others:
        target["alerts"] += o["alerts"]
        target["services"] += [s for s in o["services"] if s not in target["services"]]
        target["start"], target["end"], target["rank"] = min(target["start"], o["start"]), max(target["end"], o["end"]), max(target["rank"], o["rank"])
        open_.remove(o)
    for alert, service, end, rank in group["alerts"]:
        target["alerts"].append(alert)
        target["services"] += [service] if service not in target["services"] else []
        target["end"], target["rank"] = max(target["end"], end), max(target["rank"], rank)
    return target


def grouped(alerts: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per canonical alert: group, start and end of it, last (the end of all its alerts), services, and alerts as structs."""
    member = alerts.join(pairs.select(F.col("duplicate").alias("alert_id"), "canonical"), "alert_id", "left").withColumn("group", F.coalesce("canonical", "alert_id"))
    head = F.when(F.col("alert_id") == F.col("group"), F.struct("start", "end"))
    item = F.struct("start", "alert_id", "service", "end", "severity")
    own = member.groupBy("group").agg(F.max(head).alias("head"), F.max("end").alias("last"), F.collect_set("service").alias("services"), F.array_sort(F.collect_list(item)).alias("alerts"))
    return own.select("group", "head.start", "head.end", "last", "services", "alerts")


def interacting(groups: DataFrame, adjacent: set[tuple[str, str]], cfg: Config) -> DataFrame:
    """groups with a part: groups of different parts never meet in an incident.

    A group joins an incident only if some member shares or neighbours one of its services and starts at most the longest duration
    away, so parts are the components of such pairs. Pairs aren't built: of the groups around a service, all that start in one
    bucket of that duration are linked with one that has the service, and with those of the buckets before and behind if near enough.
    """
    spark = groups.sparkSession
    around = spark.createDataFrame(sorted(neighbours(adjacent)), "own string, other string")
    has = groups.select("group", "start", F.explode("services").alias("service"))
    entry = has.unionByName(has.join(F.broadcast(around), F.col("service") == F.col("own")).select("group", "start", F.col("other").alias("service")))
    bucket = F.floor(F.col("start") / cfg.incident_max)
    entry, has = entry.withColumn("bucket", bucket), has.withColumn("bucket", bucket)
    per = has.groupBy("service", "bucket").agg(F.min("group").alias("one"), F.min("start").alias("low"), F.max("start").alias("high"))
    shifted = [per.withColumn("bucket", F.col("bucket") + k) for k in (-1, 0, 1)]
    near = F.greatest(F.col("low") - F.col("start"), F.col("start") - F.col("high")) <= cfg.incident_max
    edges = entry.join(shifted[0].unionByName(shifted[1]).unionByName(shifted[2]), ["service", "bucket"]).where(near).select(F.col("group").alias("a"), F.col("one").alias("b"))
    part = components(edges).select(F.col("node").alias("group"), F.col("component").alias("part"))
    return groups.join(part, "group", "left").withColumn("part", F.coalesce("part", "group"))


def folds(alerts: DataFrame, pairs: DataFrame, adjacent: set[tuple[str, str]], cfg: Config, segment: int) -> DataFrame:
    """Groups of alerts with part, stretch and segment: each (part, stretch) is folded apart from all others.

    A group joins no incident when it starts later than every member's last end and proximity, or start and longest duration,
    whichever is less; parts are cut at such places. segment numbers spans of that many seconds inside a stretch.
    """
    own = interacting(stored(grouped(alerts, pairs)), adjacent, cfg)
    own = own.withColumn("reach", F.least(F.col("last") + cfg.proximity, F.col("start") + cfg.incident_max))
    return gap_groups(own, ["part"], "start", "reach", 0, ["start", "group"], "stretch").drop("reach").withColumn("segment", F.floor(F.col("start") / segment))


_PLACE = ["part", "stretch", "segment"]
_FOLDED = f"part string, stretch bigint, segment bigint, {INCIDENT}, state string"


def cluster(alerts: DataFrame, pairs: DataFrame, adjacent: set[tuple[str, str]], cfg: Config, segment: int | None = None) -> DataFrame:
    """Incident of each alert. Groups (a canonical alert with its duplicates) go in order of start into open incidents, as attach() says.

    Steady alerts make stretches without an end, so a stretch is folded in segments at the same time: each begins with the incidents
    that the one before leaves open, at first with none. Segments whose beginning turns out otherwise are folded again, until all
    agree, which gives the result of one fold over all. Incidents are short against a segment, so what a segment leaves open rarely
    depends on its beginning, and rounds are few; there are at most as many as a stretch has segments.
    """
    segment, near = segment or 8 * cfg.incident_max, neighbours(adjacent)
    names = [x.split()[0] for x in _FOLDED.split(", ")]

    def fold(f: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        open_: list[dict] = json.loads(begin.state.iloc[0])
        place = [begin[c].iloc[0] for c in _PLACE]
        for r in f.sort_values(["start", "group"]).itertuples():
            attach(open_, {"id": r.group, "start": r.start, "end": r.end, "alerts": [(a["alert_id"], a["service"], a["end"], SEVERITIES.index(a["severity"])) for a in r.alerts]}, near, cfg)
        ahead = begin["next"].iloc[0]
        alive = [] if pd.isna(ahead) else [i for i in open_ if min(i["end"] + cfg.proximity, i["start"] + cfg.incident_max) >= ahead * segment]
        rows = [(*place, i["id"], a, i["start"], i["end"], SEVERITIES[i["rank"]], sorted(i["services"]), None) for i in open_ if i not in alive for a in i["alerts"]]
        left = json.dumps(sorted(alive, key=lambda i: i["id"]))
        return pd.DataFrame([*rows, (*place, None, None, 0, 0, None, [], left)], columns=names)

    rows = stored(folds(alerts, pairs, adjacent, cfg, segment).select("group", "start", "end", "alerts", *_PLACE))
    places = rows.select(_PLACE).distinct().withColumn("next", F.lead("segment").over(Window.partitionBy("part", "stretch").orderBy("segment")))
    begins = places.withColumn("state", F.lit("[]"))
    folded = lambda rows, begins: spread(rows, *_PLACE).groupBy(_PLACE).cogroup(spread(begins, *_PLACE).groupBy(_PLACE)).applyInPandas(fold, _FOLDED)
    members = [x.split()[0] for x in INCIDENT.split(", ")]
    if not rows.groupBy("part", "stretch").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high").take(1):
        return folded(rows, begins).where("state IS NULL").select(members)
    begins = stored(begins)
    made = done = stored(folded(rows, begins))
    while True:
        left = made.where("state IS NOT NULL").select(*_PLACE, "state").join(begins.select(*_PLACE, "next"), _PLACE).where("next IS NOT NULL")
        left = left.select("part", "stretch", F.col("next").alias("segment"), F.col("state").alias("new"))
        todo = stored(begins.join(left, _PLACE).where("state <> new").select(*_PLACE, "next", F.col("new").alias("state")))
        if not todo.take(1):
            return done.where("state IS NULL").select(members)
        begins = stored(begins.join(todo.select(_PLACE), _PLACE, "left_anti").select(todo.columns).unionByName(todo))
        made = stored(folded(rows.join(todo.select(_PLACE), _PLACE, "left_semi"), todo))
        done = stored(done.join(todo.select(_PLACE), _PLACE, "left_anti").select(made.columns).unionByName(made))


def summaries(members: DataFrame, cfg: Config, as_of: int | None = None) -> DataFrame:
    """One row per incident with its alert count, duration in minutes and, when quiet long enough at as_of, its closing time."""
    own = members.groupBy("incident_id", "start", "end", "severity", "services").agg(F.count("*").alias("alert_count"))
    own = own.withColumn("duration_minutes", F.round(F.greatest(F.lit(0), F.col("end") - F.col("start")) / 60, 1))
    quiet = F.lit(as_of).cast("bigint")
    return own.withColumn("closed_at", F.when(F.col("end") < quiet - cfg.close_gap, quiet))


def timeline(members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each incident's alerts in order of start as one string per incident."""
    own = members.select("incident_id", "alert_id").join(alerts.drop("services"), "alert_id")
    item = F.struct("start", "alert_id", F.concat_ws(" ", "service", "anomaly_type", "severity").alias("what"))
    return own.groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["what"]), "; ").alias("timeline"), F.count("*").alias("alerts"))


def service_labels(members: DataFrame, services: DataFrame, known: DataFrame, shown: int = 3) -> DataFrame:
    """Names of each incident's services as one string, the first few and how many more. A service that isn't known shows its id."""
    one = members.select("incident_id", F.posexplode("services").alias("at", "service")).distinct()
    own = one.join(services.select(F.col("name").alias("service"), "id"), "service").join(known.select("id", F.col("name").alias("known")), "id", "left")
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("known", "id").alias("what")))), lambda x: x["what"])
    got = own.groupBy("incident_id").agg(names.alias("names"))
    more = F.when(F.size("names") > shown, F.concat(F.lit(" +"), (F.size("names") - shown).cast("string"))).otherwise("")
    return got.select("incident_id", F.size("names").cast("bigint").alias("services"), F.concat(F.array_join(F.slice("names", 1, shown), ", "), more).alias("label"))


def detail(summary: DataFrame, members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each incident with its state and its alerts in order of start, as an array of structs."""
    own = members.select("incident_id", "alert_id").join(alerts, "alert_id")
    item = F.struct("start", "alert_id", "end", "service", "anomaly_type", "severity", "observed", "baseline")
    lines = own.groupBy("incident_id").agg(F.array_sort(F.collect_list(item)).alias("alerts"))
    return summary.join(lines, "incident_id").withColumn("status", F.when(F.col("closed_at").isNull(), "active").otherwise("closed"))


# Texts of a briefing.
_SCORED = "%s incident affecting %d service(s); %s is the top RCA candidate with %s confidence."
_UNSCORED = "%s incident affecting %d service(s); RCA scoring has not run yet."
_WHY, _WHY_PLAIN, _WHY_NONE = "Top contributing signals: %s.", "Ranked highest by the RCA model.", "No root-cause scores were available for this incident."
_EARLIEST, _EMPHASIZED, _CLUSTERED = "Earliest alert: %s %s at %s.", "RCA feature evidence emphasized: %s.", "%d alert(s) were clustered into this incident."
_CHECK, _RUN = "Check %s deploys, saturation, and dependency errors first.", "Run the RCA ranking job before assigning ownership."
_ACTIONS = ("Inspect earliest correlated traces and logs around the first alert window.", "Validate whether downstream services recover after the suspected root cause is mitigated.")
_HEAD = "# Incident Briefing\n\n**Incident:** `%s`\n**Severity:** %s\n**Status:** %s\n**Affected services:** %s\n\n"
_BODY = "## Summary\n%s\n\n## Suspected Root Cause\n%s (%s confidence). %s\n\n## Evidence\n%s\n\n## Recommended Actions\n%s\n"


def briefing(detailed: DataFrame, ranked: DataFrame) -> DataFrame:
    """Title, summary, cause, evidence, actions, impact and a markdown text of each incident of detail(); ranked has top_features as one string.

    An incident that no ranker has scored gets the texts that say so.
    """
    top = ranked.where("rank = 1").select("incident_id", F.col("service").alias("cause"), F.round("score", 4).alias("score"), F.nullif("top_features", F.lit("")).alias("signals"))
    own = detailed.join(top, "incident_id", "left").withColumn("confidence", confidence(F.col("score")))
    scored, first = F.col("cause").isNotNull(), F.get("alerts", F.lit(0))
    n = F.size("services")
    own = own.withColumn("title", F.concat("severity", F.lit(" incident on "), F.coalesce("cause", F.lit("unknown service"))))
    own = own.withColumn("summary", F.when(scored, F.format_string(_SCORED, "severity", n, "cause", "confidence")).otherwise(F.format_string(_UNSCORED, "severity", n)))
    own = own.withColumn("why", F.when(~scored, _WHY_NONE).when(F.col("signals").isNull(), _WHY_PLAIN).otherwise(F.format_string(_WHY, "signals")))
    at = F.date_format(F.timestamp_seconds(first["start"]), "yyyy-MM-dd'T'HH:mm:ssxxx")
    evidence = F.array(
        F.when(first.isNotNull(), F.format_string(_EARLIEST, first["service"], first["anomaly_type"], at)),
        F.when(F.col("signals").isNotNull(), F.format_string(_EMPHASIZED, "signals")),
        F.when(F.col("alert_count") > 0, F.format_string(_CLUSTERED, "alert_count")),
    )
    own = own.withColumn("evidence", F.array_compact(evidence))
    own = own.withColumn("actions", F.array(F.when(scored, F.format_string(_CHECK, "cause")).otherwise(_RUN), *map(F.lit, _ACTIONS)))
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    names = F.when(n > 0, F.array_join("services", ", ")).otherwise("unknown")
    body = F.format_string(_BODY, "summary", F.coalesce("cause", F.lit("Not enough RCA data")), "confidence", "why", lines("evidence"), lines("actions"))
    own = own.withColumn("markdown", F.concat(F.format_string(_HEAD, "incident_id", "severity", "status", names), body))
    return own.select("incident_id", "title", "status", "severity", "summary", "cause", "score", "confidence", "why", "services", "alert_count", "duration_minutes", "evidence", "actions", "markdown")
