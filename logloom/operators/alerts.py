"""Alerts: debounced anomalies, duplicate edges and bounded components of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import SEVERITIES
from ..sources.stages import spread, stored
from .graph import components
from .intervals import bucketed, overlap_pairs

ALERT = "alert_id string, service string, anomaly_type string, start bigint, end bigint, severity string, observed double, baseline double, anomaly_ids array<string>"


def gap_groups(rows: DataFrame, keys: list[str], start: str, reach: str, gap: int, order: list[str], name: str) -> DataFrame:
    """Numbers the stretches of rows (per keys) that follow a gap of more than `gap` behind everything before; stretches can be folded alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return rows.withColumn("fresh", fresh).withColumn(name, F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def extended(alert: dict | None, anomaly: str, at: int, size: int, severity: str, cfg: Config) -> dict | None:
    """The last alert of a service and type with one more anomaly, or None if that is too far away or the alert would last too long."""
    if not alert or alert["end"] < at - cfg.debounce or alert["start"] > at + cfg.debounce or at + size > alert["start"] + cfg.alert_max:
        return None
    ids = alert["anomaly_ids"]
    return {**alert, "end": max(alert["end"], at + size), "rank": max(alert["rank"], SEVERITIES.index(severity)), "anomaly_ids": ids if anomaly in ids else [*ids, anomaly]}


#: Stretches of a service and type that are folded as one group.
_STRETCHES = 100


def debounce(anomalies: DataFrame, cfg: Config) -> DataFrame:
    """Alerts: an anomaly extends the last alert of its service and type when near enough and the alert stays short enough.

    An anomaly more than the debounce gap behind all earlier ends always opens an alert, so the fold runs per some stretches between such gaps.
    """
    own = anomalies.withColumn("reach", F.col("window_start") + F.col("size"))
    own = gap_groups(own, ["service", "anomaly_type"], "window_start", "reach", cfg.debounce, ["window_start", "id"], "stretch")
    # Stretches in a row are folded together, since a group of its own costs more than a short stretch does.
    own = own.withColumn("stretch", F.floor(F.col("stretch") / _STRETCHES))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f, out = f.sort_values(["window_start", "id"]), []
        for r in f.itertuples():
            longer = extended(out[-1] if out else None, r.id, r.window_start, r.size, r.severity, cfg)
            if longer is not None:
                out[-1] = longer
            else:
                out.append({"alert_id": "A|" + r.id, "service": r.service, "anomaly_type": r.anomaly_type, "start": r.window_start, "end": r.window_start + r.size, "rank": SEVERITIES.index(r.severity), "observed": r.observed, "baseline": r.baseline, "anomaly_ids": [r.id]})
        return pd.DataFrame([{**a, "severity": SEVERITIES[a["rank"]]} for a in out])[[x.split()[0] for x in ALERT.split(", ")]]

    cols = ["id", "service", "anomaly_type", "window_start", "size", "severity", "observed", "baseline", "stretch"]
    key = ["service", "anomaly_type", "stretch"]
    return spread(own.select(*cols), *key).groupBy(key).applyInPandas(fold, ALERT)


def same_service_edges(alerts: DataFrame, cfg: Config) -> DataFrame:
    pairs = overlap_pairs(alerts.withColumn("kind", F.col("anomaly_type")).withColumn("own", F.col("service")), ["own", "kind"], cfg.dedup_same, max(cfg.alert_max, cfg.dedup_same))
    return pairs.select(F.col("a_alert_id").alias("a"), F.col("b_alert_id").alias("b"), F.lit(0).alias("rule"))


def alert_traces(alerts: DataFrame, logs: DataFrame, width: int) -> DataFrame:
    """Distinct traces of an alert: those of its service's logs inside its interval, both ends included."""
    spread = alerts.select("alert_id", "service", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bucket"))
    own = logs.where("trace_id IS NOT NULL").select("service", "trace_id", "ts", F.floor(F.col("ts") / width).alias("bucket"))
    return own.join(spread, ["service", "bucket"]).where("ts BETWEEN start AND end").select("alert_id", "service", "start", "end", "trace_id").distinct()


#: Classes whose members are marked in the bits of one long, and about as many classes are numbered together.
_BITS, _LANE = 60, 600


def trace_classes(held: DataFrame, width: int, pad: int) -> DataFrame:
    """held(alert_id, service, start, end, trace_id) as rows per alert, bucket of time and chunk of classes, with the classes as bits.

    Traces that hold the same alerts in a bucket are one class there; classes of a single service are left out, since they make no
    pair. Sets are compared by two 64-bit sums without carry (xor) of their members' hashes and by size, so no trace is gathered in one
    place. Classes with the same first alert are numbered near each other. An alert is in each bucket that it touches within pad.
    """
    own = bucketed(held.withColumn("until", F.col("end") + pad), "start", "until", width, "bucket").drop("until")
    sign = [F.bit_xor(F.xxhash64(F.lit(k), "alert_id")).alias(f"h{k}") for k in (1, 2)]
    sets = own.groupBy("bucket", "trace_id").agg(F.count("*").alias("n"), *sign, F.min("service").alias("s1"), F.max("service").alias("s2"), F.min("alert_id").alias("first"))
    one = sets.where("s1 <> s2").groupBy("bucket", "n", "h1", "h2").agg(F.min("trace_id").alias("trace_id"), F.min("first").alias("first"))
    many = one.groupBy("bucket").agg(F.ceil(F.count("*") / _LANE).alias("lanes"))
    one = one.join(many, "bucket").withColumn("lane", F.pmod(F.xxhash64("first"), F.col("lanes")))
    place = F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("first", "h1", "h2", "n")) - 1
    one = one.select("bucket", "trace_id", "lane", F.floor(place / _BITS).alias("chunk"), F.pmod(place, F.lit(_BITS)).alias("bit"))
    bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    return own.join(one, ["bucket", "trace_id"]).groupBy("bucket", "lane", "chunk", "alert_id", "service", "start", "end").agg(bits)


def shared_trace_pairs(alerts: DataFrame, logs: DataFrame, cfg: Config) -> DataFrame:
    """Pairs (a, b) of alerts of different services that come near in time and share a trace, once for each chunk of classes with such a trace."""
    width = max(cfg.alert_max, cfg.dedup_trace)
    own = trace_classes(alert_traces(alerts, logs, width), width, cfg.dedup_trace)
    chunk = ["bucket", "lane", "chunk"]
    side = lambda name: own.select(*chunk, *(F.col(c).alias(f"{name}_{c}") for c in ("alert_id", "service", "start", "end", "bits")))
    near = (F.col("b_start") <= F.col("a_end") + cfg.dedup_trace) & (F.col("b_end") >= F.col("a_start") - cfg.dedup_trace)
    # A pair belongs to the first bucket that both touch, so buckets make no pair twice.
    first = F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width)
    before = F.struct("a_start", "a_alert_id") < F.struct("b_start", "b_alert_id")
    shared = F.col("a_bits").bitwiseAND(F.col("b_bits")) != 0
    pairs = side("a").join(side("b"), chunk).where(near & first & before & shared & (F.col("a_service") != F.col("b_service")))
    return pairs.select(F.col("a_alert_id").alias("a"), F.col("b_alert_id").alias("b"), F.lit(1).alias("rule"))


def shared_trace_edges(alerts: DataFrame, logs: DataFrame, cfg: Config) -> DataFrame:
    return shared_trace_pairs(alerts, logs, cfg).distinct()


def duplicates(alerts: DataFrame, edges: DataFrame, cfg: Config) -> DataFrame:
    """canonical, duplicate and reason: components of edges whose joint span stays within the limit, edges taken in a fixed order.

    Edges of different components don't meet, and a union across a start gap longer than the span limit is never allowed, so each
    component of the candidate edges is cut at such gaps and folded alone.
    """
    edges = stored(edges)
    part = components(edges.select("a", "b"))
    own = alerts.select("alert_id", "service", "anomaly_type", "start", "end").join(part.withColumnRenamed("node", "alert_id"), "alert_id").withColumn("at", F.col("start"))
    own = gap_groups(own, ["component"], "start", "at", cfg.dedup_span, ["start", "alert_id"], "stretch").drop("at")
    place = own.select(F.col("alert_id").alias("a"), "component", F.col("stretch").alias("part"), F.col("start").alias("sa"))
    links = edges.join(place, "a").join(own.select(F.col("alert_id").alias("b"), F.col("stretch").alias("other"), F.col("start").alias("sb")), "b").where("part = other").drop("other")
    links = stored(links)

    def fold(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        info = {r.alert_id: r for r in own.itertuples()}
        root = {i: i for i in info}
        span = {i: (r.start, r.end) for i, r in info.items()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for r in links.sort_values(["rule", "sa", "a", "sb", "b"]).itertuples():
            x, y = find(r.a), find(r.b)
            low, high = min(span[x][0], span[y][0]), max(span[x][1], span[y][1])
            if x != y and high - low <= cfg.dedup_span:
                root[y], span[x] = x, (low, high)
        best: dict = {}
        for i, r in info.items():
            x = find(i)
            best[x] = min(best.get(x, (r.start, i)), (r.start, i))
        out = []
        for i, r in info.items():
            c = info[best[find(i)][1]]
            if c.alert_id != i:
                same = c.service == r.service and c.anomaly_type == r.anomaly_type
                out.append((c.alert_id, i, "same_service_overlap" if same else "shared_trace_id"))
        return pd.DataFrame(out, columns=["canonical", "duplicate", "reason"])

    left, right = spread(own, "component", "stretch"), spread(links, "component", "part")
    return left.groupBy("component", "stretch").cogroup(right.groupBy("component", "part")).applyInPandas(fold, "canonical string, duplicate string, reason string")


def canonical(alerts: DataFrame, pairs: DataFrame) -> DataFrame:
    return alerts.join(pairs.select(F.col("duplicate").alias("alert_id")), "alert_id", "left_anti")


def compression(alerts: DataFrame, pairs: DataFrame) -> DataFrame:
    both = alerts.select(F.lit(1).alias("alert"), F.lit(0).alias("gone")).unionByName(pairs.select(F.lit(0).alias("alert"), F.lit(1).alias("gone")))
    return both.agg(F.coalesce(F.sum("alert"), F.lit(0)).alias("total"), F.coalesce(F.sum("gone"), F.lit(0)).alias("suppressed")).withColumn("percent", F.round(F.when(F.col("total") > 0, 100 * F.col("suppressed") / F.col("total")), 1))
