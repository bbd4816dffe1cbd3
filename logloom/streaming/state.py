"""Stateful streams: alerts and incidents as keyed state with event-time timers, and a rate limit with state that expires.

State lives in RocksDB, which Spark needs for transformWithState. Rows wait in state until the watermark has passed their time, so
every key is folded in the order of time whatever the order of arrival; rows that come again or later than the watermark are left out.
A row without an id is a heartbeat that only moves the watermark on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..functions.scalar import SEVERITIES
from ..operators.alerts import ALERT, extended
from ..operators.graph import components
from ..operators.incidents import INCIDENT, attach, neighbours
from ..sources.stages import settings

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_NO_IDLE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def run_to_parquet(stream: DataFrame, out: str, idle: bool = True) -> DataFrame:
    """Runs a stream of this module over what there is, carries on from its checkpoint below out, and reads all rows written so far.

    idle: batches without data follow, in which timers fire. State that expires by the clock would have them follow without end.
    """
    spark = stream.sparkSession
    with settings(spark, _ROCKS if idle else _ROCKS | _NO_IDLE):
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


class _Ordered(StatefulProcessor):
    """Keeps rows as JSON until the watermark passes their time, then hands them on by (time, id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", "at bigint, body string")
        self.fold = handle.getValueState("fold", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            identity, at, body = self.waits(row)
            if identity is not None and at * 1000 >= passed and not self.waiting.containsKey((identity,)):
                self.waiting.updateValue((identity,), (at, json.dumps(body)))
                self.handle.registerTimer(at * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((v[0], k[0], v[1]) for k, v in self.waiting.iterator() if v[0] * 1000 < passed)
        for _, identity, _ in ready:
            self.waiting.removeKey((identity,))
        held = json.loads(self.fold.get()[0]) if self.fold.exists() else None
        held, out, until = self.step(key, held, [json.loads(b) for _, _, b in ready], passed)
        self.fold.update((json.dumps(held),))
        for at in until:
            # A moment that has passed already was dealt with in this step.
            if at * 1000 + 1 > passed:
                self.handle.registerTimer(at * 1000 + 1)
        return iter(out)

    def close(self) -> None:
        pass


class _Debounce(_Ordered):
    def __init__(self, cfg: Config):
        self.cfg = cfg

    def waits(self, row) -> tuple:
        return row.id, row.window_start, [row.id, row.window_start, row["size"], row.severity, row.observed, row.baseline]

    def step(self, key, held, rows, passed):
        """held: the last alert, which is the only one that may still be extended."""
        out = []
        for own in rows:
            longer = extended(held, *own[:4], self.cfg)
            if longer is None:
                out += [held] if held else []
                held = {"alert_id": "A|" + own[0], "start": own[1], "end": own[1] + own[2], "rank": SEVERITIES.index(own[3]), "observed": own[4], "baseline": own[5], "anomaly_ids": [own[0]]}
            else:
                held = longer
        if held and (held["end"] + self.cfg.debounce) * 1000 < passed:
            out, held = [*out, held], None
        done = [Row(alert_id=a["alert_id"], service=key[0], anomaly_type=key[1], start=a["start"], end=a["end"], severity=SEVERITIES[a["rank"]], observed=a["observed"], baseline=a["baseline"], anomaly_ids=a["anomaly_ids"]) for a in out]
        return held, done, [held["end"] + self.cfg.debounce] if held else []


def debounced(anomalies: DataFrame, cfg: Config, delay: int) -> DataFrame:
    """Alerts of a stream of anomalies, each written once it can't be extended any more.

    delay: seconds that an anomaly may come later than one with a larger window_start; the largest window size at least.
    """
    timed = anomalies.withColumn("timestamp", F.timestamp_seconds("window_start")).withWatermark("timestamp", f"{delay + 1} seconds")
    own = timed.select("id", "service", "anomaly_type", "window_start", "size", "severity", "observed", "baseline", "timestamp")
    return own.groupBy("service", "anomaly_type").transformWithState(_Debounce(cfg), ALERT, "append", "EventTime")


class _Lifecycle(_Ordered):
    def __init__(self, cfg: Config, near: set):
        self.cfg, self.near, self.gap = cfg, near, max(cfg.close_gap, cfg.proximity)

    def waits(self, row) -> tuple:
        alerts = [[a["alert_id"], a["service"], a["end"], SEVERITIES.index(a["severity"])] for a in row.alerts or []]
        return row.group, row.start, {"id": row.group, "start": row.start, "end": row.end, "alerts": alerts}

    def step(self, key, held, rows, passed):
        """held: number of changes so far and the open incidents, which include all that a later group may join."""
        number, open_ = held or (0, [])
        touched: set[str] = set()
        for group in rows:
            touched.add(attach(open_, group, self.near, self.cfg)["id"])
        shut = [i for i in open_ if (i["end"] + self.gap) * 1000 < passed]
        open_ = [i for i in open_ if i not in shut]
        changed = [(i, "open") for i in open_ if i["id"] in touched] + [(i, "closed") for i in shut]
        out = []
        for i, status in changed:
            number += 1
            closed_at = i["end"] + self.gap if status == "closed" else None
            out += [Row(incident_id=i["id"], alert_id=a, start=i["start"], end=i["end"], severity=SEVERITIES[i["rank"]], services=sorted(i["services"]), status=status, closed_at=closed_at, part=key[0], change=number) for a in i["alerts"]]
        return [number, open_], out, [i["end"] + self.gap for i in open_]


LIFECYCLE = f"{INCIDENT}, status string, closed_at bigint, part string, change bigint"


def parts(spark: SparkSession, adjacent: set[tuple[str, str]], services: list[str], together: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """(service, part): connected parts of the graph; together: services without an edge whose alerts can be duplicates of each other."""
    edges = spark.createDataFrame(sorted({*adjacent, *together, *((s, s) for s in services)}), "a string, b string")
    found = components(edges).select(F.col("node").alias("service"), F.col("component").alias("part"))
    alone = edges.select(F.col("a").alias("service")).union(edges.select("b")).distinct().join(found, "service", "left_anti")
    return found.unionByName(alone.withColumn("part", F.col("service")))


def lifecycle(groups: DataFrame, part_of: DataFrame, adjacent: set[tuple[str, str]], cfg: Config, delay: int) -> DataFrame:
    """Incidents of a stream of groups(group, start, end, services, alerts), keyed by the part of the service graph.

    Each change gives the incident's alerts anew: with status open when it is opened, extended or merged, and closed by a timer once
    nothing joined it for the quiet gap. current() reads the state of incidents from that.
    """
    many = F.raise_error(F.concat(F.lit("services of several parts are in group "), F.col("group")))
    where = part_of.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("service", "part"))).alias("where")).first()["where"] or {}
    lookup = F.create_map(*(F.lit(x) for pair in sorted(where.items()) for x in pair)) if where else F.create_map(F.lit(""), F.lit(""))
    own = groups.withColumn("in", F.array_distinct(F.transform("services", lambda s: F.coalesce(F.element_at(lookup, s), s))))
    own = own.withColumn("part", F.when(F.get("in", F.lit(1)).isNotNull(), many).otherwise(F.get("in", F.lit(0))))
    timed = own.withColumn("timestamp", F.timestamp_seconds("start")).withWatermark("timestamp", f"{delay + 1} seconds")
    timed = timed.select("group", "start", "end", "alerts", "part", "timestamp")
    return timed.groupBy("part").transformWithState(_Lifecycle(cfg, neighbours(adjacent)), LIFECYCLE, "append", "EventTime")


def current(changes: DataFrame) -> DataFrame:
    """The newest row of each alert: its incident now, open or closed."""
    rest = [c for c in changes.columns if c != "alert_id"]
    return changes.groupBy("alert_id").agg(F.max(F.struct("change", *(c for c in rest if c != "change"))).alias("now")).select("alert_id", *(f"now.{c}" for c in rest))


_DECISION = ("id", "identity_hash", "window_start", "allowed", "retry_after")


class _Limit(StatefulProcessor):
    """Reads and writes a count once for all its requests of a micro-batch, since a call to the state costs more than a request does."""

    def __init__(self, limit: int, seconds: int, ttl: int):
        self.limit, self.seconds, self.ttl = limit, seconds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint", ttlDurationMs=self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own, decision = sorted(((r.at, r.id) for r in rows), key=lambda r: (r[0] or 0, r[1] or "")), Row(*_DECISION)
        free = self.limit <= 0 or not own or own[0][0] is None  # requests of a key have a time all or none, as their windows do
        passing = len(own) if free else self.limit - self.counted(len(own))
        for place, (_, identity) in enumerate(own):
            over = place >= passing
            yield decision(identity, *key, not over, self.seconds if over else None)

    def counted(self, more: int) -> int:
        """Requests before these ones, which are counted; so few that all pass if the state can't be had, since availability comes first."""
        try:
            n = self.count.get()[0] if self.count.exists() else 0
            self.count.update((n + more,))
        except Exception:
            return -more
        return n

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60, ttl: int | None = None) -> DataFrame:
    """A decision for each of requests(id, ts, identity): no more than limit pass in a tumbling window; others get a time to retry after.

    An identity's count is dropped ttl seconds (five more than a window) after it was last used, by the clock. Requests without an
    identity share one, and those without a time pass. A limit of 0 or less means none. Works on streams; run_to_parquet with idle False.
    """
    own = requests.select(F.col("id").cast("string").alias("id"), F.col("ts").alias("at"), F.left(F.sha2(F.coalesce(F.col("identity").cast("string"), F.lit("unknown")), 256), F.lit(24)).alias("identity_hash"))
    own = own.withColumn("window_start", F.col("at") - F.pmod("at", F.lit(seconds)))
    kind = "id string, identity_hash string, window_start bigint, allowed boolean, retry_after int"
    return own.groupBy("identity_hash", "window_start").transformWithState(_Limit(limit, seconds, ttl or seconds + 5), kind, "append", "ProcessingTime")


def decisions(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """The same decisions over a table, by the number of requests before in the window; counted per (window, identity)."""
    own = requests.where("ts IS NOT NULL").select((F.col("ts") - F.pmod("ts", F.lit(seconds))).alias("window_start"), F.left(F.sha2(F.coalesce(F.col("identity").cast("string"), F.lit("unknown")), 256), F.lit(24)).alias("identity_hash"))
    got = own.groupBy("window_start", "identity_hash").agg(F.count("*").alias("n"))
    most = F.lit(limit if limit > 0 else 2**62)
    return got.select("window_start", "identity_hash", F.least("n", most).alias("allowed"), F.greatest(F.col("n") - most, F.lit(0)).cast("bigint").alias("denied"))
