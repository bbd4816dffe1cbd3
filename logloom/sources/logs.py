"""Log events: JSON lines, validation, service lookup, and a view of the events table as logs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import SEVERITIES

# Services, their edges, levels, field names and limits of the log format.
SERVICES = ("api-gateway", "auth-service", "checkout-service", "payment-service", "inventory-service", "notification-service")
#: (caller, dependency)
EDGES = (("api-gateway", "auth-service"), ("api-gateway", "checkout-service"), ("checkout-service", "payment-service"), ("checkout-service", "inventory-service"), ("checkout-service", "notification-service"))
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")
LOG_SCHEMA = "timestamp string, service string, level string, message string, request_id string, trace_id string, latency_ms int, status_code int, host string, region string"
TRUTH_SCHEMA = "truth_incident_id string, type string, split string, affected_metric string, start_time string, end_time string, root_cause_service string, affected_services array<string>"


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(SERVICES)], "id string, name string")


def dependencies(spark: SparkSession) -> DataFrame:
    at = {n: f"s{i}" for i, n in enumerate(SERVICES)}
    return spark.createDataFrame([(at[a], at[b]) for a, b in EDGES], "upstream_id string, downstream_id string")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped by the JSON reader; no schema is inferred. A line that isn't an event keeps its text in _corrupt_record."""
    return spark.read.schema(f"{LOG_SCHEMA}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


_UUID = r"^(?i:urn:uuid:)?\{?([0-9a-fA-F]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\}?$"


def stripped(name: str | Column) -> Column:
    """A string without white space of any kind at its ends."""
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def problems(field=F.col) -> Column:
    """Names of the fields of an event with stripped strings that break its rules, as an array. field: gives a field's value by its name."""
    size = lambda name, low, high: F.length(field(name)).between(low, high)
    absent = lambda name, ok: field(name).isNull() | F.coalesce(ok, F.lit(False))
    rules = {
        "timestamp": F.try_to_timestamp(field("timestamp")).isNotNull(),
        "service": F.coalesce(size("service", 1, 255), F.lit(False)),
        "level": F.coalesce(field("level").isin(*LEVELS), F.lit(False)),
        "message": F.coalesce(size("message", 1, 4096), F.lit(False)),
        "request_id": absent("request_id", field("request_id").rlike(_UUID)),
        "trace_id": absent("trace_id", field("trace_id").rlike(_UUID)),
        "latency_ms": absent("latency_ms", field("latency_ms") >= 0),
        "status_code": absent("status_code", field("status_code").between(100, 599)),
        "host": absent("host", F.length(field("host")) <= 255),
        "region": absent("region", F.length(field("region")) <= 64),
    }
    return F.array_compact(F.array(*(F.when(~ok, name) for name, ok in rules.items())))


#: Fields of an event that are stripped before they are judged.
STRINGS = ("service", "level", "message", "request_id", "trace_id", "host", "region")


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); strings are stripped first, and quarantined rows keep the names of the broken fields."""
    own = events.withColumns({c: stripped(c) for c in STRINGS}).withColumn("problems", problems())
    return own.where(F.size("problems") == 0).drop("problems"), own.where(F.size("problems") > 0)


def import_logs(events: DataFrame, known: DataFrame) -> DataFrame:
    """Raw logs; events of unknown services are dropped, level and message get defaults; host and region aren't kept."""
    own = events.join(known.select(F.col("id").alias("service_id"), F.col("name").alias("service")), "service")
    return own.select("service_id", "service", F.to_timestamp("timestamp").alias("timestamp"), F.coalesce("level", F.lit("INFO")).alias("level"), F.coalesce("message", F.lit("")).alias("message"), "request_id", "trace_id", "latency_ms", "status_code", F.lit(None).cast("struct<host:string,region:string>").alias("metadata"))


def import_truth(rows: DataFrame, known: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Labelled incidents; an unknown root is an error, unknown affected services and ids already present are dropped."""
    named = known.select(F.col("id").alias("root_id"), F.col("name").alias("root_cause_service"))
    own = rows.where("truth_incident_id IS NOT NULL").join(named, "root_cause_service", "left")
    own = own.withColumn("root_id", F.when(F.col("root_id").isNotNull(), F.col("root_id")).otherwise(F.raise_error(F.concat(F.lit("unknown root service "), "root_cause_service"))))
    part = own.select("truth_incident_id", F.explode_outer("affected_services").alias("name")).join(known, "name", "left")
    ids = part.groupBy("truth_incident_id").agg(F.sort_array(F.collect_set("id")).alias("affected_ids"))
    out = own.join(ids, "truth_incident_id")
    return out if present is None else out.join(present.select("truth_incident_id"), "truth_incident_id", "left_anti")


def epoch_seconds(rows: DataFrame, name: str) -> Column:
    """Seconds since 1970 of a time with or without zone; one without is UTC, whatever the session's zone."""
    if rows.schema[name].dataType == T.TimestampNTZType():
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_seconds(name)


def in_range(e: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events from start to end (epoch seconds, both included). The bounds are on ts itself, so that they reach the scan."""
    zoneless = e.schema["ts"].dataType == T.TimestampNTZType()
    bound = lambda s: F.lit(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)).cast("timestamp_ntz") if zoneless else F.timestamp_seconds(F.lit(s))
    if start is not None:
        e = e.where(F.col("ts") >= bound(start))
    return e if end is None else e.where(F.col("ts") < bound(end + 1))


def from_events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The events table, or those from start to end, as logs; times are epoch seconds."""
    return as_logs(in_range(spark.read.parquet(f"{sf_dir}/events.parquet"), start, end))


def as_logs(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as logs."""
    kind, value = F.col("event_type"), F.col("value")
    key = F.get_json_object("props", "$.k")
    ts = epoch_seconds(e, "ts")
    day = F.floor(ts / 86400).cast("string")
    return e.select(
        F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, SERVICES)), (F.pmod("user_id", F.lit(6)) + 1).cast("int")).alias("service"), ts.alias("ts"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "view", "DEBUG").otherwise("INFO").alias("level"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("message"), F.when(kind != "signup", F.col("event_id")).alias("request_id"),
        F.when(kind != "view", F.concat(key, F.lit("-"), day)).alias("trace_id"), F.when(kind != "signup", F.floor(value).cast("int")).alias("latency_ms"),
        F.when(kind == "error", F.when(value >= 20, 500).otherwise(404)).otherwise(200).alias("status_code"),
    )


def filtered(rows: DataFrame, start: int | None = None, end: int | None = None, time: str = "ts", **equal: str | None) -> DataFrame:
    """Optional equality filters, such as service, level, trace_id, metric, detector or severity, and an inclusive time range.

    A level or severity that doesn't exist, or a range that ends before it starts, is an error.
    """
    known = {"level": LEVELS, "severity": SEVERITIES}
    if start is not None and end is not None and end < start:
        raise ValueError("the range ends before it starts")
    for name, value in equal.items():
        if value is not None:
            if name in known and value.upper() not in known[name]:
                raise ValueError(f"{name} must be one of {', '.join(known[name])}")
            rows = rows.where(F.col(name) == (value.upper() if name in ("level", "severity") else value))
    if start is not None:
        rows = rows.where(F.col(time) >= start)
    return rows if end is None else rows.where(F.col(time) <= end)


def by_trace(rows: DataFrame, trace_id: str) -> DataFrame:
    """Logs of a trace in order; a trace without any is an error."""
    own = rows.where(F.col("trace_id") == trace_id)
    if not own.take(1):
        raise LookupError(f"no logs of trace {trace_id}")
    return own.orderBy("ts", "id")


def window_size(seconds: int) -> int:
    """A window size that views accept, from 60 to 300 seconds; others are an error."""
    if not 60 <= seconds <= 300:
        raise ValueError("window size must be from 60 to 300 seconds")
    return seconds


def linked(edges: DataFrame, known: DataFrame, upstream: str, downstream: str) -> DataFrame:
    """edges(upstream, downstream) with one more; an unknown service, a self edge or one that is already there is an error."""
    missing = {upstream, downstream} - {r.name for r in known.where(F.col("name").isin(upstream, downstream)).select("name").distinct().collect()}
    if missing:
        raise ValueError(f"unknown service {', '.join(sorted(missing))}")
    if upstream == downstream:
        raise ValueError("a service can't depend on itself")
    if edges.where((F.col("upstream") == upstream) & (F.col("downstream") == downstream)).take(1):
        raise ValueError("this dependency is already there")
    return edges.unionByName(edges.sparkSession.createDataFrame([(upstream, downstream)], "upstream string, downstream string"))


def page(rows: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, most: int = 1000) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be from 1 to {most} and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)
