"""Queries that run as streams over the events table, fed in files as they would come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incidents
from ..sources import logs as src
from ..sources.stages import folder, stored
from ..streaming import ingest, state
from . import queries as q

#: Requests that pass in a window, its length, and days at which a stream is cut into files.
LIMIT, WINDOW, CUTS = 5, 3600, (10, 20)
#: A moment behind all others; a row with that time and no id moves the watermark past every timer.
LATEST = q.DAY0 + 4000 * 86400


def _fed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """One more file of the stream in path, and the stream."""
    rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _beat(rows: DataFrame, time: str) -> DataFrame:
    """A heartbeat: all columns null (arrays empty) but the time."""
    value = lambda f: F.lit(LATEST) if f.name == time else F.array() if f.dataType.typeName() == "array" else F.lit(None)
    return rows.sparkSession.range(1).select([value(f).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def alerts_streamed(spark, d):
    """Alerts of a stream of anomalies in three files; some of the first come late, with the second, and others come again."""
    own = q.stored(q.anomalies(spark, d).drop("metric", "detector", "score"))
    at, delay = F.col("window_start"), max(q.CFG.windows)
    low, high = (q.DAY0 + c * 86400 for c in CUTS)
    held = (at < low) & (at >= low - delay // 2) & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    path, out = folder(spark), folder(spark)
    files = (own.where((at < low) & ~held), own.where(((at >= low) & (at < high)) | ((at < low) & (at >= low - 86400))), own.where(at >= high), _beat(own, "window_start"))
    for rows in files:
        stream = _fed(spark, path, rows)
    got = state.run_to_parquet(state.debounced(stream, q.CFG, delay), out)
    return got.select("alert_id", "service", "anomaly_type", "start", "end", "severity", F.round("observed", 6).alias("observed"), F.round("baseline", 6).alias("baseline"), F.array_join("anomaly_ids", ",").alias("anomaly_ids"))


def incidents_streamed(spark, d):
    """Incidents as keyed state over a stream of alert groups in three files, stopped and started again behind each, all closed in the end."""
    base = q.alerts(spark, d)
    groups = q.stored(incidents.grouped(base, q.pairs(spark, d, base)))
    path, out, adjacent = folder(spark), folder(spark), set(src.EDGES)
    part_of, at = state.parts(spark, adjacent, list(src.SERVICES)), F.col("start")
    low, high = (q.DAY0 + c * 86400 for c in CUTS)
    for rows in (groups.where(at < low), groups.where((at >= low) & (at < high)), groups.where(at >= high).unionByName(_beat(groups, "start"))):
        changes = state.run_to_parquet(state.lifecycle(_fed(spark, path, rows), part_of, adjacent, q.CFG, 0), out)
    return state.current(changes).select("incident_id", "alert_id", "start", "end", "severity", F.array_join("services", ",").alias("services"), "status", "closed_at")


def _requests(spark, d) -> DataFrame:
    return q.logs(spark, d).select(F.col("id").cast("bigint").alias("id"), "ts", F.col("service").alias("identity"))


def rate_decisions(spark, d):
    return state.decisions(_requests(spark, d), LIMIT, WINDOW)


def rate_limit_stream(spark, d):
    """The limiter over a stream of requests: those that passed and those that were turned away, by window and identity."""
    requests = stored(_requests(spark, d))
    stream = spark.readStream.schema(requests.schema).parquet(requests.stored_path)
    got = state.run_to_parquet(state.rate_limited(stream, LIMIT, WINDOW), folder(spark), idle=False)
    return got.groupBy("window_start", "identity_hash").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def ingest_requests(spark, d):
    """Events as requests of 40 (the first one of 1,200), some cut off or empty, through the ingest stream: logs by service and level, and what was refused."""
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    event = F.struct(F.timestamp_seconds("ts").cast("string").alias("timestamp"), "service", "level", "message", uuid.alias("request_id"), "latency_ms", "status_code", F.lit("h1").alias("host"))
    r = F.when(F.col("id") < 1200, F.lit(-1)).otherwise(F.floor(F.col("id") / 40))
    own = q.logs(spark, d).groupBy(r.alias("r")).agg(F.collect_list(event).alias("events"))
    whole = F.to_json(F.struct(F.when(F.col("r") % 30 == 4, F.array().cast(own.schema["events"].dataType)).otherwise(F.col("events")).alias("events")))
    path, out = folder(spark), folder(spark)
    own.select(F.when(F.col("r") % 25 == 3, F.left(whole, F.lit(60))).otherwise(whole).alias("value")).repartition(3).write.text(path)
    ingest.ingest(spark, path, out).awaitTermination()
    sinks = ingest.Ingest(spark, out)
    logs = sinks.store.read().groupBy(F.lit("log").alias("kind"), F.col("level").alias("what"), "service").agg(F.count("*").alias("n"), F.count("metadata").alias("with_metadata"))
    first = F.get("problems", F.lit(0))
    why = F.when(first.startswith("events."), "field").otherwise(first)
    return logs.unionByName(sinks.rejects().groupBy(F.lit("reject").alias("kind"), why.alias("what"), F.lit("").alias("service")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("with_metadata")))


QUERIES = {f.__name__: f for f in (alerts_streamed, incidents_streamed, rate_decisions, rate_limit_stream, ingest_requests)}


def sql() -> dict[str, str]:
    logs = q.SQL["logs_time_range"].split("\nSELECT * FROM logs WHERE")[0]
    decided = f"""{logs} SELECT window_start, identity_hash, least(n, {LIMIT}) AS allowed, greatest(n - {LIMIT}, 0) AS denied FROM (
        SELECT ts - ts % {WINDOW} AS window_start, left(sha256(service), 24) AS identity_hash, count(*) AS n FROM logs GROUP BY 1, 2)"""
    ingested = f"""{logs}, req AS (SELECT *, CASE WHEN id < 1200 THEN -1 ELSE id // 40 END AS r FROM logs),
        j AS (SELECT r, CASE WHEN r % 25 = 3 THEN 'body' WHEN r % 30 = 4 OR count(*) > 1000 THEN 'events' WHEN bool_or(coalesce(latency_ms < 0, false)) THEN 'field' ELSE '' END AS why FROM req GROUP BY r)
        SELECT 'log' AS kind, level AS what, service, count(*) AS n, count(*) AS with_metadata FROM req JOIN j USING (r) WHERE why = '' GROUP BY ALL
        UNION ALL SELECT 'reject', why, '', count(*), CAST(0 AS BIGINT) FROM j WHERE why <> '' GROUP BY ALL"""
    gap = max(q.CFG.close_gap, q.CFG.proximity)
    closed = f"""SELECT *, 'closed' AS status, "end" + {gap} AS closed_at FROM ({q.SQL["incident_members"]})"""
    return {"alerts_streamed": q.SQL["alerts_debounced"], "incidents_streamed": closed, "rate_decisions": decided, "rate_limit_stream": decided, "ingest_requests": ingested}


SQL = sql()
