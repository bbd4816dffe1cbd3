"""Requests with batches of log events, as JSON lines: a stream with the logs in one sink and what was refused, with its text, in another.

A line is {"events": [...]} with 1 to `most` events. It is taken as a whole or refused as a whole: a line that can't be parsed, has too
few or too many events, or an event that breaks a rule leaves no log. Each sink is written under the number of the micro-batch, so one
that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import append_absent
from ..sources import logs as src
from ..sources.days import LogStore

MOST = 1000
_BROKEN = "_corrupt_record"
#: Logs as ingested; host and region are kept beside.
LOGS = "service_id string, service string, timestamp timestamp, ts bigint, level string, message string, request_id string, trace_id string, latency_ms int, status_code int, metadata struct<host:string,region:string>"
SERVICES = "id string, name string"


def request_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of (value, file), a row per line of the files that come into path."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")


def judged(lines: DataFrame, most: int = MOST) -> DataFrame:
    """lines with events (stripped) and problems: what is wrong with the request, as body, events, or events.<place>.<field>."""
    schema = T.StructType.fromDDL(f"events array<struct<{', '.join(f.replace(' ', ':', 1) for f in src.LOG_SCHEMA.split(', '))}>>, {_BROKEN} string")
    own = lines.withColumn("request", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    field = lambda e: lambda name: src.stripped(e[name]) if name in src.STRINGS else e[name]
    names = [f.split()[0] for f in src.LOG_SCHEMA.split(", ")]
    events = F.transform("request.events", lambda e: F.struct(*(field(e)(n).alias(n) for n in names)))
    own = own.withColumn("events", events)
    each = F.transform("events", lambda e, k: F.transform(src.problems(lambda n: e[n]), lambda p: F.concat(F.lit("events."), k.cast("string"), F.lit("."), p)))
    broken = F.col("request").isNull() | F.col(f"request.{_BROKEN}").isNotNull()
    size = F.coalesce(F.size("events"), F.lit(-1))
    wrong = F.when(broken, F.array(F.lit("body"))).when(~size.between(1, most), F.array(F.lit("events"))).otherwise(F.flatten(each))
    return own.withColumn("problems", wrong).drop("request")


def accepted(requests: DataFrame) -> DataFrame:
    """Logs of the requests without problems; a service's id is made from its name."""
    e = requests.where(F.size("problems") == 0).select(F.explode("events").alias("e")).select("e.*")
    metadata = F.when(F.col("host").isNotNull() | F.col("region").isNotNull(), F.struct("host", "region"))
    at = F.to_timestamp("timestamp")
    own = e.select(F.left(F.sha2("service", 256), F.lit(16)).alias("service_id"), "service", at.alias("timestamp"), F.unix_seconds(at).alias("ts"), "level", "message", "request_id", "trace_id", "latency_ms", "status_code", metadata.alias("metadata"))
    return own


class Ingest:
    """The sinks below a folder: logs by day and batch, services, and rejects by batch."""

    def __init__(self, spark: SparkSession, base: str, most: int = MOST):
        self.spark, self.base, self.most = spark, base.rstrip("/"), most
        self.store = LogStore(spark, f"{self.base}/logs", T.StructType.fromDDL(LOGS))

    def _kept(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def services(self) -> DataFrame:
        return self._kept("services", f"{SERVICES}, batch bigint").drop("batch")

    def rejects(self) -> DataFrame:
        return self._kept("rejects", "value string, file string, problems array<string>, batch bigint")

    def write(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; services that aren't known yet are added, which a repeated batch does once."""
        own = judged(batch, self.most).persist()
        try:
            logs = accepted(own)
            self.store.append(logs, number)
            known = self._kept("services", f"{SERVICES}, batch bigint").where(F.col("batch") != number).select("id", "name")
            named = logs.select(F.col("service_id").alias("id"), F.col("service").alias("name")).distinct()
            new = append_absent(known.limit(0), named.join(known, "id", "left_anti"), ["id"])
            new.write.mode("overwrite").parquet(f"{self.base}/services/batch={number}")
            own.where(F.size("problems") > 0).select("value", "file", "problems").write.mode("overwrite").parquet(f"{self.base}/rejects/batch={number}")
        finally:
            own.unpersist()


def ingest(spark: SparkSession, path: str, base: str, files_per_trigger: int = 1, most: int = MOST, seconds: int | None = None):
    """Runs the stream over what there is in path, or every `seconds`; returns the query."""
    sinks = Ingest(spark, base, most)
    writer = request_lines(spark, path, files_per_trigger).writeStream.foreachBatch(sinks.write).option("checkpointLocation", f"{base}/state")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
