"""Streaming forms: windowed aggregation with a watermark, a rate limiter, and keyed writes per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import upsert
from ..operators.windows import is_error
from ..sources.logs import SERVICES, as_logs
from ..sources.stages import folder, stored


def event_time(rows: DataFrame) -> Column:
    """ts as an instant; a time without zone is UTC, whatever the session's zone."""
    if rows.schema["ts"].dataType == T.TimestampNTZType():
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))
    return F.col("ts")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1, schema=None) -> DataFrame:
    """The events table as a stream of logs with a timestamp column; schema: of files that aren't there yet."""
    raw = spark.readStream.schema(schema or spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet")
    kind = F.col("event_type")
    name = F.element_at(F.array(*map(F.lit, SERVICES)), (F.pmod("user_id", F.lit(6)) + 1).cast("int"))
    return raw.select(
        event_time(raw).alias("timestamp"), name.alias("service"), F.when(kind != "signup", F.col("event_id")).alias("request_id"), F.col("user_id"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"), F.when((kind == "error") & (F.col("value") >= 20), 500).otherwise(200).alias("status_code"),
    )


def log_stream(spark: SparkSession, sf_dir: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files of events as they come, as logs."""
    return as_logs(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet"))


def windowed(stream: DataFrame, size: int, grace: int) -> DataFrame:
    """Counts and errors per service and tumbling window. A window is emitted once the watermark (of the whole query) passes its end; later logs are dropped."""
    own = stream.withWatermark("timestamp", f"{grace} seconds").groupBy("service", F.window("timestamp", f"{size} seconds").alias("w"))
    got = own.agg(F.count("request_id").alias("request_count"), F.count_if(is_error()).alias("error_count"))
    return got.select("service", F.unix_seconds("w.start").alias("window_start"), F.lit(size).cast("bigint").alias("size"), "request_count", "error_count")


def run_to_parquet(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Drains a stream in append mode into parquet and reads it."""
    spark = stream.sparkSession
    base = out or folder(spark)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


class Table:
    """A keyed table that micro-batches write to: each version is a stored table, and a repeated batch changes nothing."""

    def __init__(self, keys: list[str]):
        self.keys, self.rows = keys, None

    def write(self, batch: DataFrame, number: int) -> None:
        self.rows = stored(batch if self.rows is None else upsert(self.rows, batch, self.keys))


def live(stream: DataFrame, table, out: str | None = None, seconds: int | None = None):
    """Writes each micro-batch into the table (a Table, or the chain of stages), every `seconds` or until what there is is done.

    A batch is repeated whole after a failure. Streams without an aggregation come in append mode.
    """
    writer = stream.writeStream.outputMode("append" if hasattr(table, "run") else "update").foreachBatch(table.write).option("checkpointLocation", f"{out or folder(stream.sparkSession)}/state")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def over_limit(requests: DataFrame, limit: int, time: str = "timestamp", identity: str = "identity", seconds: int = 60) -> DataFrame:
    """Identities with more requests than the limit in a tumbling window; identities are hashed. Works on streams and batches."""
    own = requests.withColumn("identity_hash", F.left(F.sha2(F.col(identity).cast("string"), 256), F.lit(24)))
    got = own.groupBy(F.window(time, f"{seconds} seconds").alias("w"), "identity_hash").agg(F.count("*").alias("requests")).where(F.col("requests") > limit)
    return got.select(F.unix_seconds("w.start").alias("window_start"), "identity_hash", "requests")
