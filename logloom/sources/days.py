"""Tables by event day: reads pruned to days and to row groups, writes that replace only the days they touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import dropped, removed, settings, stored

DAY = 86400


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _listed(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The table in path; its days are listed by as many tasks as run at once, and not by one for each day."""
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(spark.sparkContext.defaultParallelism)}):
        return spark.read.schema(schema).parquet(path)


class LogStore:
    """Logs (with ts in epoch seconds) by day and batch; files are sorted by time, so a range of time reads few row groups of few days."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType([*(f for f in schema.fields if f.name not in ("day", "batch")), T.StructField("day", T.LongType()), T.StructField("batch", T.LongType())])

    def append(self, logs: DataFrame, batch: int) -> None:
        """Adds a batch. One that is written again replaces itself.

        Rows are dealt out by day in one pass, without the samples that ranges need; Spark splits a day that is too busy for one
        task and puts quiet ones together.
        """
        own = logs.withColumn("day", F.floor(F.col("ts") / DAY)).withColumn("batch", F.lit(batch).cast("bigint"))
        own = own.hint("rebalance", "day").sortWithinPartitions("day", "ts")
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def read(self, start: int | None = None, end: int | None = None, batch: int | None = None) -> DataFrame:
        """Logs from start to end, both included; only their days are listed, and only row groups in that range are read."""
        try:
            rows = _listed(self.spark, self.schema, self.path)
        except AnalysisException as error:
            if not _absent(error):
                raise
            rows = self.spark.createDataFrame([], self.schema)
        if batch is not None:
            rows = rows.where(F.col("batch") == batch)
        if start is not None:
            rows = rows.where((F.col("day") >= start // DAY) & (F.col("ts") >= start))
        if end is not None:
            rows = rows.where((F.col("day") <= end // DAY) & (F.col("ts") <= end))
        return rows.drop("day", "batch")


class DayTable:
    """A table by day of `time` (epoch seconds). Its content from some time on is replaced as a whole, older days aren't read or written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time: str):
        self.spark, self.path, self.time = spark, path, time
        self.schema = T.StructType([*(f for f in schema.fields if f.name != "day"), T.StructField("day", T.LongType())])

    def _rows(self) -> DataFrame:
        try:
            return _listed(self.spark, self.schema, self.path)
        except AnalysisException as error:
            if not _absent(error):
                raise
            return self.spark.createDataFrame([], self.schema)

    def read(self, since: int | None = None) -> DataFrame:
        rows = self._rows()
        if since is not None:
            rows = rows.where((F.col("day") >= since // DAY) & (F.col(self.time) >= since))
        return rows.drop("day")

    def replace(self, rows: DataFrame, since: int | None = None) -> None:
        """Puts rows in the place of all rows from `since` on (of all rows, where it is None). Doing so again changes nothing.

        New days are written aside first, so that rows may come from the table itself. A failure between two days leaves some
        replaced; the same call made again completes it.
        """
        fresh, whole = rows.withColumn("day", F.floor(F.col(self.time) / DAY)), self._rows()
        if since is not None:
            first = since // DAY
            fresh = fresh.unionByName(whole.where((F.col("day") == first) & (F.col(self.time) < since)))
        fresh = stored(fresh.select(self.schema.names))
        old = whole if since is None else whole.where(F.col("day") >= since // DAY)
        gone = old.select("day").distinct().join(fresh.select("day").distinct(), "day", "left_anti")
        days = [r.day for r in gone.collect()]
        # A number of its own, since few bytes in many days are much work that Spark would give to one task.
        tasks = self.spark.sparkContext.defaultParallelism
        spread = fresh.repartitionByRange(tasks, "day", self.time, F.xxhash64(*self.schema.names)).sortWithinPartitions("day", self.time)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        for day in days:  # days whose rows have all gone
            removed(self.spark, f"{self.path}/day={day}")
        dropped(fresh)
