"""Joins of intervals by time buckets, so that they are equi-joins for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """A row per bucket of `width` that [start, end] touches."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_pairs(rows: DataFrame, keys: list[str], pad: int, width: int) -> DataFrame:
    """Pairs (a, b) of different alerts with equal keys whose intervals come within pad of each other, once each, a before b.

    A pair is kept in the first bucket that both touch, so no distinct is needed.
    """
    left = bucketed(rows.withColumn("until", F.col("end") + pad), "start", "until", width, "bucket")
    right = bucketed(rows.withColumn("until", F.col("end") + pad), "start", "until", width, "bucket")
    a = left.select(*keys, "bucket", *(F.col(c).alias(f"a_{c}") for c in ("alert_id", "service", "start", "end")))
    b = right.select(*keys, "bucket", *(F.col(c).alias(f"b_{c}") for c in ("alert_id", "service", "start", "end")))
    near = (F.col("b_start") <= F.col("a_end") + pad) & (F.col("b_end") >= F.col("a_start") - pad)
    first = F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width)
    before = F.struct("a_start", "a_alert_id") < F.struct("b_start", "b_alert_id")
    return a.join(b, [*keys, "bucket"]).where(near & first & before).drop("bucket")
