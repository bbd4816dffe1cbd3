"""Scalar column functions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in rising order, and the names of alert types by metric and direction.
SEVERITIES = ("MEDIUM", "HIGH", "CRITICAL")
TYPES = {("error_rate", 1): "error_rate_spike", ("request_count", -1): "traffic_drop", ("request_count", 1): "traffic_spike", ("p95_latency_ms", 1): "latency_spike"}
#: Fixed value: makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 0.6745


def floor_to(seconds: Column, size: Column | int) -> Column:
    """Epoch seconds floored to a window size."""
    size = F.lit(size) if isinstance(size, int) else size
    return seconds - F.pmod(seconds, size)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """0.6745 (x - median) / mad; null where any is null or mad is 0."""
    return F.when(mad != 0, F.lit(MAD_SCALE) * (x - median) / mad)


def severity(score: Column) -> Column:
    return F.when(F.abs(score) >= 6, "CRITICAL").when(F.abs(score) >= 4, "HIGH").otherwise("MEDIUM")


def forest_severity(score: Column) -> Column:
    return F.when(score >= 0.2, "CRITICAL").when(score >= 0.1, "HIGH").otherwise("MEDIUM")


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 2).when(name == "HIGH", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (rank + 1).cast("int"))


def anomaly_type(metric: Column, score: Column) -> Column:
    out = F.concat(metric, F.lit("_anomaly"))
    for (name, sign), label in TYPES.items():
        out = F.when((metric == name) & (F.signum(score) == sign), label).otherwise(out)
    return out


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def confidence(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def lerp(x: Column, y: Column, t: Column) -> Column:
    """Linear interpolation that keeps the nearer end exact."""
    return F.when(t >= 0.5, y - (y - x) * (1 - t)).otherwise(x + (y - x) * t)
