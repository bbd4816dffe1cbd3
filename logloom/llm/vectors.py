"""Shared handling of vector columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (vec_id, embedding) rows with an id whose vector is not null, not empty, not zero and holds finite components only."""
    own = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(~bad & F.exists("embedding", lambda x: x != 0)).distinct()


def lengths(good: DataFrame) -> dict[int, int]:
    """Number of vectors of each length."""
    return {r.dim: r["count"] for r in good.groupBy(F.size("embedding").alias("dim")).count().collect()}
