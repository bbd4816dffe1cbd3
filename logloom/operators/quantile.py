"""Exact quantiles of continuous values per group, by histograms that close in on the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import lerp
from ..sources.stages import stored


def exact_quantile(rows: DataFrame, by: str, value: str, q: float, bins: int = 1024, few: int = 4096, rounds: int = 64) -> DataFrame:
    """(by, quantile): linear between the two values around rank (n - 1) q, as by sorting all; nulls are left out.

    Each round counts the values between the bounds of a rank in bins (partial counts in each task) and takes the bounds of the bin
    that holds it, until it holds few values, which are ranked, or one. No group is ever gathered or sorted as a whole.
    """
    own = rows.select(by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    spans = own.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("inside"))
    place = (F.col("inside") - 1) * q
    spans = spans.withColumn("t", place - F.floor(place)).withColumn("rank", F.explode(F.array(F.floor(place), F.least(F.floor(place) + 1, F.col("inside") - 1))))
    ranks = stored(spans.distinct().withColumn("below", F.lit(0).cast("bigint")))
    between = F.col("v").between(F.col("low"), F.col("high"))
    for _ in range(rounds):
        wide = ranks.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if not wide.take(1):
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        held = own.join(wide.select(by, "rank", "low", "high"), by).where(between).groupBy(by, "rank", at.alias("bin"))
        held = held.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("inside"))
        upto = F.sum("inside").over(Window.partitionBy(by, "rank").orderBy("bin"))
        held = held.withColumn("upto", upto).join(wide.select(by, "rank", "t", "below"), [by, "rank"])
        held = held.where((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("inside") <= F.col("rank")))
        closer = held.withColumn("below", F.col("below") + F.col("upto") - F.col("inside")).select(ranks.columns)
        ranks = stored(ranks.where((F.col("inside") <= few) | (F.col("low") >= F.col("high"))).unionByName(closer))
    else:
        raise RuntimeError(f"ranks weren't closed in on in {rounds} rounds")
    order = F.row_number().over(Window.partitionBy(by, "rank").orderBy("v")) - 1
    some = own.join(ranks.where("low < high"), by).where(between).withColumn("at", order).where(F.col("at") == F.col("rank") - F.col("below"))
    found = some.select(by, "rank", "t", "v").unionByName(ranks.where("low >= high").select(by, "rank", "t", F.col("low").alias("v")))
    ends = found.groupBy(by).agg(F.min_by("v", "rank").alias("x"), F.max_by("v", "rank").alias("y"), F.first("t").alias("t"))
    return ends.select(by, lerp(F.col("x"), F.col("y"), F.col("t")).alias("quantile"))
