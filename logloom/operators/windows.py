"""Metric windows: one pass over the logs for all sizes, gap-free, with exact percentiles and rolling baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import floor_to, lerp
from ..sources.stages import spread

KEY = ["service", "size", "window_start"]


def is_error() -> Column:
    return F.col("level").isin("ERROR", "CRITICAL") | F.coalesce(F.col("status_code") >= 500, F.lit(False))


def positions(logs: DataFrame, cfg: Config) -> DataFrame:
    """First window and effective end per (service, size): a window is closed when its end is at most that."""
    spans = logs.groupBy("service").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    spans = spans.withColumn("size", F.explode(F.array(*(F.lit(w).cast("bigint") for w in cfg.windows))))
    return spans.select("service", "size", floor_to(F.col("low"), F.col("size")).alias("first"), floor_to(F.col("high") - cfg.grace, F.col("size")).alias("effective_end"))


def percentiles(sized: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles cut to integers. Latencies are counted by value first, so no window is ever gathered."""
    counts = sized.where("latency_ms IS NOT NULL").groupBy(*KEY, "latency_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("latency_ms"))).withColumn("all", F.sum("n").over(w))
    picks = []
    for name, q in qs.items():
        place = (F.col("all") - 1) * q
        low = F.floor(place)
        picks += [F.min(F.when(F.col("upto") > low, F.col("latency_ms"))).cast("double").alias(f"{name}_x"), F.min(F.when(F.col("upto") > F.least(low + 1, F.col("all") - 1), F.col("latency_ms"))).cast("double").alias(f"{name}_y"), F.first(place - low).alias(f"{name}_t")]
    got = run.groupBy(*KEY).agg(*picks)
    return got.select(*KEY, *(lerp(F.col(f"{n}_x"), F.col(f"{n}_y"), F.col(f"{n}_t")).cast("bigint").alias(n) for n in qs))


def resumed(old: DataFrame, logs: DataFrame, cfg: Config) -> DataFrame:
    """old, windows of an earlier run, with those closed since: only logs behind each service's and size's last window are read."""
    since = old.groupBy("service", "size").agg((F.max("window_start") + F.col("size")).alias("since"))
    return old.unionByName(metric_windows(logs, cfg, since=since).select(old.columns))


def metric_windows(logs: DataFrame, cfg: Config, dense: bool = True, since: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Closed windows with counts, error rate, p50, p95 and distinct messages; windows without logs are rows, too.

    since: (service, size, since) where an earlier run ended; windows before that are left out, and so are their logs.
    most: windows of a service and size at most, the earliest ones.
    """
    sized = logs.withColumn("size", F.explode(F.array(*(F.lit(w).cast("bigint") for w in cfg.windows)))).withColumn("window_start", floor_to(F.col("ts"), F.col("size")))
    closed = positions(logs, cfg)
    if since is not None:
        sized = sized.join(since, ["service", "size"], "left").where("since IS NULL OR ts >= since").drop("since")
        closed = closed.join(since, ["service", "size"], "left").withColumn("first", F.coalesce("since", "first")).drop("since")
    if most is not None:
        closed = closed.withColumn("effective_end", F.least("effective_end", F.col("first") + most * F.col("size")))
    got = sized.groupBy(*KEY).agg(F.count("request_id").alias("request_count"), F.count_if(is_error()).alias("error_count"), F.count_distinct("message").alias("unique_messages"))
    got = got.join(percentiles(sized, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}), KEY, "left")
    if dense:
        frame = closed.where("effective_end > first").select("service", "size", F.explode(F.sequence("first", F.col("effective_end") - F.col("size"), "size")).alias("window_start"))
        got = frame.join(got, KEY, "left")
    else:
        got = got.join(closed, ["service", "size"]).where("window_start >= first AND window_start + size <= effective_end").drop("first", "effective_end")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("request_count", "error_count", "unique_messages")}
    got = got.withColumns(zero).withColumn("exact_rate", F.when(F.col("request_count") > 0, F.col("error_count") / F.col("request_count")))
    return got.withColumn("error_rate", F.round("exact_rate", 4)).withColumn("closed_at", F.col("window_start") + F.col("size") + cfg.grace)


def _median(values: Column) -> Column:
    n = F.size(values)
    middle = F.transform(F.array(F.floor((n - 1) / 2), F.floor(n / 2)), lambda k: F.get(values, k.cast("int")))
    return F.when(n > 0, (middle[0] + middle[1]) / 2)


#: Windows of a service and size whose baselines one task takes at once.
_BLOCK = 1000


def baselines(windows: DataFrame, cfg: Config) -> DataFrame:
    """Adds the median and floored median absolute deviation of the preceding windows, for each metric; null with little history.

    A long history is cut into blocks, each with the windows before it that its own ones look back to.
    """
    place = F.row_number().over(Window.partitionBy("service", "size").orderBy("window_start")) - 1
    blocks = F.sequence(F.floor(F.col("place") / _BLOCK), F.floor((F.col("place") + cfg.baseline_windows) / _BLOCK))
    cut = windows.withColumn("place", place).withColumn("block", F.explode(blocks))
    past = Window.partitionBy("service", "size", "block").orderBy("window_start").rowsBetween(-cfg.baseline_windows, -1)
    out = spread(cut, "service", "size", "block").withColumn("history", F.count(F.lit(1)).over(past))
    source = {"request_count": "request_count", "error_rate": "exact_rate", "p95_latency_ms": "p95_latency_ms"}
    for metric, floor in cfg.floors:
        out = out.withColumn("vs", F.sort_array(F.collect_list(F.col(source[metric]).cast("double")).over(past))).withColumn("m", _median(F.col("vs")))
        out = out.withColumn("d", _median(F.sort_array(F.transform("vs", lambda v: F.abs(v - F.col("m"))))))
        ok = F.col("history") >= cfg.min_history
        out = out.withColumn(f"{metric}_median", F.when(ok, F.col("m"))).withColumn(f"{metric}_mad", F.when(ok & F.col("d").isNotNull(), F.greatest("d", F.lit(floor)))).drop("vs", "m", "d")
    return out.where(F.col("block") == F.floor(F.col("place") / _BLOCK)).drop("place", "block")
