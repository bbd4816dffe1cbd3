"""Anomalies from robust z-scores and from a per-service isolation forest."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import anomaly_type, forest_severity, robust_z, severity
from ..sources.stages import stored
from .evaluate import overlapping
from .quantile import exact_quantile

COLUMNS = ["id", "service", "metric", "window_start", "size", "detector", "score", "observed", "baseline", "severity", "anomaly_type"]


def _identified(rows: DataFrame) -> DataFrame:
    own = F.concat_ws("|", "service", "metric", F.lpad("window_start", 12, "0"), F.lpad("size", 6, "0"), "detector")
    return rows.withColumn("id", own).withColumn("anomaly_type", anomaly_type(F.col("metric"), F.col("score"))).select(COLUMNS)


def mad_anomalies(windows: DataFrame, cfg: Config) -> DataFrame:
    """A row per metric whose |z| reaches the threshold; error rate and latency count upwards only."""
    long = windows.select("service", "size", "window_start", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed"), F.col(f"{m}_median").alias("baseline"), F.col(f"{m}_mad").alias("mad")) for m, _ in cfg.floors))).alias("x")).select("service", "size", "window_start", "x.*")
    z = robust_z(F.col("observed"), F.col("baseline"), F.col("mad"))
    hit = long.withColumn("z", z).where((F.col("z") >= cfg.threshold) | ((F.col("metric") == "request_count") & (F.col("z") <= -cfg.threshold)))
    return _identified(hit.select("service", "metric", "window_start", "size", F.lit("mad").alias("detector"), F.bround("z", 4).alias("score"), "observed", "baseline", severity(F.col("z")).alias("severity")))


FEATURES = ("request_count", "error_rate", "p95_latency_ms", "unique_messages")


def _depth(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int, seed: int) -> list:
    """Isolation trees as nested tuples (feature, cut, left, right) or leaf sizes."""
    rng, n = np.random.default_rng(seed), min(256, len(x))
    most = int(np.ceil(np.log2(max(n, 2))))

    def grow(rows, depth):
        low, high = rows.min(0), rows.max(0)
        able = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(able):
            return len(rows)
        f = int(rng.choice(able))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] <= cut
        return f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    return [grow(x[rng.choice(len(x), n, replace=False)], 0) for _ in range(trees)]


def forest_scores(forest: list, x: np.ndarray, n: int) -> np.ndarray:
    """0 to 1, higher is easier to isolate."""
    total = np.zeros(len(x))

    def walk(node, rows, depth):
        if not len(rows):
            return
        if isinstance(node, int):
            total[rows] += depth + _depth(node)
            return
        f, cut, a, b = node
        left = x[rows, f] <= cut
        walk(a, rows[left], depth + 1)
        walk(b, rows[~left], depth + 1)

    for tree in forest:
        walk(tree, np.arange(len(x)), 0)
    return 2 ** (-total / len(forest) / max(_depth(min(256, n)), 1e-9))


def normal_windows(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """Windows that overlap no labelled incident in time, of whatever service."""
    spans = truth.select(F.col("start_time").alias("a"), F.col("end_time").alias("b"))
    return windows.join(overlapping(windows, spans, []), ["size", "window_start"], "left_anti").select(windows.columns)


SAMPLE = 256


def forests(fit: DataFrame, cfg: Config, trees: int = 100, min_rows: int = 10) -> DataFrame:
    """service, n and forest: trees of a service, each grown on SAMPLE rows drawn from all of its rows in fit. Services with fewer than min_rows have none.

    Rows are drawn in Spark: those with the smallest hashes, SAMPLE for each tree, are a draw from all rows and bound what one task holds.
    """
    drawn = Window.partitionBy("service").orderBy(F.xxhash64("service", "window_start", F.lit(cfg.seed)), "window_start")
    pool = fit.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= SAMPLE * trees)

    def grown(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("place")[list(FEATURES)].to_numpy()
        if len(x) < min_rows:
            return pd.DataFrame({"service": [], "n": [], "forest": []})
        return pd.DataFrame({"service": [f.service.iloc[0]], "n": [len(x)], "forest": [pickle.dumps(grow_forest(x, trees, cfg.seed))]})

    return pool.groupBy("service").applyInPandas(grown, "service string, n bigint, forest binary")


def load_forests(spark, path: str) -> DataFrame:
    """Forests written to path; a path without any is an error."""
    kept = spark.read.schema("service string, n bigint, forest binary").parquet(path)
    if not kept.take(1):
        raise ValueError(f"no forest is stored in {path}")
    return kept


def forest_anomalies(windows: DataFrame, cfg: Config, truth: DataFrame | None = None, contamination: float = 0.05, trees: int = 100, min_rows: int = 10, chunk: int = 50_000, forest: DataFrame | None = None) -> DataFrame:
    """One multivariate row per window of the largest size that the service's forest isolates.

    Forests are fitted on normal windows and kept as a table; windows are scored in chunks of a service beside its forest. The threshold is the
    quantile of the scores of all normal windows. forest: one that was fitted before (load_forests), which is not fitted again.
    """
    size = max(cfg.windows)
    finite = ~F.exists(F.array(*FEATURES), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    own = windows.where(F.col("size") == size).select("service", "size", "window_start", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in FEATURES)).where(finite)
    own = stored(own)
    fit = own if truth is None else normal_windows(own, truth)
    forest = stored(forests(fit, cfg, trees, min_rows)) if forest is None else forest
    chunks = own.groupBy("service").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).join(forest, "service").select("service", "n", "forest", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks")
    parts = stored(own.join(chunks.select("service", "chunks").distinct(), "service").withColumn("chunk", F.pmod(F.xxhash64("window_start"), F.col("chunks")).cast("int")))

    def score(f: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        f = f[["service", "size", "window_start", "request_count", *FEATURES[1:]]]
        if not len(f) or not len(model):
            return f.iloc[:0].assign(raw=0.0)[["service", "size", "window_start", "request_count", "raw"]]
        s = forest_scores(pickle.loads(model.forest.iloc[0]), f[list(FEATURES)].to_numpy(), int(model.n.iloc[0]))
        return f.assign(raw=s)[["service", "size", "window_start", "request_count", "raw"]]

    scored = stored(parts.groupBy("service", "chunk").cogroup(chunks.groupBy("service", "chunk")).applyInPandas(score, "service string, size bigint, window_start bigint, request_count double, raw double"))
    known = stored(scored.join(fit.select("service", "window_start"), ["service", "window_start"], "left_semi").select("service", "raw"))
    cut = exact_quantile(known, "service", "raw", 1 - contamination).withColumnRenamed("quantile", "cut")
    got = scored.join(cut, "service").where("raw > cut").withColumn("score", F.round(F.col("raw") - F.col("cut"), 4))
    return _identified(got.select("service", F.lit("multivariate").alias("metric"), "window_start", "size", F.lit("isolation_forest").alias("detector"), "score", F.col("request_count").alias("observed"), F.lit(0.0).alias("baseline"), forest_severity(F.col("score")).alias("severity")))
