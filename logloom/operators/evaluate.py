"""Evaluation against labelled incidents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import jaccard, overlap_seconds
from ..sources.stages import stored
from .intervals import bucketed


#: Seconds of the buckets that make joins of times equi-joins.
BUCKET = 6 * 3600


def overlapping(windows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, size, window_start) of windows that overlap one of spans(keys, a, b) with a, b in seconds; b isn't included."""
    own = windows.select(*keys, "size", "window_start").distinct().withColumn("last", F.col("window_start") + F.col("size") - 1)
    own = bucketed(own, "window_start", "last", BUCKET, "bucket")
    long = bucketed(spans.where("a < b").withColumn("last b", F.col("b") - 1), "a", "last b", BUCKET, "bucket")
    hit = own.join(long, [*keys, "bucket"]).where("window_start < b AND window_start + size > a")
    return hit.select(*keys, "size", "window_start").distinct()


def labelled_windows(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: whether a labelled incident of an affected service overlaps the window."""
    spans = truth.select(F.explode("affected").alias("service"), F.col("start_time").alias("a"), F.col("end_time").alias("b"))
    hit = overlapping(windows, spans, ["service"]).withColumn("label", F.lit(1))
    return windows.join(hit, ["service", "size", "window_start"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def confusion(rows: DataFrame, label: str = "label", flag: str = "flag") -> DataFrame:
    """Counts, rates, precision, recall and F1 with zero guards, to four places."""
    y, p = F.col(label) == 1, F.col(flag) == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pr_curve(scored: DataFrame, points: int = 100) -> DataFrame:
    """Precision and recall down the ranking by signed score, about `points` places of it.

    Rows are counted per detector and score first; running counts go over those, and only rows of one score are numbered by id.
    """
    per = scored.groupBy("detector", "score").agg(F.count("*").alias("m"), F.sum("label").alias("l"))
    down = Window.partitionBy("detector").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("detector")
    before = lambda c: F.coalesce(F.sum(c).over(down), F.lit(0))
    per = per.select("detector", "score", before("m").alias("rows_before"), before("l").alias("hits_before"), F.sum("m").over(all_).alias("n"), F.sum("l").over(all_).alias("positives"))
    inside = Window.partitionBy("detector", "score").orderBy("id")
    own = scored.withColumn("k", F.row_number().over(inside)).withColumn("h", F.sum("label").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(per, ["detector", "score"])
    own = own.withColumn("i", F.col("rows_before") + F.col("k")).withColumn("hits", F.col("hits_before") + F.col("h"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    return own.where(F.pmod(F.col("i") - 1, step) == 0).select("detector", F.col("i").cast("bigint").alias("place"), F.round(F.col("hits") / F.col("i"), 4).alias("precision"), F.when(F.col("positives") > 0, F.round(F.col("hits") / F.col("positives"), 4)).otherwise(0.0).alias("recall"))


def interpolated(curve: DataFrame) -> DataFrame:
    """Every detector's precision at every detector's recalls, linear between its own points and clamped at the ends."""
    own = curve.groupBy("detector", "recall").agg(F.max("precision").alias("precision"))
    # The points of all curves, about a hundred for each, are one array that every detector gets.
    points = own.agg(F.collect_set("detector").alias("detectors"), F.collect_set("recall").alias("recalls"))
    each = points.select(F.explode("detectors").alias("detector"), "recalls").select("detector", F.explode("recalls").alias("recall"))
    grid = each.join(own, ["detector", "recall"], "left")
    w = Window.partitionBy("detector").orderBy("recall")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("precision").isNotNull(), F.struct("recall", "precision"))
    g = grid.withColumn("p", point).withColumn("a", F.last("p", True).over(back)).withColumn("b", F.first("p", True).over(ahead))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    g = g.withColumn("a", a).withColumn("b", b)
    t = F.when(F.col("b.recall") > F.col("a.recall"), (F.col("recall") - F.col("a.recall")) / (F.col("b.recall") - F.col("a.recall"))).otherwise(0.0)
    return g.select("detector", "recall", F.round(F.col("a.precision") + t * (F.col("b.precision") - F.col("a.precision")), 4).alias("precision"))


def overlaps(incidents: DataFrame, truth: DataFrame, keys: list[str], minimum: float) -> DataFrame:
    """Pairs of incidents(…, start, end) and truth(…, ts, te) with equal keys that overlap for at least minimum seconds, which is over 0."""
    if minimum <= 0:
        raise ValueError("the least overlap has to be more than 0 seconds")
    a, b = bucketed(incidents, "start", "end", BUCKET, "bucket"), bucketed(truth, "ts", "te", BUCKET, "bucket")
    over = overlap_seconds(F.col("start"), F.col("end"), F.col("ts"), F.col("te"))
    # A pair is kept in the first bucket that both touch.
    first = F.col("bucket") == F.floor(F.greatest("start", "ts") / BUCKET)
    return a.join(b, [*keys, "bucket"]).withColumn("overlap", over).where(first & (F.col("overlap") >= minimum)).drop("bucket")


def match_candidates(incidents: DataFrame, truth: DataFrame, minimum: float) -> DataFrame:
    """Pairs that share a service and overlap long enough, with coverage and Jaccard similarity."""
    t = truth.select("truth_id", F.col("start_time").alias("ts"), F.col("end_time").alias("te"), "affected")
    pairs = overlaps(incidents.withColumn("service", F.explode("services")), t.withColumn("service", F.explode("affected")), ["service"], minimum).drop("service").distinct()
    return pairs.select("incident_id", "truth_id", "overlap", F.round(F.col("overlap") / F.greatest(F.lit(1), F.col("te") - F.col("ts")), 6).alias("coverage"), F.round(jaccard(F.col("services"), F.col("affected")), 6).alias("jaccard"))


def _in_rounds(candidates: DataFrame, certain) -> DataFrame:
    """Pairs taken round by round: certain(rest) gives pairs that the ordered pass would take, and both their sides are out of the next round."""
    candidates = stored(candidates)
    rest, taken = candidates, candidates.limit(0)
    while True:
        part = stored(certain(rest).select(candidates.columns))
        if not part.take(1):
            return taken
        taken = taken.unionByName(part)
        rest = stored(rest.join(part.select("incident_id"), "incident_id", "left_anti").join(part.select("truth_id"), "truth_id", "left_anti").select(candidates.columns))


def _first(by: str, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1


def match_one_to_one(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one matching by coverage, Jaccard, truth id and incident id.

    Rounds of mutual best pairs give the greedy result without an ordered pass: a pair that is the first of both its sides is always taken.
    """
    order = [F.desc("coverage"), F.desc("jaccard"), "truth_id", "incident_id"]
    return _in_rounds(candidates, lambda rest: rest.withColumn("x", _first("incident_id", order)).withColumn("y", _first("truth_id", order)).where("x AND y"))


def match_first_come(incidents: DataFrame, truth: DataFrame, minimum: float) -> DataFrame:
    """Incidents in order of start and id each take the free labelled incident that they overlap longest, whatever its services.

    An incident takes its longest overlap for certain once no earlier one that is still without a match overlaps the same labelled incident.
    """
    t = truth.select("truth_id", F.col("start_time").alias("ts"), F.col("end_time").alias("te"))
    pairs = overlaps(incidents.select("incident_id", "start", "end"), t, [], minimum)
    longest, earliest = [F.desc("overlap"), "truth_id"], ["start", "incident_id"]
    taken = _in_rounds(pairs.select("incident_id", "truth_id", "start", "overlap"), lambda rest: rest.withColumn("x", _first("incident_id", longest)).withColumn("y", _first("truth_id", earliest)).where("x AND y"))
    return taken.select("incident_id", "truth_id", "overlap")


def topk_accuracy(ranked: DataFrame, by: str | None = None) -> DataFrame:
    """Share of incidents whose labelled cause ranks first, or among three; ranked has rank and is_cause."""
    per = ranked.groupBy("incident_id", *([by] if by else [])).agg(F.max(F.when(F.col("is_cause"), (F.col("rank") <= 1).cast("int"))).alias("t1"), F.max(F.when(F.col("is_cause"), (F.col("rank") <= 3).cast("int"))).alias("t3"))
    return per.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("t1", F.lit(0))), 4).alias("top1"), F.round(F.avg(F.coalesce("t3", F.lit(0))), 4).alias("top3"))


#: Upper ends of the Poisson(1) distribution on a scale of 2^32, from its rule.
_POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def bootstrap_interval(rows: DataFrame, value: str, key: Column, by: list[str], resamples: int = 1000) -> DataFrame:
    """by, n, mean and the 95 % interval of the mean of value, from resamples in which each row counts a Poisson(1) number of times.

    That number comes from a hash of (resample, key), so it is the same in any partitioning, and sums of resamples are partial
    aggregates: only one row per resample and group is shuffled from each task.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("v"), key.cast("string").alias("key")).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "resample", "key")), 1, 8), 16, 10).cast("bigint")
    weight = sum((F.when(F.col("drawn") >= t, 1).otherwise(0) for t in _POISSON[1:]), F.when(F.col("drawn") >= _POISSON[0], 1).otherwise(0))
    sums = own.withColumn("drawn", drawn).withColumn("w", weight).groupBy(*by, "resample").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w"))
    means = sums.where("w > 0").groupBy(*by).agg(F.percentile(F.col("s") / F.col("w"), 0.025).alias("low"), F.percentile(F.col("s") / F.col("w"), 0.975).alias("high"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).join(means, by).select(*by, "n", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def require(ok: bool, message: str) -> None:
    if not ok:
        raise AssertionError(message)


# Bounds that a release's figures have to keep.
GATE_LEAST = {"mad_recall": 0.80, "forest_recall": 0.75, "mad_f1": 0.75, "compression": 0.40, "training_n": 10, "held_out_n": 6, "held_out_top1": 0.75, "held_out_top3": 0.90}
GATE_MOST = {"mad_fpr": 0.05, "forest_fpr": 0.08, "compression": 0.90}


# The least that an evaluation has to rest on.
CONTRACT = {"truths": 5, "windows": 100, "mad_anomalies": 1, "forest_anomalies": 1}


def judged(measured: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """name, bound, value and ok for each bound on measured(name, value); a figure that wasn't measured isn't ok."""
    bounds = [(n, "at least", float(b)) for n, b in least.items()] + [(n, "at most", float(b)) for n, b in most.items()]
    own = measured.sparkSession.createDataFrame(bounds, "name string, side string, bound double").join(measured, "name", "left")
    kept = F.when(F.col("side") == "at least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return own.select("name", "side", "bound", "value", F.coalesce(kept, F.lit(False)).alias("ok"))


def gate(measured: DataFrame, least: dict[str, float] = GATE_LEAST | CONTRACT, most: dict[str, float] = GATE_MOST) -> DataFrame:
    """judged(), but a missing or out-of-bounds figure is an error that names it."""
    report = judged(measured, least, most)
    bad = report.where("NOT ok").orderBy("name", "side").collect()
    require(not bad, "; ".join(f"{r.name} is not {r.side} {r.bound:g}" for r in bad))
    return report


def flagged(windows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Adds flag: whether any anomaly lies in the window."""
    keys = anomalies.select("service", "size", "window_start").distinct().withColumn("flag", F.lit(1))
    return windows.join(keys, ["service", "size", "window_start"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, 1)).otherwise(0.0)
