"""Queries over the events table seen as logs, with durations stretched by 60 for its sparse traffic."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import severity_rank
from ..operators import alerts as al
from ..operators import detect, evaluate, graph, incidents, rootcause, upsert
from ..operators import windows as win
from ..sources import logs as src
from ..sources.days import LogStore
from ..sources.stages import folder, stored
from ..streaming import windows as live
from . import sql
from .chain import AGGREGATE, STAGES, Chain

CFG = Config().scaled(60)
DAY0 = 1704067200
NOW, RECENT, AS_OF = DAY0 + 29 * 86400, 300 * 60, DAY0 + 31 * 86400
#: Labelled incidents for the evaluation queries: id, root, affected services, start and end in hours from the first day.
TRUTH = [
    ("t1", "payment-service", ["payment-service", "checkout-service", "api-gateway"], 30, 42), ("t2", "auth-service", ["auth-service", "api-gateway"], 100, 112),
    ("t3", "inventory-service", ["inventory-service", "checkout-service", "api-gateway"], 200, 214), ("t4", "notification-service", ["notification-service", "checkout-service", "api-gateway"], 320, 330),
    ("t5", "checkout-service", ["checkout-service", "api-gateway"], 430, 445), ("t6", "api-gateway", ["api-gateway"], 560, 575),
]

#: Types of labelled incidents: those whose root is a service that callers reach first, and the others.
ENTRY, EDGE_TYPE, CORE_TYPE = ("api-gateway", "auth-service"), "entry", "core"
#: Labelled incidents that no ranker is fitted on.
HELD_OUT = ("t5", "t6")


def logs(spark, d, start=None, end=None):
    return src.from_events(spark, d, start, end)


def truth(spark) -> DataFrame:
    rows = [(i, r, a, DAY0 + s * 3600, DAY0 + e * 3600, EDGE_TYPE if r in ENTRY else CORE_TYPE) for i, r, a, s, e in TRUTH]
    return spark.createDataFrame(rows, "truth_id string, root string, affected array<string>, start_time bigint, end_time bigint, type string")


def edges(spark) -> DataFrame:
    return spark.createDataFrame(list(src.EDGES), "upstream string, downstream string")


def windows(spark, d):
    return win.metric_windows(logs(spark, d), CFG)


def based(spark, d):
    return win.baselines(windows(spark, d), CFG)


def anomalies(spark, d):
    return detect.mad_anomalies(based(spark, d), CFG)


def alerts(spark, d):
    return stored(al.debounce(anomalies(spark, d), CFG))


def pairs(spark, d, own=None):
    own = alerts(spark, d) if own is None else own
    return stored(al.duplicates(own, al.same_service_edges(own, CFG).unionByName(al.shared_trace_edges(own, logs(spark, d), CFG)), CFG))


def members(spark, d, own=None):
    own = alerts(spark, d) if own is None else own
    return stored(incidents.cluster(own, pairs(spark, d, own), set(src.EDGES), CFG))


# -- logs ---------------------------------------------------------------------------------------------


def logs_filter_page(spark, d):
    return src.page(src.filtered(logs(spark, d), service="payment-service", level="error"), [F.desc("ts"), F.desc("id")], 50, 10)


def logs_time_range(spark, d):
    return logs(spark, d, DAY0 + 86400, DAY0 + 2 * 86400)


def logs_by_trace(spark, d):
    return src.by_trace(logs(spark, d, DAY0 + 3 * 86400, DAY0 + 4 * 86400 - 1), f"7-{DAY0 // 86400 + 3}")


def log_counts(spark, d):
    """Totals, and the rate of the stretched five minutes before a fixed moment."""
    recent = F.count_if((F.col("ts") > NOW - RECENT) & (F.col("ts") <= NOW))
    return logs(spark, d).agg(F.count("*").alias("total"), F.count_if(win.is_error()).alias("errors"), recent.alias("recent"), F.round(recent / (RECENT // 60), 2).alias("per_minute"))


def logs_validate(spark, d):
    """Events as API payloads, some made invalid by their values, counted by broken fields."""
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    own = logs(spark, d).select(
        F.timestamp_seconds("ts").cast("string").alias("timestamp"), F.when(F.col("id") % 50 != 0, F.col("service")).alias("service"),
        F.when(F.col("id") % 70 == 0, "TRACE").when(F.col("id") % 80 != 0, F.concat(F.lit(" "), "level", F.lit("\t"))).alias("level"),
        F.when(F.col("id") % 60 == 0, F.lit(" \t\n")).otherwise(F.concat(F.lit("  "), "message")).alias("message"), F.when(F.col("id") % 90 == 0, "request 1").otherwise(uuid).alias("request_id"),
        F.when(F.col("id") % 110 == 0, F.col("trace_id")).alias("trace_id"), (F.col("latency_ms") - 5).alias("latency_ms"), "status_code", F.rpad(F.lit("h"), 300, " ").alias("host"), F.lit(None).cast("string").alias("region"))
    good, bad = src.validate(own)
    return good.groupBy(F.lit("").alias("problems")).agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("n")))


def logs_jsonl(spark, d):
    """Events as JSON lines, each 200th cut off in the middle, read and validated: a broken line lacks all required fields."""
    path = folder(spark)
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    line = F.to_json(F.struct(F.timestamp_seconds("ts").cast("string").alias("timestamp"), "service", "level", "message", uuid.alias("request_id"), "latency_ms", "status_code"))
    logs(spark, d).select(F.when(F.col("id") % 200 == 0, F.left(line, F.lit(40))).otherwise(line)).write.text(path)
    good, bad = src.validate(src.read_jsonl(spark, path))
    return good.groupBy("service", "level", F.lit("").alias("problems")).agg(F.count("*").alias("n")).unionByName(bad.groupBy("service", "level", F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("n")))


def logs_import(spark, d):
    """Events of the services known to the lookup, others dropped, counted by level."""
    known = src.services(spark).where("name <> 'auth-service'")
    own = logs(spark, d).select(F.timestamp_seconds("ts").cast("string").alias("timestamp"), "service", F.when(F.col("level") != "DEBUG", F.col("level")).alias("level"), "message", F.col("request_id").cast("string").alias("request_id"), "trace_id", "latency_ms", "status_code", F.lit("h1").alias("host"), F.lit(None).cast("string").alias("region"))
    return src.import_logs(own, known).groupBy("service_id", "level").agg(F.count("*").alias("n"), F.count("metadata").alias("with_metadata"))


def trace_spans(spark, d):
    """Traces that cross services: first and last time, services and errors."""
    got = logs(spark, d).where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("service").alias("services"), F.count_if(win.is_error()).alias("errors"))
    return got.where("services > 1")


# -- windows and anomalies ----------------------------------------------------------------------------

_W = ["service", "size", "window_start", "request_count", "error_count", "error_rate", "p50_latency_ms", "p95_latency_ms", "unique_messages"]


def metric_windows_short(spark, d):
    return windows(spark, d).where(F.col("size") == min(CFG.windows)).select(_W)


def metric_windows_long(spark, d):
    return windows(spark, d).where(F.col("size") == max(CFG.windows)).select(*_W, "closed_at")


def metric_windows_observed(spark, d):
    return win.metric_windows(logs(spark, d), CFG, dense=False).select("service", "size", "window_start", "request_count", "unique_messages")


def watermark_positions(spark, d):
    p = win.positions(logs(spark, d), CFG)
    return p.select("service", "size", (F.col("effective_end") - F.col("size")).alias("last_closed_window_start"), ((F.col("effective_end") - F.col("first")) / F.col("size")).cast("bigint").alias("windows"))


def late_logs(spark, d):
    """Logs that a live run would drop: those in windows closed by a larger time that arrived earlier. Each 97th log arrives 400 places late.

    The largest time before a log is that of the blocks before its block of arrivals or of those before it inside the block.
    """
    own = logs(spark, d).withColumn("place", F.col("id") + F.when(F.col("id") % 97 == 0, 400).otherwise(0)).withColumn("block", F.floor(F.col("place") / 10_000))
    tops = own.groupBy("service", "block").agg(F.max("ts").alias("top"))
    before = Window.partitionBy("service").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("service", "block", F.max("top").over(before).alias("top"))
    inside = Window.partitionBy("service", "block").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("seen", F.max("ts").over(inside)).join(tops, ["service", "block"]).withColumn("seen", F.greatest("seen", "top"))
    size = min(CFG.windows)
    return own.where(F.col("ts") - F.pmod("ts", F.lit(size)) + size <= F.col("seen") - CFG.grace).groupBy("service").agg(F.count("*").alias("late"))


def _chain(spark, d, stages) -> DataFrame:
    """The last of the stages after three batches of logs into a store: each run reads the days behind the one before."""
    chain, every = Chain(spark, folder(spark), CFG, set(src.EDGES)), logs(spark, d)
    store = LogStore(spark, f"{chain.base}/logs", every.schema)
    for k, (start, end) in enumerate(((None, 10), (10, 20), (20, None))):
        store.append(logs(spark, d, start and DAY0 + start * 86400, end and DAY0 + end * 86400 - 1), k)
        got = chain.run(store, stages, number=k)
    return got[stages[-1]]


def windows_resumed(spark, d):
    """Windows of three runs, of which the later ones read only the days behind the windows that are there."""
    return _chain(spark, d, AGGREGATE).select(_W)


def anomalies_page(spark, d):
    """Anomalies of one metric and severity in a range of time, newest first."""
    rows = src.filtered(anomalies(spark, d), DAY0, NOW, "window_start", metric="request_count", severity="high", detector="mad")
    return src.page(rows, [F.desc("window_start"), "id"], 40, 5).select("id", "service", "metric", "window_start", "size", "score", "severity", "anomaly_type")


def baselines_median_mad(spark, d):
    return based(spark, d).select("service", "size", "window_start", *(F.round(f"{m}_{k}", 6).alias(f"{m}_{k}") for m, _ in CFG.floors for k in ("median", "mad")))


def mad_anomalies(spark, d):
    return anomalies(spark, d).withColumn("observed", F.round("observed", 6)).withColumn("baseline", F.round("baseline", 6))


def anomaly_counts(spark, d):
    return anomalies(spark, d).groupBy("anomaly_type", "severity").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).cast("bigint").alias("rank"))


def iforest_anomalies(spark, d):
    return detect.forest_anomalies(windows(spark, d), CFG, truth(spark))


def normal_windows(spark, d):
    return detect.normal_windows(windows(spark, d).where(F.col("size") == max(CFG.windows)), truth(spark)).groupBy("service").agg(F.count("*").alias("n"), F.sum("request_count").alias("requests"))


def upsert_windows(spark, d):
    """Windows of a first run, replaced by a second run over more logs; the closing time of the first run stays."""
    size = [max(CFG.windows)]
    cfg = Config(windows=tuple(size), grace=CFG.grace)
    old = win.metric_windows(logs(spark, d, end=DAY0 + 10 * 86400 - 1), cfg).select("service", "window_start", "request_count", F.lit(1).alias("run"), F.lit(1).alias("first_run"))
    new = win.metric_windows(logs(spark, d, end=DAY0 + 20 * 86400 - 1), cfg).where(F.col("window_start") >= DAY0 + 5 * 86400).select("service", "window_start", "request_count", F.lit(2).alias("run"), F.lit(2).alias("first_run"))
    return upsert.upsert(old, new, ["service", "window_start"], keep_first=("first_run",)).groupBy("service", "run", "first_run").agg(F.count("*").alias("n"), F.sum("request_count").alias("requests"))


# -- alerts and incidents -----------------------------------------------------------------------------


def alerts_debounced(spark, d):
    return alerts(spark, d).select("alert_id", "service", "anomaly_type", "start", "end", "severity", F.round("observed", 6).alias("observed"), F.round("baseline", 6).alias("baseline"), F.array_join("anomaly_ids", ",").alias("anomaly_ids"))


def alerts_page(spark, d):
    """Alerts of one service, newest first."""
    return src.page(src.filtered(alerts(spark, d), service="checkout-service"), [F.desc("start"), "alert_id"], 60).select("alert_id", "service", "anomaly_type", "start", "end", "severity")


def dedup_edges_same_service(spark, d):
    return al.same_service_edges(alerts(spark, d), CFG).select("a", "b")


def dedup_edges_shared_trace(spark, d):
    return al.shared_trace_edges(alerts(spark, d), logs(spark, d), CFG).select("a", "b")


def dedup_pairs(spark, d):
    return pairs(spark, d)


def canonical_alerts(spark, d):
    own = alerts(spark, d)
    return al.canonical(own, pairs(spark, d, own)).select("alert_id", "service", "anomaly_type", "start", "end", "severity")


def alert_detail(spark, d):
    """Each alert with the one it repeats, if any, and those that repeat it."""
    own = alerts(spark, d)
    got = pairs(spark, d, own)
    up, down = got.select(F.col("duplicate").alias("alert_id"), F.col("canonical").alias("duplicate_of")), got.groupBy(F.col("canonical").alias("alert_id")).agg(F.array_join(F.array_sort(F.collect_list("duplicate")), ",").alias("duplicates"))
    return own.select("alert_id", "severity").join(up, "alert_id", "left").join(down, "alert_id", "left")


def dedup_reasons(spark, d):
    return pairs(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def dedup_compression(spark, d):
    own = alerts(spark, d)
    return al.compression(own, pairs(spark, d, own))


def dedup_reconciled(spark, d):
    """Pairs of an earlier run, some with another reason, some missing and some stale, reconciled with those of now, and then once more."""
    now = pairs(spark, d)
    place = F.conv(F.substring(F.md5("duplicate"), 1, 8), 16, 10).cast("bigint") % 10
    before = now.where(place > 0).withColumn("reason", F.when(place == 1, "manual").otherwise(F.col("reason")))
    stale = now.where(place == 2).select(F.concat("canonical", F.lit("|gone")).alias("canonical"), "duplicate", "reason")
    key, path = ["canonical", "duplicate"], folder(spark)
    first, counts = upsert.reconcile(before.unionByName(stale), now, key, f"{path}/1")
    _, again = upsert.reconcile(first, now, key, f"{path}/2")
    return spark.createDataFrame([(k, *(c[s] for s in ("inserted", "updated", "kept", "deleted"))) for k, c in ((1, counts), (2, again))], "run bigint, inserted bigint, updated bigint, kept bigint, deleted bigint")


def seen_edges(spark, d) -> DataFrame:
    return graph.observed_edges(logs(spark, d))


def seen_services(spark, d) -> DataFrame:
    """Services that have logs, with their ids."""
    return logs(spark, d).select(F.col("service").alias("name")).distinct().join(src.services(spark), "name").select("id", "name")


def dependencies_named(spark, d):
    """Calls seen in traces, stored by ids and read with names."""
    known = seen_services(spark, d)
    ids = lambda side: known.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    stored_edges = seen_edges(spark, d).join(ids("upstream"), "upstream").join(ids("downstream"), "downstream").select("upstream_id", "downstream_id")
    return incidents.named_edges(stored_edges, known).select("upstream_id", "downstream_id", "upstream", "downstream")


def graph_closure(spark, d):
    return incidents.closure(seen_edges(spark, d))


def blast_radius(spark, d):
    got = incidents.closure(seen_edges(spark, d)).groupBy("upstream").agg(F.count("*").alias("blast_radius"))
    return seen_services(spark, d).select(F.col("name").alias("service")).join(got.withColumnRenamed("upstream", "service"), "service", "left").select("service", F.coalesce("blast_radius", F.lit(0)).alias("blast_radius"))


def affected_callers(spark, d):
    own = seen_services(spark, d).select(F.col("name").alias("root"), F.col("name").alias("affected"))
    return incidents.closure(seen_edges(spark, d)).select(F.col("reached").alias("root"), F.col("upstream").alias("affected")).unionByName(own)


def incident_members(spark, d):
    return members(spark, d).withColumn("services", F.array_join("services", ","))


def incident_list(spark, d):
    return incidents.summaries(members(spark, d), CFG, AS_OF).withColumn("services", F.array_join("services", ",")).orderBy(F.desc("start"), "incident_id").limit(50)


def incident_timeline(spark, d):
    own = alerts(spark, d)
    return incidents.timeline(members(spark, d, own), own)


def _features(spark, d, base=None, own=None):
    base = alerts(spark, d) if base is None else base
    own = members(spark, d, base) if own is None else own
    return stored(rootcause.features(own, base, incidents.closure(edges(spark)), anomalies(spark, d))), base, own


#: A stored ranker for the queries; tests fit one. On these events without real causes, a fitted one has nothing to learn from.
WEIGHTS = {"is_earliest": 1.25, "earliest_seconds_gap": 0.0001, "blast_radius": 0.3, "upstream_position": 0.45, "anomaly_magnitude": 0.02, "alert_count": 0.15}
INTERCEPT = -2.0


def _stored_ranker(spark):
    """Weights and intercept as read back from a registry."""
    path = folder(spark)
    rootcause.register(spark, path, "ranker", WEIGHTS, INTERCEPT, "2024-01-31")
    return rootcause.load(spark, path, "ranker")


def _ranked(spark, d, base=None, own=None):
    rows, base, own = _features(spark, d, base, own)
    return rootcause.rank(rows, *_stored_ranker(spark))


def _told(ranked):
    return ranked.select("incident_id", "service", F.round("score", 6).alias("score"), "rank", F.array_join(rootcause.top_features(F.col("contributions")), ", ").alias("top_features"))


def rca_features(spark, d):
    return _features(spark, d)[0]


def rca_rank(spark, d):
    return _told(_ranked(spark, d))


def rca_top3(spark, d):
    return _told(_ranked(spark, d).where("rank <= 3"))


def _judged_ranks(spark, rows, own, weights, intercept) -> DataFrame:
    """Ranks of the services of labelled incidents, with split and type of the label."""
    found = evaluate.match_one_to_one(evaluate.match_candidates(incidents.summaries(own, CFG), truth(spark), CFG.min_overlap))
    known = rootcause.labelled(rows, found, truth(spark)).join(truth(spark).select("truth_id", "type"), "truth_id")
    return rootcause.rank(known, weights, intercept).withColumn("split", F.when(F.col("truth_id").isin(*HELD_OUT), "held out").otherwise("training"))


def rca_accuracy(spark, d):
    """Share of labelled incidents whose root ranks first or among three, by split and by type of the label."""
    rows, _, own = _features(spark, d)
    ranked = stored(_judged_ranks(spark, rows, own, *_stored_ranker(spark)))
    by = lambda c: evaluate.topk_accuracy(ranked, c).select(F.lit(c).alias("by"), F.col(c).alias("which"), "n", "top1", "top3")
    return by("split").unionByName(by("type"))


def rca_ablation(spark, d):
    """The same by split, with the stored ranker less one feature each, and whole."""
    rows, _, own = _features(spark, d)
    weights, intercept = _stored_ranker(spark)
    known, got = stored(_judged_ranks(spark, rows, own, weights, intercept).drop("score", "contributions", "rank")), []
    for dropped in (None, *rootcause.FEATURES):
        ranked = rootcause.rank(known, {n: w for n, w in weights.items() if n != dropped}, intercept)
        got.append(ranked.withColumn("dropped", F.lit(dropped or "none")))
    return evaluate.topk_accuracy(functools.reduce(DataFrame.unionByName, got), "dropped")


def incident_labels(spark, d):
    """Services of each incident, the first three by name and how many more; the lookup lacks one service, whose id is shown."""
    return incidents.service_labels(members(spark, d), src.services(spark), src.services(spark).where("name <> 'auth-service'"))


def incidents_overview(spark, d):
    """Of the ten newest incidents: those still active at a fixed moment, and how many services they touch."""
    last = incidents.summaries(members(spark, d), CFG, AS_OF).orderBy(F.desc("start"), "incident_id").limit(10)
    return last.withColumn("service", F.explode_outer("services")).agg(F.count_distinct("incident_id").alias("incidents"), F.count_distinct(F.when(F.col("closed_at").isNull(), F.col("incident_id"))).alias("active"), F.count_distinct("service").alias("impacted"))


def _detail(spark, base, own):
    return incidents.detail(incidents.summaries(own, CFG, AS_OF), own, base)


def incident_detail(spark, d):
    base = alerts(spark, d)
    items = F.transform("alerts", lambda a: F.concat_ws(" ", a["alert_id"], a["end"].cast("string"), a["severity"]))
    return _detail(spark, base, members(spark, d, base)).select("incident_id", "status", "alert_count", "closed_at", F.array_join("services", ",").alias("services"), F.array_join(items, ";").alias("alerts"))


def incident_briefing(spark, d):
    base = alerts(spark, d)
    own = members(spark, d, base)
    got = incidents.briefing(_detail(spark, base, own), _told(_ranked(spark, d, base, own)))
    return got.withColumns({c: F.array_join(c, "\n") for c in ("services", "evidence", "actions")})


def chain_incidents(spark, d):
    """Incidents of a chain of stages that ran over ten days, carried on over ten more and then over the rest."""
    return _chain(spark, d, STAGES).withColumn("services", F.array_join("services", ","))


# -- evaluation ---------------------------------------------------------------------------------------


def _labelled(spark, d):
    own = evaluate.labelled_windows(windows(spark, d).where(F.col("size") == max(CFG.windows)), truth(spark))
    return evaluate.flagged(own, anomalies(spark, d))


def truth_window_labels(spark, d):
    return _labelled(spark, d).groupBy("service", "label", "flag").agg(F.count("*").alias("n"))


def confusion_matrix(spark, d):
    return evaluate.confusion(_labelled(spark, d))


def _scored(spark, d):
    return evaluate.labelled_windows(anomalies(spark, d), truth(spark))


def pr_curve(spark, d):
    return evaluate.pr_curve(_scored(spark, d))


def pr_interpolated(spark, d):
    curves = evaluate.pr_curve(_scored(spark, d).withColumn("detector", F.col("metric")))
    return evaluate.interpolated(curves)


def truth_matches(spark, d):
    return evaluate.match_one_to_one(evaluate.match_candidates(incidents.summaries(members(spark, d), CFG), truth(spark), CFG.min_overlap))


def truth_matches_first_come(spark, d):
    return evaluate.match_first_come(incidents.summaries(members(spark, d), CFG), truth(spark), 2 * CFG.min_overlap)


# -- overview and health ------------------------------------------------------------------------------


def overview_metrics(spark, d):
    """Totals, last-day counts and error share against a fixed moment."""
    now = DAY0 + 29 * 86400
    got = logs(spark, d).agg(F.count("*").alias("total_logs"), F.count_if((F.col("ts") > now - 86400) & (F.col("ts") <= now)).alias("last_day"), F.count_if((F.col("ts") > now - 86400) & (F.col("ts") <= now) & win.is_error()).alias("last_day_errors"), F.count_distinct("service").alias("services"))
    return got.withColumn("error_percent", evaluate.share(F.col("last_day_errors"), F.col("last_day")))


def overview_full(spark, d):
    """All figures of the overview at a fixed moment: logs, rate of the last five minutes, logs and errors of fifteen, services, open incidents."""
    own, last = logs(spark, d), lambda minutes: (F.col("ts") >= NOW - minutes * 3600) & (F.col("ts") <= NOW)  # minutes are stretched by 60
    got = own.agg(
        F.count("*").alias("total_logs"), F.round(F.count_if(last(5)) / 5, 1).alias("recent_events_per_min"), F.count_if(last(15)).alias("queue_depth"),
        F.count_if(last(15) & F.col("level").isin("ERROR", "CRITICAL")).alias("recent_errors"), F.count_distinct("service").alias("total_services"),
    )
    open_ = incidents.summaries(members(spark, d), CFG, NOW).where(F.col("start") <= NOW).agg(F.count_if(F.col("closed_at").isNull()).alias("active_incidents"))
    both = got.unionByName(open_, allowMissingColumns=True)  # two rows, with nulls where the other has figures
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def recall_interval(spark, d):
    """Recall of the detector on labelled windows by service, with a 95 % bootstrap interval."""
    own = _labelled(spark, d).where("label = 1").withColumn("flag", F.col("flag").cast("bigint"))
    return evaluate.bootstrap_interval(own, "flag", F.concat_ws("|", "service", "size", "window_start"), ["service"])


def _measured(spark, d) -> DataFrame:
    """Figures that the gate asks for, as (name, value); those of the forest aren't measured here."""
    base = alerts(spark, d)
    found = stored(pairs(spark, d, base))
    own = members(spark, d, base)
    rows = stored(_labelled(spark, d).select("label", "flag"))
    c = evaluate.confusion(rows)
    ranked = stored(_judged_ranks(spark, _features(spark, d, base, own)[0], own, *_stored_ranker(spark)))
    acc = evaluate.topk_accuracy(ranked, "split")
    wide = lambda df, names: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(v).cast("double") for v in names.values())))).alias("name", "value"))
    parts = [
        wide(c, {"mad_recall": "recall", "mad_fpr": "fpr", "mad_f1": "f1"}), wide(al.compression(base, found).withColumn("share", F.col("percent") / 100), {"compression": "share"}),
        wide(acc.where("split = 'held out'"), {"held_out_n": "n", "held_out_top1": "top1", "held_out_top3": "top3"}), wide(acc.where("split = 'training'"), {"training_n": "n"}),
        wide(truth(spark).agg(F.count("*").alias("n")), {"truths": "n"}), wide(rows.agg(F.count("*").alias("n")), {"windows": "n"}), wide(rows.agg(F.sum("flag").alias("n")), {"mad_anomalies": "n"}),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def quality_gate(spark, d):
    """Each bound of the gate and of what an evaluation rests on, with the figure measured here and whether it is kept."""
    return evaluate.judged(_measured(spark, d), evaluate.GATE_LEAST | evaluate.CONTRACT, evaluate.GATE_MOST)


def service_health(spark, d):
    own = windows(spark, d).where((F.col("service") == "payment-service") & (F.col("size") == min(CFG.windows)) & F.col("window_start").between(DAY0 + 86400, DAY0 + 8 * 86400))
    return own.select(_W).orderBy("window_start").limit(200)


def service_status(spark, d):
    own = windows(spark, d).where(F.col("size") == max(CFG.windows))
    last = own.groupBy("service").agg(F.max(F.struct("window_start", "error_rate", "p95_latency_ms")).alias("w")).select("service", "w.*")
    return last.select("service", "window_start", (F.coalesce("error_rate", F.lit(0.0)) * 100).alias("error_percent"), F.coalesce((F.coalesce("error_rate", F.lit(0.0)) * 100 >= 5) | (F.col("p95_latency_ms") >= 500), F.coalesce("error_rate", F.lit(0.0)) * 100 >= 5).alias("degraded"))


def ingest_rate_limited(spark, d):
    own = logs(spark, d).select(F.timestamp_seconds("ts").alias("timestamp"), F.col("service").alias("identity"))
    return live.over_limit(own, 5, seconds=3600)


def latency_summary(spark, d):
    return logs(spark, d).where("latency_ms IS NOT NULL").groupBy("service").agg(F.round(F.percentile("latency_ms", 0.5), 4).alias("p50"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"), F.round(F.percentile("latency_ms", 0.99), 4).alias("p99"), F.round(F.avg("latency_ms"), 4).alias("mean"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"))


def truth_import(spark, d):
    """Each service's worst half day by errors as a labelled incident with the services that had errors then, from JSON lines, beside two that are there."""
    half = F.floor(F.col("ts") / 43200)
    per = logs(spark, d).where(win.is_error()).groupBy("service", half.alias("half")).agg(F.count("*").alias("n"))
    worst = per.groupBy("service").agg(F.max(F.struct("n", (-F.col("half")).alias("h"))).alias("w")).select("service", (-F.col("w.h")).alias("half"))
    hit = worst.join(per.select(F.col("service").alias("other"), "half"), "half").groupBy("service", "half").agg(F.array_sort(F.collect_set("other")).alias("others"))
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = hit.select(
        F.concat(F.lit("w-"), "service").alias("truth_incident_id"), F.lit("outage").alias("type"), F.lit("training").alias("split"), F.lit("error_rate").alias("affected_metric"),
        iso(F.col("half") * 43200).alias("start_time"), iso((F.col("half") + 1) * 43200).alias("end_time"), F.col("service").alias("root_cause_service"), F.concat("others", F.array(F.lit("unknown-service"))).alias("affected_services"),
    )
    path = folder(spark)
    lines.write.json(path)
    rows = spark.read.schema(src.TRUTH_SCHEMA).json(path)
    present = rows.where("root_cause_service IN ('api-gateway', 'auth-service')")
    got = src.import_truth(rows, src.services(spark), present)
    return got.select("truth_incident_id", "root_id", "start_time", "end_time", F.array_join("affected_ids", ",").alias("affected_ids"))


def stream_windows_append(spark, d):
    return live.run_to_parquet(live.windowed(live.event_stream(spark, d), min(CFG.windows), CFG.grace))


QUERIES = {f.__name__: f for f in (
    logs_filter_page, logs_time_range, logs_by_trace, log_counts, logs_validate, logs_jsonl, logs_import, trace_spans, metric_windows_short, metric_windows_long, metric_windows_observed,
    watermark_positions, late_logs, windows_resumed, anomalies_page, alerts_page, alert_detail, rca_accuracy, baselines_median_mad, mad_anomalies, anomaly_counts, iforest_anomalies, normal_windows, upsert_windows, alerts_debounced, dedup_edges_same_service,
    dedup_edges_shared_trace, dedup_pairs, canonical_alerts, dedup_reasons, dedup_compression, dependencies_named, graph_closure, blast_radius, affected_callers, incident_members,
    incident_list, incident_labels, incidents_overview, incident_detail, chain_incidents, truth_matches_first_come, rca_ablation, incident_timeline, incident_briefing, rca_features, rca_rank, rca_top3, truth_window_labels, confusion_matrix, pr_curve, pr_interpolated, truth_matches,
    overview_metrics, service_health, service_status, ingest_rate_limited, latency_summary, truth_import, stream_windows_append, dedup_reconciled, overview_full, recall_interval, quality_gate,
)}
SQL = sql.build(CFG, DAY0, TRUTH, ENTRY, (EDGE_TYPE, CORE_TYPE), HELD_OUT, WEIGHTS, INTERCEPT)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return mad_anomalies(spark, d)
