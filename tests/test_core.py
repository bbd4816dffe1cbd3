import datetime
import hashlib
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.config import Config
from logloom.functions import scalar
from logloom.operators import alerts, detect, evaluate, graph, incidents, rootcause, upsert, windows
from logloom.operators.quantile import exact_quantile
from logloom.sources import logs as src

LOG = "id bigint, service string, ts bigint, level string, message string, request_id bigint, trace_id string, latency_ms int, status_code int"
ANOMALY = "id string, service string, anomaly_type string, window_start bigint, size bigint, severity string, observed double, baseline double"
CFG = Config()


def alert_rows(spark, rows):
    return spark.createDataFrame([(i, s, k, a, b, sev, 1.0, 0.0, [f"n{i}"]) for i, s, k, a, b, sev in rows], alerts.ALERT)


def test_z_score(spark):
    z = spark.range(1).select(scalar.robust_z(F.lit(500.0), F.lit(100.0), F.lit(20.0)), scalar.robust_z(F.lit(500.0), F.lit(100.0), F.lit(0.0))).first()
    assert z[0] == pytest.approx(13.49) and z[1] is None


def test_types(spark):
    rows = spark.createDataFrame([("error_rate", 5.0), ("request_count", -3.0), ("p95_latency_ms", 4.5), ("multivariate", 1.0)], "m string, s double")
    assert [r[0] for r in rows.select(scalar.anomaly_type(F.col("m"), F.col("s"))).collect()] == ["error_rate_spike", "traffic_drop", "latency_spike", "multivariate_anomaly"]


def test_window_metrics_and_gaps(spark):
    rows = [(1, "a", 10, "INFO", "x", 1, None, 100, 200), (2, "a", 20, "ERROR", "y", 2, None, 500, 500), (3, "a", 30, "INFO", "x", 3, None, 200, None), (4, "a", 1000, "INFO", "z", 4, None, None, 200)]
    got = {r.window_start: r for r in windows.metric_windows(spark.createDataFrame(rows, LOG), Config(windows=(60,))).collect()}
    w = got[0]
    assert (w.request_count, w.error_count, w.p50_latency_ms, w.p95_latency_ms, w.unique_messages) == (3, 1, 200, 470, 2) and w.error_rate == 0.3333
    assert sorted(got) == list(range(0, 660, 60)) and got[60].request_count == 0 and got[60].error_rate is None


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    values = {k: rng.integers(0, 300, int(rng.integers(1, 40))).tolist() for k in range(60)}
    rows = spark.createDataFrame([("s", 60, k, v) for k, vs in values.items() for v in vs], "service string, size bigint, window_start bigint, latency_ms int")
    got = {r.window_start: (r.p50, r.p95) for r in windows.percentiles(rows, {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {k: (int(np.percentile(v, 50)), int(np.percentile(v, 95))) for k, v in values.items()}


def test_baselines_need_history(spark):
    rows = spark.createDataFrame([("a", 60, 60 * i, c, None, None) for i, c in enumerate([10, 20, 30, 40])], "service string, size bigint, window_start bigint, request_count bigint, exact_rate double, p95_latency_ms bigint")
    got = {r.window_start: r for r in windows.baselines(rows, CFG).collect()}
    assert got[120].request_count_median is None and got[180].request_count_median == 20 and got[180].request_count_mad == 10 and got[180].error_rate_mad is None


def test_debounce(spark):
    rows = [(f"n{i}", "a", "latency_spike", 60 * i, 60, "HIGH", float(i), 0.0) for i in range(3)] + [("n9", "a", "latency_spike", 3000, 60, "CRITICAL", 9.0, 0.0)]
    got = sorted(alerts.debounce(spark.createDataFrame(rows, ANOMALY), CFG).collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.severity, len(r.anomaly_ids)) for r in got] == [(0, 180, "HIGH", 3), (3000, 3060, "CRITICAL", 1)] and got[0].observed == 0.0


def test_dedup_components(spark):
    own = alert_rows(spark, [(f"a{m}", "s", "latency_spike", 60 * m, 60 * m + 60, "HIGH") for m in (0, 4, 8)])
    pairs = alerts.duplicates(own, alerts.same_service_edges(own, CFG).unionByName(alerts.same_service_edges(own, CFG).limit(0)), CFG).collect()
    assert {(p.canonical, p.duplicate) for p in pairs} == {("a0", "a4"), ("a0", "a8")}


def test_span_is_bounded(spark):
    own = alert_rows(spark, [(f"a{m:02}", "s", "latency_spike", 60 * m, 60 * m + 60, "HIGH") for m in range(0, 40, 4)])
    pairs = alerts.duplicates(own, alerts.same_service_edges(own, CFG), CFG).collect()
    at = {f"a{m:02}": (60 * m, 60 * m + 60) for m in range(0, 40, 4)}
    assert all(at[p.duplicate][1] - at[p.canonical][0] <= CFG.dedup_span for p in pairs) and len(pairs) >= 6


def test_shared_traces_and_incident(spark):
    own = alert_rows(spark, [("a1", "checkout-service", "latency_spike", 0, 60, "HIGH"), ("a2", "payment-service", "error_rate_spike", 30, 90, "CRITICAL")])
    logs = spark.createDataFrame([(1, "checkout-service", 10, "INFO", "m", 1, "t", 5, 200), (2, "payment-service", 90, "INFO", "m", 1, "t", 5, 200)], LOG)
    pairs = alerts.duplicates(own, alerts.shared_trace_edges(own, logs, CFG), CFG)
    assert [tuple(r) for r in pairs.collect()] == [("a1", "a2", "shared_trace_id")]
    got = incidents.cluster(own, pairs, set(src.EDGES), CFG).collect()
    assert len({r.incident_id for r in got}) == 1 and len(got) == 2 and got[0].severity == "CRITICAL" and got[0].services == ["checkout-service", "payment-service"]


def test_graph(spark):
    got = {}
    for r in incidents.closure(spark.createDataFrame(list(src.EDGES), "upstream string, downstream string")).collect():
        got.setdefault(r.upstream, set()).add(r.reached)
    assert {k: len(v) for k, v in got.items()} == {"api-gateway": 5, "checkout-service": 3}
    cycle = incidents.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "upstream string, downstream string")).collect()
    assert {tuple(r) for r in cycle} == {("a", "b"), ("b", "a")}


def test_root_cause_features(spark):
    own = spark.createDataFrame([("p", "payment-service", "error_rate_spike", 0, 60, "HIGH", 1.0, 0.0, ["n1"]), ("c", "checkout-service", "latency_spike", 60, 120, "HIGH", 1.0, 0.0, [])], alerts.ALERT)
    members = spark.createDataFrame([("i", "p"), ("i", "c")], "incident_id string, alert_id string")
    reach = incidents.closure(spark.createDataFrame(list(src.EDGES), "upstream string, downstream string"))
    anomalies = spark.createDataFrame([("n1", "mad", 8.0)], "id string, detector string, score double")
    got = {r.service: r for r in rootcause.features(members, own, reach, anomalies).collect()}
    p = got["payment-service"]
    assert (p.is_earliest, p.earliest_seconds_gap, p.anomaly_magnitude, p.alert_count) == (1, 60, 8, 1) and got["checkout-service"].upstream_position == 1


def test_training_contract(spark):
    rows = spark.createDataFrame([(1.0,) * 6 + (1,)], ", ".join(f"{n} double" for n in rootcause.FEATURES) + ", label int")
    with pytest.raises(ValueError, match="at least 10 service candidates"):
        rootcause.train(rows)


def test_ranker_fits(spark):
    rng = np.random.default_rng(1)
    data = [(float(y), *rng.normal(y, 1, 5).tolist(), int(y)) for y in (0, 1) for _ in range(20)]
    model = rootcause.train(spark.createDataFrame(data, ", ".join(f"{n} double" for n in rootcause.FEATURES) + ", label int"))
    assert model.coefficients[0] > 0


def test_matching_is_one_to_one(spark):
    c = spark.createDataFrame([("i1", "t1", 60, 0.9, 0.5), ("i1", "t2", 60, 0.8, 0.5), ("i2", "t1", 60, 0.7, 0.5), ("i2", "t2", 60, 0.1, 0.1)], "incident_id string, truth_id string, overlap bigint, coverage double, jaccard double")
    assert {(r.incident_id, r.truth_id) for r in evaluate.match_one_to_one(c).collect()} == {("i1", "t1"), ("i2", "t2")}


def test_interpolation(spark):
    c = spark.createDataFrame([("m", 0.2, 1.0), ("m", 0.8, 0.7), ("f", 0.4, 0.9), ("f", 1.0, 0.5)], "detector string, recall double, precision double")
    got = {(r.detector, r.recall): r.precision for r in evaluate.interpolated(c).collect()}
    assert got[("m", 0.4)] == 0.9 and got[("f", 0.8)] == 0.6333 and got[("f", 0.2)] == 0.9


def test_bootstrap_interval(spark):
    """Against the same hashes in plain Python, in any partitioning."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 2}", k, int(rng.random() < 0.7)) for k in range(60)]
    ends = np.cumsum([np.exp(-1.0) / factorial(j) for j in range(12)]) * 2**32
    frame = spark.createDataFrame(rows, "service string, k int, hit int")
    for parts in (1, 5):
        got = {r.service: r for r in evaluate.bootstrap_interval(frame.repartition(parts), "hit", F.col("k"), ["service"], 200).collect()}
        for s in ("s0", "s1"):
            own, means = [r for r in rows if r[0] == s], []
            for b in range(200):
                w = [int(sum(int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:8], 16) >= e for e in ends)) for _, k, _ in own]
                means.append(np.dot(w, [r[2] for r in own]) / sum(w))
            assert (got[s].low, got[s].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=2e-6)
            assert got[s].n == 30 and got[s].low < got[s].mean < got[s].high


@pytest.mark.parametrize("few", [4096, 3])
def test_exact_quantile(spark, few):
    rng = np.random.default_rng(few)
    groups = {"normal": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([2.5]), "same": np.full(50, -1.0), "wide": np.r_[rng.normal(size=200) * 1e-9, 1e9, -1e9], "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.0, 0.31, 0.95, 1.0):
        got = {r.g: r.quantile for r in exact_quantile(frame, "g", "v", q, bins=16, few=few).collect()}
        assert got == pytest.approx({g: float(np.percentile(vs, 100 * q)) for g, vs in groups.items()}, rel=1e-12, abs=1e-18)
    assert exact_quantile(frame.limit(0), "g", "v", 0.5).count() == 0


def test_plans_join_by_keys(spark):
    """Labels meet windows and incidents in buckets of time, without nested loops or products."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    win_ = spark.createDataFrame([("a", 60, 0, 1.0), ("a", 60, 86_340, 1.0), ("b", 60, 600, 1.0), ("c", 3600, 80_000, 1.0)], "service string, size bigint, window_start bigint, request_count double")
    truth = spark.createDataFrame([("t", "a", ["a", "b"], 59, 86_400), ("u", "c", ["c"], 10**6, 10**6)], "truth_id string, root string, affected array<string>, start_time bigint, end_time bigint")
    labelled, normal = evaluate.labelled_windows(win_, truth), detect.normal_windows(win_, truth.where("truth_id = 'u'"))
    assert sorted((r.service, r.window_start, r.label) for r in labelled.collect()) == [("a", 0, 1), ("a", 86_340, 1), ("b", 600, 1), ("c", 80_000, 0)]
    assert normal.count() == 4 and detect.normal_windows(win_, truth).count() == 0
    inc = spark.createDataFrame([("i", 0, 100_000, ["a"])], "incident_id string, start bigint, end bigint, services array<string>")
    found = evaluate.match_candidates(inc, truth, 30)
    curve = spark.createDataFrame([("x", 0.1, 0.5), ("y", 0.2, 0.5)], "detector string, recall double, precision double")
    assert found.count() == 1
    for df in (labelled, normal, found, evaluate.interpolated(curve)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df) and "Join Cross" not in plan(df)
    with pytest.raises(ValueError, match="more than 0"):
        evaluate.match_candidates(inc, truth, 0)


def test_edges_seen_in_traces(spark):
    logs = spark.createDataFrame([("t1", "a", 1, 1), ("t1", "b", 2, 2), ("t1", "b", 3, 3), ("t1", "c", 4000, 4), ("t2", "b", 1, 5), ("t2", "a", 2, 6), ("t2", "b", 3, 7), (None, "c", 5, 8), (None, "a", 6, 9)], "trace_id string, service string, ts bigint, id bigint")
    assert [tuple(r) for r in graph.observed_edges(logs).collect()] == [("a", "b", 2)]


def test_parameters(spark):
    rows = spark.createDataFrame([("ERROR", "HIGH", 1, "t")], "level string, severity string, ts bigint, trace_id string").withColumn("id", F.col("ts"))
    assert src.filtered(rows, 0, 5, level="error", severity="high").count() == 1 and src.by_trace(rows, "t").count() == 1
    for bad in ({"level": "TRACE"}, {"severity": "LOW"}, {"start": 5, "end": 4}):
        with pytest.raises(ValueError):
            src.filtered(rows, **bad)
    with pytest.raises(LookupError, match="no logs"):
        src.by_trace(rows, "x")
    assert src.window_size(60) == 60
    for bad in (59, 301):
        with pytest.raises(ValueError):
            src.window_size(bad)


def test_validation(spark):
    ok = ("2024-01-01T00:00:00Z", " a ", "INFO", "m", None, None, 1, 200, None, None)
    rows = spark.createDataFrame([ok, ok[:2] + ("TRACE",) + ok[3:], ok[:6] + (-1,) + ok[7:]], src.LOG_SCHEMA)
    good, bad = src.validate(rows)
    assert [r.service for r in good.collect()] == ["a"] and sorted(r.problems[0] for r in bad.collect()) == ["latency_ms", "level"]


def test_truth_import(spark):
    rows = spark.createDataFrame([("t", "x", "training", "m", "0", "1", "nobody", [])], src.TRUTH_SCHEMA)
    with pytest.raises(Exception, match="unknown root service"):
        src.import_truth(rows, src.services(spark)).collect()


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, first int")
    new = spark.createDataFrame([("b", 3, 9), ("c", 4, 9)], "k string, v int, first int")
    once = upsert.upsert(old, new, ["k"], ("first",))
    assert sorted(map(tuple, once.collect())) == [("a", 1, 1), ("b", 3, 2), ("c", 4, 9)] == sorted(map(tuple, upsert.upsert(once, new, ["k"], ("first",)).collect()))
    assert {r.k: r.state for r in upsert.reconciled(old, new, ["k"]).collect()} == {"a": "deleted", "b": "updated", "c": "inserted"}
    first, counts = upsert.reconcile(old, new, ["k"], f"{tmp_path}/1")
    again, none = upsert.reconcile(first, new, ["k"], f"{tmp_path}/2")
    assert counts == {"inserted": 1, "updated": 1, "kept": 0, "deleted": 1} and none == {"inserted": 0, "updated": 0, "kept": 2, "deleted": 0}
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == sorted(map(tuple, new.select(first.columns).collect()))


def test_forest_finds_an_outlier(spark):
    rng = np.random.default_rng(2)
    rows = [("a", 300, 300 * i, int(rng.integers(90, 110)), 0.01, 100, 5) for i in range(200)] + [("a", 300, 60000, 1000, 0.9, 5000, 90)]
    got = detect.forest_anomalies(spark.createDataFrame(rows, "service string, size bigint, window_start bigint, request_count bigint, error_rate double, p95_latency_ms bigint, unique_messages bigint"), CFG).collect()
    assert 60000 in {r.window_start for r in got} and len(got) < 25


def test_stream_matches_batch(spark, tmp_path):
    from logloom.streaming import windows as live

    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=i), i % 6, "error" if i % 7 == 0 else "view", 30.0, '{"k": 1}') for i in range(600)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = live.windowed(live.event_stream(spark, str(tmp_path)), 3600, 300)
    logs = src.from_events(spark, str(tmp_path))
    own = logs.groupBy("service", (F.col("ts") - F.pmod("ts", F.lit(3600))).alias("window_start")).agg(F.count("request_id").alias("request_count"), F.count_if(windows.is_error()).alias("error_count"))
    end = logs.agg(F.max("ts")).first()[0] - 300
    expected = {tuple(r) for r in own.where(F.col("window_start") + 3600 <= end).collect()}
    got = live.run_to_parquet(stream).select("service", "window_start", "request_count", "error_count").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 50


def test_micro_batches_write_by_key(spark, tmp_path):
    from logloom.streaming import windows as live

    base = datetime.datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = [(i, base + datetime.timedelta(minutes=i), i % 6, "view", 30.0, '{"k": 1}') for i in range(300)]
    table = live.Table(["service", "window_start", "size"])
    for k in range(2):
        spark.createDataFrame(rows[150 * k : 150 * (k + 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/events{k}.parquet")
    stream = live.windowed(live.event_stream(spark, str(tmp_path), schema=schema), 3600, 0)
    live.live(stream, table, f"{tmp_path}/at").awaitTermination()
    assert table.rows.count() == table.rows.select("service", "window_start").distinct().count() == 30
    table.write(table.rows, 9)
    assert sum(r.request_count for r in table.rows.collect()) == 300


def test_resumed_run_equals_a_whole_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], int(t), "INFO", f"m{i % 5}", i, None, int(rng.integers(1, 99)), 200) for i, t in enumerate(np.sort(rng.integers(0, 20_000, 800)))]
    logs = spark.createDataFrame(rows, LOG)
    whole = windows.metric_windows(logs, CFG)
    names = ["service", "size", "window_start", "request_count", "p95_latency_ms", "unique_messages"]
    old = windows.metric_windows(logs.where("ts < 9000"), CFG).select(names)
    assert sorted(map(tuple, windows.resumed(old, logs, CFG).collect())) == sorted(map(tuple, whole.select(names).collect()))


def test_registry(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(float(y), *rng.normal(y, 1, 5).tolist(), int(y)) for y in (0, 1) for _ in range(20)]
    model = rootcause.train(spark.createDataFrame(data, ", ".join(f"{n} double" for n in rootcause.FEATURES) + ", label int"))
    rootcause.save(spark, f"{tmp_path}/models", "ranker", model, "2024-01-02")
    weights, intercept = rootcause.load(spark, f"{tmp_path}/models", "ranker")
    assert [weights[n] for n in rootcause.FEATURES] == pytest.approx(model.coefficients.toArray().tolist()) and intercept == model.intercept
    with pytest.raises(ValueError, match="no model named other"):
        rootcause.load(spark, f"{tmp_path}/models", "other")


def test_absent_rows_are_added_once(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    once = upsert.append_absent(old, new, ["k"])
    assert sorted(map(tuple, upsert.append_absent(once, new, ["k"]).collect())) == [("a", 1), ("b", 2)]
