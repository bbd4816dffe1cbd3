"""The chain of stages, first-come matching against an ordered pass, briefings and stored forests."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.config import Config
from logloom.operators import alerts, detect, evaluate, incidents
from logloom.plans.chain import AGGREGATE, PROCESS, STAGES, Chain
from logloom.sources import logs as src
from logloom.streaming import windows as live

CFG = Config(windows=(600, 3600))
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(n=4000, hours=60):
    rng, base = np.random.default_rng(5), datetime.datetime(2024, 1, 1)
    at = np.sort(rng.integers(0, hours * 3600, n))
    burst = (at > 30 * 3600) & (at < 32 * 3600)
    return [(i, base + datetime.timedelta(seconds=int(t)), int(rng.integers(0, 6)), "error" if b or rng.random() < 0.02 else "purchase", 500.0 if b else 30.0, f'{{"k": {int(rng.integers(0, 9))}}}') for i, (t, b) in enumerate(zip(at, burst))]


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(events(), EVENT).write.parquet(f"{path}/events.parquet")
    return src.from_events(spark, path)


@pytest.fixture(scope="module")
def whole(spark, logs, tmp_path_factory):
    return Chain(spark, str(tmp_path_factory.mktemp("whole")), CFG, set(src.EDGES)).run(logs)


def test_chain_carried_on_equals_a_whole_run(spark, logs, whole, tmp_path):
    cut = logs.agg(F.min("ts")).first()[0] + 31 * 3600
    chain = Chain(spark, f"{tmp_path}/parts", CFG, set(src.EDGES))
    first = chain.run(logs.where(F.col("ts") < cut), number=0)
    assert 0 < first["windows"].count() < whole["windows"].count() and whole["incidents"].count() > 0
    last = chain.run(logs, number=1)
    for stage in STAGES:
        assert rows(last[stage]) == rows(whole[stage]), stage
    assert rows(chain.run(logs.limit(0), number=1)["incidents"]) == rows(whole["incidents"])  # a run repeated under its number


def test_chain_in_two_runs_and_a_failed_one(spark, logs, whole, tmp_path):
    chain = Chain(spark, str(tmp_path), CFG, set(src.EDGES))
    assert chain.table("windows") is None
    chain.run(logs, AGGREGATE)
    assert chain.table("incidents") is None and chain.table("windows").count() > 0
    got = chain.run(logs, PROCESS)
    assert rows(got["incidents"]) == rows(whole["incidents"])
    before = rows(chain.table("windows"))
    broken = logs.withColumn("ts", F.when(F.col("id") >= 0, F.raise_error(F.lit("no more"))).cast("bigint"))
    with pytest.raises(Exception, match="no more"):
        chain.run(broken)
    assert rows(chain.table("windows")) == before
    with pytest.raises(ValueError, match="unknown stage"):
        chain.run(logs, ("window",))


def test_chain_of_micro_batches(spark, whole, tmp_path):
    data = events()
    for k in range(2):
        spark.createDataFrame(data[2000 * k : 2000 * (k + 1)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/events{k}.parquet")
    chain = Chain(spark, f"{tmp_path}/chain", CFG, set(src.EDGES))
    live.live(live.log_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENT).schema), chain, f"{tmp_path}/at").awaitTermination()
    for stage in STAGES:
        assert rows(chain.table(stage)) == rows(whole[stage]), stage


@pytest.mark.parametrize("seed", range(3))
def test_first_come_matching(spark, seed):
    rng = np.random.default_rng(seed)
    inc = [(f"i{k}", int(a), int(a + rng.integers(0, 300)), ["a"]) for k, a in enumerate(rng.integers(0, 900, 12))]
    truth = [(f"t{k}", "a", ["b"], int(a), int(a + rng.integers(1, 300))) for k, a in enumerate(rng.integers(0, 900, 8))]
    used, expected = set(), []
    for i, a, b, _ in sorted(inc, key=lambda r: (r[1], r[0])):
        best = max(((min(b, e) - max(a, s), [-ord(c) for c in t], t) for t, _, _, s, e in truth if t not in used), default=(0, [], None))
        if best[0] >= 60:
            used.add(best[2])
            expected.append((i, best[2], best[0]))
    got = evaluate.match_first_come(spark.createDataFrame(inc, "incident_id string, start bigint, end bigint, services array<string>"), spark.createDataFrame(truth, "truth_id string, root string, affected array<string>, start_time bigint, end_time bigint"), 60)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def two_incidents(spark):
    base = spark.createDataFrame([("A1", "b", "latency_spike", 3600, 3660, "HIGH", 9.0, 1.0, ["n1"]), ("A2", "a", "traffic_drop", 3720, 3780, "MEDIUM", 1.0, 9.0, ["n2"]), ("A3", "c", "traffic_drop", 9000, 9060, "CRITICAL", 1.0, 9.0, ["n3"])], alerts.ALERT)
    own = spark.createDataFrame([("I1", "A1", 3600, 3780, "HIGH", ["a", "b"]), ("I1", "A2", 3600, 3780, "HIGH", ["a", "b"]), ("I2", "A3", 9000, 9060, "CRITICAL", ["c"])], incidents.INCIDENT)
    return base, own


def test_briefing_with_and_without_scores(spark):
    base, own = two_incidents(spark)
    ranked = spark.createDataFrame([("I1", "b", 0.81234, 1, "is earliest, blast radius"), ("I1", "a", 0.2, 2, "is earliest")], "incident_id string, service string, score double, rank int, top_features string")
    got = {r.incident_id: r for r in incidents.briefing(incidents.detail(incidents.summaries(own, Config(), 4500), own, base), ranked).collect()}
    one, two = got["I1"], got["I2"]
    assert (one.title, one.status, one.confidence, one.score, one.alert_count) == ("HIGH incident on b", "closed", "high", 0.8123, 2)
    assert one.why == "Top contributing signals: is earliest, blast radius." and one.duration_minutes == 3.0
    assert one.evidence == ["Earliest alert: b latency_spike at 1970-01-01T01:00:00+00:00.", "RCA feature evidence emphasized: is earliest, blast radius.", "2 alert(s) were clustered into this incident."]
    assert one.actions[0] == "Check b deploys, saturation, and dependency errors first." and len(one.actions) == 3
    assert "**Affected services:** a, b\n\n## Summary\nHIGH incident affecting 2 service(s); b is the top RCA candidate with high confidence.\n" in one.markdown
    assert (two.title, two.status, two.confidence, two.score, two.cause) == ("CRITICAL incident on unknown service", "active", "unknown", None, None)
    assert two.summary == "CRITICAL incident affecting 1 service(s); RCA scoring has not run yet." and "Not enough RCA data (unknown confidence)" in two.markdown
    assert two.actions[0].startswith("Run the RCA ranking job") and len(two.evidence) == 2


def test_labels_fall_back_to_ids(spark):
    known = spark.createDataFrame([(f"s{n}", n) for n in "abcde"], "id string, name string")
    own = spark.createDataFrame([("I1", "A1", 0, 1, "HIGH", list("abcde")), ("I1", "A2", 0, 1, "HIGH", list("abcde")), ("I2", "A3", 0, 1, "HIGH", ["b"])], incidents.INCIDENT)
    got = incidents.service_labels(own, known, known.where("name <> 'b'"))
    assert sorted(map(tuple, got.collect())) == [("I1", 5, "a, sb, c +2"), ("I2", 1, "sb")]


def test_gate_has_its_bounds(spark):
    good = {"mad_recall": 0.8, "forest_recall": 0.9, "mad_f1": 0.8, "compression": 0.5, "training_n": 10, "held_out_n": 6, "held_out_top1": 0.8, "held_out_top3": 1.0, "mad_fpr": 0.05, "forest_fpr": 0.01} | {k: float(v) for k, v in evaluate.CONTRACT.items()}
    frame = lambda figures: spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "name string, value double")
    assert evaluate.gate(frame(good)).where("ok").count() == len(good) + 1  # compression has two bounds
    for name, value in (("compression", 0.95), ("compression", 0.3), ("mad_fpr", 0.06), ("held_out_n", 5), ("windows", 99), ("truths", 4)):
        with pytest.raises(AssertionError, match=name):
            evaluate.gate(frame(good | {name: value}))
    with pytest.raises(AssertionError, match="mad_f1"):
        evaluate.gate(frame({k: v for k, v in good.items() if k != "mad_f1"}))
    assert evaluate.judged(frame({"x": 1}).limit(0), {"x": 1}, {"y": 2}).where("ok").count() == 0


def test_stored_forests_score_like_fresh_ones(spark, tmp_path):
    rng = np.random.default_rng(0)
    own = spark.createDataFrame([("a", 3600, 3600 * k, float(rng.poisson(50)), 0.01, float(rng.normal(30, 3)), float(rng.poisson(9))) for k in range(60)], "service string, size bigint, window_start bigint, request_count double, error_rate double, p95_latency_ms double, unique_messages double")
    detect.forests(own, CFG).write.parquet(f"{tmp_path}/forest")
    fresh, kept = detect.forest_anomalies(own, CFG), detect.forest_anomalies(own, CFG, forest=detect.load_forests(spark, f"{tmp_path}/forest"))
    assert rows(fresh) == rows(kept) and fresh.count() > 0
    detect.forests(own.limit(0), CFG).write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no forest"):
        detect.load_forests(spark, f"{tmp_path}/none")
